"""Recodes of raw answers to nullable conditions and strata, and the registries that describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.columns import number
from affinis.sources import bridge

#: Condition -> (raw variable, codes for yes, codes for no).
CODING = {c: (s, [1.0], [2.0]) for c, s in zip(bridge.CONDITIONS, bridge.RAW, strict=True)}
SES_GROUPS = {"lower": ["1", "2"], "higher": ["4", "5"]}


def binary(raw: Column | str, yes: list[float], no: list[float]) -> Column:
    """1, 0, or NULL for codes in neither list."""
    v = number(raw)
    return F.when(v.isin(yes), F.lit(1.0)).when(v.isin(no), F.lit(0.0))


def category(raw: Column | str, groups: dict[str, list]) -> Column:
    """The category whose codes hold the value; of two, the later one."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    out = F.lit(None).cast("string")
    for name, codes in groups.items():
        out = F.when(raw.isin(codes), F.lit(name)).otherwise(out)
    return out


def check_coding(coding: dict[str, tuple[str, list, list]], available: list[str]) -> None:
    for name, (source, yes, no) in coding.items():
        if set(yes) & set(no):
            raise ValueError(f"{name}: a code means yes and no")
        if source not in available:
            raise ValueError(f"{name}: no variable {source}")


def harmonize(raw: DataFrame, coding: dict[str, tuple[str, list, list]] | None = None, states: list[int] | None = None) -> DataFrame:
    """One projection from raw respondents to harmonized ones; a state filter is pushed to the scan."""
    coding = coding or CODING
    check_coding(coding, raw.columns)
    if states is not None:
        raw = raw.where(F.col("state_code").isin(states))
    return raw.select(
        "respondent_id",
        "state_code",
        category("ses_code", SES_GROUPS).alias("ses_category"),
        number("survey_weight").alias("survey_weight"),
        "survey_strata",
        "survey_psu",
        "age_group",
        "sex",
        *[binary(s, y, n).alias(c) for c, (s, y, n) in coding.items()],
    )


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonize(bridge.raw_respondents(spark, sf_dir))


def condition_registry(spark: SparkSession, variables: DataFrame, coding: dict | None = None) -> DataFrame:
    """One row per condition: its source, codes, and whether the variable is there."""
    rows = [(c, s, ",".join(f"{int(x)}" for x in y), ",".join(f"{int(x)}" for x in n)) for c, (s, y, n) in (coding or CODING).items()]
    table = spark.createDataFrame(rows, "condition string, source_variable string, positive_codes string, negative_codes string")
    known = variables.select(F.col("variable").alias("source_variable"), F.lit(True).alias("found"))
    return table.join(known, "source_variable", "left").select("condition", "source_variable", "positive_codes", "negative_codes", F.coalesce("found", F.lit(False)).alias("source_available"))


def ses_registry(spark: SparkSession, variables: DataFrame) -> DataFrame:
    rows = [(bridge.DEFINITION, "ses_code", g, ",".join(codes)) for g, codes in SES_GROUPS.items()]
    table = spark.createDataFrame(rows, "definition_name string, source_variable string, category string, codes string")
    known = variables.select(F.col("variable").alias("source_variable"), F.lit(True).alias("found"))
    return table.join(known, "source_variable", "left").select("definition_name", "category", "codes", "source_variable", F.coalesce("found", F.lit(False)).alias("source_available"))


def variable_dictionary(df: DataFrame) -> DataFrame:
    """Position, name and type of each variable: from the schema, without a scan."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, variable string, type string")


def analysis_roles(spark: SparkSession, coding: dict | None = None) -> DataFrame:
    """variable -> its roles, in order, joined by a bar."""
    roles = [(s, 0, f"condition:{c}") for c, (s, _, _) in (coding or CODING).items()]
    roles += [("ses_code", 1, f"ses:{bridge.DEFINITION}")]
    roles += [(v, 2, f"survey:{k}") for k, v in (("state", "state_code"), ("weight", "survey_weight"), ("strata", "survey_strata"), ("psu", "survey_psu"))]
    df = spark.createDataFrame(roles, "variable string, kind int, role string")
    ordered = F.array_sort(F.collect_list(F.struct("kind", "role")))
    return df.groupBy("variable").agg(F.array_join(F.transform(ordered, lambda x: x["role"]), "|").alias("analysis_roles"))
