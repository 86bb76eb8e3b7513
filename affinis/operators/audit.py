"""Audit of raw and derived variables: sizes, missing answers, value counts, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions.columns import ratio, state_name, valid_weight
from affinis.sources.bridge import CONDITIONS


def state_sizes(df: DataFrame) -> DataFrame:
    ok = valid_weight("survey_weight")
    agg = df.groupBy(F.col("state_code").alias("geography_code")).agg(
        F.count("*").alias("n_unweighted"), F.sum(F.when(ok, F.col("survey_weight")).otherwise(0.0)).alias("weighted_population_estimate"), F.count_if(~ok).alias("n_invalid_weight")
    )
    return agg.select("geography_code", state_name(F.col("geography_code")).alias("geography"), "n_unweighted", "weighted_population_estimate", "n_invalid_weight")


def missingness(df: DataFrame, items: dict[str, list[str]]) -> DataFrame:
    """A row per item: all counts in one pass, then unpivoted."""
    names = [(kind, c) for kind, columns in items.items() for c in columns]
    counts = df.agg(F.count("*").alias("n_total"), *[F.count_if(F.col(c).isNull()).alias(c) for _, c in names])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("item_type"), F.lit(c).alias("item"), F.col(c).alias("n_missing")) for k, c in names]))
    return counts.select("n_total", rows.alias("x")).select("x.item_type", "x.item", "n_total", "x.n_missing", ratio(F.col("x.n_missing"), F.col("n_total")).alias("missing_fraction"))


def value_counts(df: DataFrame, definition: str, column: str = "ses_category") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("missing")).alias("category")).agg(F.count("*").alias("n")).select(F.lit(definition).alias("definition_name"), "category", "n")


def candidate_status(df: DataFrame, least_prevalence: float, most_missing: float, conditions: list[str] = CONDITIONS) -> DataFrame:
    """Conditions frequent and answered often enough: all counts in one pass, then one row a condition."""
    ok = valid_weight("survey_weight")
    w = lambda test: F.sum(F.when(ok & test, F.col("survey_weight")).otherwise(0.0))
    sums = df.agg(F.count("*").alias("n"), *[F.struct(w(F.col(c).isNotNull()).alias("sw"), w(F.col(c) == 1).alias("swc"), F.count_if(F.col(c).isNull()).alias("missing")).alias(c) for c in conditions])
    rows = sums.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).alias("s")) for c in conditions])).alias("x"))
    p, m = ratio(F.col("x.s.swc"), F.col("x.s.sw")), ratio(F.col("x.s.missing"), F.col("n"))
    status = F.when((p >= least_prevalence) & (m <= most_missing), "provisional_include").otherwise("review")
    return rows.select("x.condition", p.alias("weighted_prevalence"), m.alias("analytic_missing_fraction"), status.alias("prototype_selection_status"))
