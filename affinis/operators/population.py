"""Population registries: a row per state and category even where nobody answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.columns import graph_id, kish, state_name, valid_weight
from affinis.sources.bridge import DEFINITION, YEAR

CATEGORIES = ("lower", "higher")


def registry(df: DataFrame, minimum_n: int, states: DataFrame, paired: bool = True, year: int = YEAR, definition: str | None = DEFINITION) -> DataFrame:
    """states: (state_code) to report on. With paired, an eligible stratum needs an eligible sibling."""
    ok = valid_weight("survey_weight")
    w = F.when(ok, F.col("survey_weight")).otherwise(0.0)
    found = df.where(F.col("ses_category").isNotNull()).groupBy("state_code", "ses_category").agg(
        F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.count_distinct("survey_strata").alias("strata"), F.count_distinct("survey_psu").alias("psus")
    )
    reporting = df.where(F.col("state_code").isNotNull()).select("state_code").distinct().withColumn("reports", F.lit(True))
    every = states.select(F.col("state_code").cast("int").alias("state_code")).distinct().select("state_code", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("ses_category"))
    all_rows = every.join(found, ["state_code", "ses_category"], "left").join(reporting, "state_code", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n >= minimum_n, "eligible").otherwise("insufficient sample")
    if paired:
        status = F.when(F.col("reports").isNull(), "no reporting data").otherwise(status)
    out = all_rows.select(
        graph_id(year, F.col("state_code"), definition, F.col("ses_category")).alias("graph_id"),
        F.col("state_code").alias("geography_code"),
        state_name(F.col("state_code")).alias("geography"),
        "ses_category",
        n.alias("n_unweighted"),
        F.coalesce("sw", F.lit(0.0)).alias("weighted_population_estimate"),
        kish(F.col("sw"), F.col("sw2")).alias("kish_effective_n"),
        F.coalesce("strata", F.lit(0)).alias("n_strata"),
        F.coalesce("psus", F.lit(0)).alias("n_psu"),
        status.alias("stratum_eligibility_status"),
    )
    if not paired:
        return out.withColumnRenamed("stratum_eligibility_status", "eligibility_status")
    both = F.bool_and(F.col("stratum_eligibility_status") == "eligible").over(Window.partitionBy("geography_code"))
    relabelled = F.when(~both & (F.col("stratum_eligibility_status") == "eligible"), "paired SES stratum ineligible").otherwise(F.col("stratum_eligibility_status"))
    return out.withColumn("eligibility_status", relabelled)


def with_graph_id(df: DataFrame, year: int = YEAR, definition: str | None = DEFINITION) -> DataFrame:
    """Respondents of a category, with their population's id."""
    return df.where(F.col("ses_category").isNotNull() & F.col("state_code").isNotNull()).withColumn("graph_id", graph_id(year, F.col("state_code"), definition, F.col("ses_category")))


def usable(reg: DataFrame, quality: DataFrame) -> DataFrame:
    """Eligible populations whose bootstrap is complete, and their sibling's too."""
    ok = reg.where("eligibility_status = 'eligible'").join(quality, "graph_id", "left").where(F.coalesce("graph_bootstrap_complete", F.lit(False)))
    both = F.size(F.collect_set("ses_category").over(Window.partitionBy("geography_code"))) == len(CATEGORIES)
    return ok.withColumn("both", both).where("both").drop("both")
