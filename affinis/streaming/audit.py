"""The audit as Structured Streaming: rows that arrive are added to running sums, never read again.

All figures of the audit follow from sums by profile: a state, a category, whether the weight is valid, the pattern
of answers and of missing variables. A micro-batch is reduced to its profiles (on the map side first) and written as
the batch's own partition of a table; a batch that is played again replaces its partition, so nothing counts twice.
The reports are made from the sum of all partitions, whose size depends on patterns and not on rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.columns import kish, number, ratio, valid_weight
from affinis.operators.association import masked
from affinis.operators.units import read

PROFILE = ["state_code", "ses_category", "weight_ok", "case_mask", "seen_mask", "missing_mask"]
SUMS = ["n", "sw", "sw2"]
PARTS = "state_code string, ses_category string, weight_ok boolean, case_mask int, seen_mask int, missing_mask long, n long, sw double, sw2 double, batch_id long"
KINDS = {"geography_code": "string", "item": "string", "n": "long", "n_missing": "long", "n_cases": "long", "weight": "double", "kish_effective_n": "double", "value": "double", "status": "string"}
REPORT = ["report", *KINDS]
REPORTS = ", ".join(f"{c} {t}" for c, t in [*KINDS.items(), ("report", "string")])


def running_state_sizes(stream: DataFrame) -> DataFrame:
    """Rows, weight and invalid weights by state, of all rows so far."""
    ok = valid_weight("survey_weight")
    return stream.groupBy("state_code").agg(F.count("*").alias("n_unweighted"), F.sum(F.when(ok, F.col("survey_weight")).otherwise(0.0)).alias("weighted_population_estimate"), F.count_if(~ok).alias("n_invalid_weight"))


def start(stream: DataFrame, name: str, checkpoint: str):
    """Process what has arrived, then stop: totals are kept in the checkpoint between calls."""
    return running_state_sizes(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def profiles(rows: DataFrame, conditions: list[str], items: list[str]) -> DataFrame:
    """PROFILE and SUMS of rows: state_code, ses_category, survey_weight, the conditions (1, 0 or null) and the items.

    Bit i of missing_mask is set where item i is null.
    """
    ok = valid_weight("survey_weight")
    w = F.when(ok, number("survey_weight")).otherwise(0.0)
    missing = F.lit(0).cast("long")
    for i, c in enumerate(items):
        missing = missing + F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i)).otherwise(0)
    df = masked(rows, conditions)
    df = df.withColumns({c: F.col(c).cast("int") for c in ("case_mask", "seen_mask")}).withColumns({"weight_ok": ok, "missing_mask": missing, "w": w, "state_code": F.col("state_code").cast("string")})
    return df.groupBy(*PROFILE).agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"))


def added(parts: DataFrame) -> DataFrame:
    """Profiles of several batches, summed."""
    return parts.groupBy(*PROFILE).agg(*[F.sum(c).alias(c) for c in SUMS])


def adder(conditions: list[str], items: list[str], table: str, survey: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes a batch's profiles as partition batch_id of `table`, in place of any earlier try."""

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = profiles(survey(batch), conditions, items).withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table)

    return add


def total(spark: SparkSession, table: str) -> DataFrame:
    """The sum of all batches written so far."""
    return added(read(spark, table, PARTS))


def _bits(names: list[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.lit(1 << i).cast("long").alias("bit")) for i, c in enumerate(names)])).alias("x")


def _shaped(df: DataFrame, report: str, **values: Column) -> DataFrame:
    own = [values.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in KINDS.items()]
    return df.select(F.lit(report).alias("report"), *own)


def state_sizes(profile: DataFrame) -> DataFrame:
    """Rows, invalid weights (n_missing) and the weight of each state."""
    agg = profile.groupBy(F.col("state_code").alias("geography_code")).agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("weight_ok"), F.col("n")).otherwise(0)).alias("n_missing"), F.sum("sw").alias("weight"))
    return _shaped(agg, "state_sizes")


def categories(profile: DataFrame) -> DataFrame:
    """Rows of each category, `missing` for none."""
    return _shaped(profile.groupBy(F.coalesce("ses_category", F.lit("missing")).alias("item")).agg(F.sum("n").alias("n")), "categories")


def missingness(profile: DataFrame, items: list[str]) -> DataFrame:
    """Rows, missing ones and their share for each variable."""
    gone = F.col("missing_mask").bitwiseAND(F.col("x.bit")) != 0
    rows = profile.select("missing_mask", "n", _bits(items))
    agg = rows.groupBy("x.item").agg(F.sum("n").alias("n"), F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("n_missing"))
    return _shaped(agg, "missingness", value=ratio(F.col("n_missing"), F.col("n")))


def _answers(profile: DataFrame, conditions: list[str]) -> DataFrame:
    on = lambda mask: F.col(mask).bitwiseAND(F.col("x.bit")) != 0
    return profile.select("*", _bits(conditions)).select("state_code", "x.item", *SUMS, on("seen_mask").alias("answered"), (on("seen_mask") & F.col("weight_ok")).alias("seen"), (on("case_mask") & F.col("weight_ok")).alias("case"))


def _sums() -> list[Column]:
    of = lambda v, test: F.sum(F.when(F.col(test), F.col(v)).otherwise(0))
    return [of("n", "seen").alias("n"), F.sum(F.when(F.col("answered"), 0).otherwise(F.col("n"))).alias("n_missing"), of("n", "case").alias("n_cases"), of("sw", "seen").alias("weight"), of("sw2", "seen").alias("sw2"), of("sw", "case").alias("swc"), F.sum("n").alias("rows")]


def prevalence(profile: DataFrame, conditions: list[str]) -> DataFrame:
    """Valid answers, cases, weights and weighted prevalence of each condition by state, and of all areas as ALL."""
    cube = _answers(profile, conditions).rollup("item", "state_code").agg(*_sums(), F.grouping_id().alias("level")).where("level < 3")
    place = F.when(F.col("level") == 1, F.lit("ALL")).otherwise(F.col("state_code"))
    return _shaped(cube, "prevalence", geography_code=place, kish_effective_n=kish(F.col("weight"), F.col("sw2")), value=ratio(F.col("swc"), F.col("weight")))


def candidates(profile: DataFrame, conditions: list[str], least_prevalence: float, most_missing: float) -> DataFrame:
    """Weighted prevalence of each condition and whether it is frequent and answered often enough."""
    agg = _answers(profile, conditions).groupBy("item").agg(*_sums())
    p, m = ratio(F.col("swc"), F.col("weight")), ratio(F.col("n_missing"), F.col("rows"))
    status = F.when((p >= least_prevalence) & (m <= most_missing), "provisional_include").otherwise("review")
    return _shaped(agg, "candidates", n=F.col("rows"), weight=F.lit(None), n_cases=F.lit(None), value=p, status=status)


def reports(profile: DataFrame, conditions: list[str], items: list[str], least_prevalence: float, most_missing: float) -> DataFrame:
    """All reports as rows of REPORT."""
    parts = [state_sizes(profile), categories(profile), missingness(profile, items), prevalence(profile, conditions), candidates(profile, conditions, least_prevalence, most_missing)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
