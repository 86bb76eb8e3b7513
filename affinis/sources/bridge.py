"""The driver's order tables seen as a survey: one respondent per order.

State is the customer's nation, the socioeconomic code the order's priority, the weight the customer's
balance (not positive: invalid), stratum the market segment and PSU the customer. Ten conditions are codes
1 / 2 from predicates on the order's lines, without lines missing, and 9 (unknown) on a fixed pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONDITIONS = [f"COND_{x}" for x in "ABCDEFGHIJ"]
RAW = [f"RAW_{x}" for x in "ABCDEFGHIJ"]
#: What makes a line count for each condition: valid in Spark and in ANSI SQL.
PREDICATES = [
    "l_returnflag = 'R' AND l_linestatus = 'F'",
    "l_discount >= 0.08",
    "l_tax >= 0.07",
    "l_quantity >= 40",
    "l_extendedprice >= 60000",
    "l_linenumber = 1",
    "l_suppkey % 5 = 0",
    "l_quantity <= 5",
    "l_discount <= 0.01",
    "l_partkey % 7 = 0",
]
YEAR, DEFINITION = 2024, "priority"
#: Rows of `orders` at which the thresholds below hold; they scale with the table, 5 at least.
REFERENCE_ROWS = 15000
THRESHOLDS = {"population": 200, "complete": 150, "cases": 30, "cooccurring": 25}
MINIMUM_PAIRED_STATES = 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def thresholds(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    n = load(spark, sf_dir, "orders").count()  # from the footers
    return {k: max(5, v * n // REFERENCE_ROWS) for k, v in THRESHOLDS.items()}


def raw_respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Respondents with raw codes."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.min(F.expr(f"CASE WHEN {p} THEN 1 ELSE 2 END")).alias(c) for p, c in zip(PREDICATES, RAW, strict=True)])
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    people = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    df = orders.join(people, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    codes = [F.when(F.col("o_orderkey") % (11 + i) == 0, 9).otherwise(F.col(c)).cast("double").alias(c) for i, c in enumerate(RAW)]
    return df.select(
        F.col("o_orderkey").alias("respondent_id"),
        F.col("c_nationkey").cast("int").alias("state_code"),
        F.substring("o_orderpriority", 1, 1).alias("ses_code"),
        F.col("c_acctbal").alias("survey_weight"),
        F.col("c_mktsegment").alias("survey_strata"),
        F.col("o_custkey").alias("survey_psu"),
        F.year("o_orderdate").alias("age_group"),
        F.col("o_orderstatus").alias("sex"),
        *codes,
    )
