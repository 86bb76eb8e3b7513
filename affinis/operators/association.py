"""Prevalences, pairwise weighted phi and edge rules."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.columns import bh, kish, phi, ratio, valid_weight
from affinis.sources.bridge import CONDITIONS

PAIR_KEYS = ["graph_id", "source_condition", "target_condition"]
MOMENTS = ["n", "n_a", "n_b", "n_ab", "sw", "sw2", "swa", "swb", "swab"]


def masked(df: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    """df with case_mask and seen_mask: a bit per condition that is 1, or that isn't missing."""
    bit = lambda test, i: F.when(test, F.lit(1 << i)).otherwise(0)
    case, seen = F.lit(0), F.lit(0)
    for i, c in enumerate(conditions):
        case = case + bit(F.coalesce(F.col(c) == 1, F.lit(False)), i)
        seen = seen + bit(F.col(c).isNotNull(), i)
    return df.withColumn("case_mask", case).withColumn("seen_mask", seen)


def profiles(df: DataFrame, keys: list[str], conditions: list[str] = CONDITIONS, weight: str = "survey_weight") -> DataFrame:
    """Rows with a valid weight, summed by keys and answer pattern.

    All moments of prevalences and pairs are sums, so respondents are reduced to at most 3^k patterns a
    population, on the map side, before they are spread over the k(k-1)/2 pairs.
    """
    df = masked(df.where(valid_weight(weight)), conditions)
    return df.groupBy(*keys, "case_mask", "seen_mask").agg(F.count("*").alias("n"), F.sum(weight).alias("sw"), F.sum(F.col(weight) * F.col(weight)).alias("sw2"))


def _dyads(conditions: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("source_condition"), F.lit(b).alias("target_condition"), F.lit(1 << i).alias("a"), F.lit(1 << j).alias("b")) for (i, a), (j, b) in combinations(enumerate(conditions), 2)])


def pair_moments(prof: DataFrame, keys: list[str], conditions: list[str] = CONDITIONS) -> DataFrame:
    """MOMENTS of complete rows by keys and pair; pairs without a complete row have zeros."""
    df = prof.select("*", F.explode(_dyads(conditions)).alias("d"))
    both = F.col("d.a").bitwiseOR(F.col("d.b"))
    seen = F.col("seen_mask").bitwiseAND(both) == both
    a, b = F.col("case_mask").bitwiseAND(F.col("d.a")) != 0, F.col("case_mask").bitwiseAND(F.col("d.b")) != 0
    total = lambda value, test, zero: F.sum(F.when(seen & test, F.col(value)).otherwise(zero))
    yes = F.lit(True)
    return df.groupBy(*keys, "d.source_condition", "d.target_condition").agg(
        total("n", yes, 0).alias("n"), total("n", a, 0).alias("n_a"), total("n", b, 0).alias("n_b"), total("n", a & b, 0).alias("n_ab"),
        total("sw", yes, 0.0).alias("sw"), total("sw2", yes, 0.0).alias("sw2"), total("sw", a, 0.0).alias("swa"), total("sw", b, 0.0).alias("swb"), total("sw", a & b, 0.0).alias("swab"),
    )


def estimates(moments: DataFrame, keys: list[str]) -> DataFrame:
    """The pair estimates that follow from MOMENTS."""
    return moments.select(
        *keys,
        "source_condition",
        "target_condition",
        phi(F.col("sw"), F.col("swa"), F.col("swb"), F.col("swab")).alias("association"),
        F.col("n").alias("n_complete"),
        F.col("n_a").alias("source_cases"),
        F.col("n_b").alias("target_cases"),
        F.col("n_ab").alias("cooccurring_cases"),
        F.col("sw").alias("weighted_n"),
        kish(F.col("sw"), F.col("sw2")).alias("kish_effective_n"),
        ratio(F.col("swa"), F.col("sw")).alias("weighted_source_prevalence"),
        ratio(F.col("swb"), F.col("sw")).alias("weighted_target_prevalence"),
        ratio(F.col("swab"), F.col("sw")).alias("weighted_joint_prevalence"),
    )


def eligible(pairs: DataFrame, limits: dict[str, int]) -> DataFrame:
    """pairs with pair_eligible and exclusion_reason, its reasons in fixed order."""
    reasons = [
        (F.col("n_complete") < limits["complete"], "complete_n"),
        (F.col("source_cases") < limits["cases"], "source_cases"),
        (F.col("target_cases") < limits["cases"], "target_cases"),
        (F.col("cooccurring_cases") < limits["cooccurring"], "cooccurring_cases"),
        (F.col("association").isNull(), "undefined_association"),
    ]
    out = pairs.withColumn("exclusion_reason", F.concat_ws("|", *[F.when(test, F.lit(name)) for test, name in reasons]))
    return out.withColumn("pair_eligible", F.col("exclusion_reason") == "")


def edge_table(df: DataFrame, limits: dict[str, int], minimum_effect: float, maximum_q: float | None = None, keys: tuple[str, ...] = ("graph_id",), conditions: list[str] = CONDITIONS) -> DataFrame:
    """All pairs of all populations with their estimates, eligibility and edge flag.

    Descriptive estimates have no p-value; with maximum_q set, no pair has an edge without one.
    """
    pairs = eligible(estimates(pair_moments(profiles(df, list(keys), conditions), list(keys), conditions), list(keys)), limits)
    pairs = pairs.withColumn("p_value", F.lit(None).cast("double"))
    pairs = pairs.withColumn("q_value", bh(F.col("p_value"), list(keys)))
    effect = F.coalesce(F.col("association") >= minimum_effect, F.lit(False))
    fdr = F.lit(True) if maximum_q is None else F.coalesce(F.col("q_value") <= maximum_q, F.lit(False))
    return pairs.withColumn("edge_present", F.col("pair_eligible") & effect & fdr)


def scenarios(pairs: DataFrame, rules: dict[str, float]) -> DataFrame:
    """pairs once per rule, edges at that rule's threshold."""
    spark = pairs.sparkSession
    table = spark.createDataFrame(sorted(rules.items()), "rule_id string, minimum_effect double")
    out = pairs.drop("edge_present").crossJoin(F.broadcast(table))  # a few rules
    return out.withColumn("edge_present", F.col("pair_eligible") & F.coalesce(F.col("association") >= F.col("minimum_effect"), F.lit(False)))


def prevalence(df: DataFrame, keys: list[str], conditions: list[str] = CONDITIONS) -> DataFrame:
    """(keys, condition) sums of valid answers: rows are reduced to answer patterns before conditions are listed.

    A row with an invalid weight counts for no condition, but its population stays.
    """
    ok = valid_weight("survey_weight")
    w = F.when(ok, F.col("survey_weight")).otherwise(0.0)
    df = masked(df, conditions)
    pattern = [F.when(ok, F.col(c)).otherwise(0).alias(c) for c in ("case_mask", "seen_mask")]
    prof = df.groupBy(*keys, *pattern).agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(1 << i).alias("bit")) for i, c in enumerate(conditions)])).alias("c")
    return prof.select(*keys, "n", "sw", "sw2", F.col("case_mask"), F.col("seen_mask"), each).select(
        *keys, "c.condition", "n", "sw", "sw2", (F.col("seen_mask").bitwiseAND(F.col("c.bit")) != 0).alias("seen"), (F.col("case_mask").bitwiseAND(F.col("c.bit")) != 0).alias("case")
    )


def _sums() -> list[Column]:
    total = lambda value, test: F.sum(F.when(F.col(test), F.col(value)).otherwise(0))
    return [total("n", "seen").alias("n_valid"), total("n", "case").alias("n_cases"), total("sw", "seen").alias("sw"), total("sw2", "seen").alias("sw2"), total("sw", "case").alias("swc")]


def _prevalence(agg: DataFrame, keys: list[str]) -> DataFrame:
    return agg.select(
        *keys, "condition", "n_valid", "n_cases", ratio(F.col("n_cases"), F.col("n_valid")).alias("unweighted_prevalence"),
        ratio(F.col("swc"), F.col("sw")).alias("weighted_prevalence"),
        F.col("sw").alias("weighted_population_denominator"),
        kish(F.col("sw"), F.col("sw2")).alias("kish_effective_n"),
    )


def node_prevalence(df: DataFrame, keys: tuple[str, ...] = ("graph_id",), conditions: list[str] = CONDITIONS) -> DataFrame:
    """Counts and prevalences of every condition in every population."""
    return _prevalence(prevalence(df, list(keys), conditions).groupBy(*keys, "condition").agg(*_sums()), list(keys))


def national_and_state(df: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    """Prevalence by state, and of all areas as geography ALL: grouping sets over answer patterns."""
    cube = prevalence(df, ["state_code"], conditions).rollup("condition", "state_code").agg(*_sums(), F.grouping_id().alias("level"))
    cube = cube.where("level < 3").withColumn("geography_code", F.when(F.col("level") == 1, F.lit("ALL")).otherwise(F.col("state_code").cast("string")))
    return _prevalence(cube, ["geography_code"])
