"""Checks of a frozen replication protocol's data, as counts of what is wrong: all zero passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.operators.motifs import connected_masks, motif_edges, motif_id


def motif_violations(vocabulary: DataFrame, minimum_support: float) -> DataFrame:
    """vocabulary: motif_id, mask, support_fraction. Wrong ids, unconnected patterns, doubled rows, low support."""
    known = connected_masks(vocabulary.sparkSession).select("mask", F.lit(True).alias("connected"))
    v = vocabulary.join(known, "mask", "left")
    doubled = vocabulary.groupBy("motif_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("doubled_ids"))
    return v.agg(
        F.count_if(F.col("motif_id") != motif_id(motif_edges(F.col("mask")))).alias("wrong_ids"),
        F.count_if(F.col("connected").isNull()).alias("unconnected"),
        F.count_if(F.col("support_fraction") < minimum_support).alias("below_support"),
    ).crossJoin(doubled)


def partition_violations(vocabulary: DataFrame, families: DataFrame) -> DataFrame:
    """Families (occurrence_class_id, motif_id) must hold each motif of the vocabulary once, and no other."""
    v, f = vocabulary.select("motif_id").distinct(), families.select("motif_id")
    missing = v.exceptAll(f.distinct()).agg(F.count("*").alias("missing"))
    foreign = f.distinct().exceptAll(v).agg(F.count("*").alias("unknown"))
    twice = f.groupBy("motif_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("in_two_families"))
    return missing.crossJoin(foreign).crossJoin(twice)


def frozen_violations(edges: DataFrame, effect: float, stability: float) -> DataFrame:
    """Edges of a frozen graph set that don't meet the rule it was frozen by."""
    ok = (F.col("association") >= effect) & (F.col("p_phi_ge_threshold") >= stability) & F.col("pair_eligible")
    return edges.where("edge_present").agg(F.count("*").alias("frozen_edges"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("violations"))


def provenance_violations(frozen: DataFrame, source: DataFrame, key: str, columns: dict[str, str], tolerance: float = 1e-12) -> DataFrame:
    """(field, missing, doubled, mismatches): frozen columns against those of the source they were copied from.

    columns: source name to frozen name. Numbers agree within the tolerance, all else exactly; nulls agree with nulls.
    """
    kinds = dict(source.dtypes)
    renamed = source.select(F.col(key), F.lit(True).alias("_found"), *[F.col(c).alias(f"_source_{c}") for c in columns])
    j = frozen.join(renamed, key, "left")
    number = lambda c: kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")

    def off(c: str) -> Column:
        a, b = F.col(f"_source_{c}"), F.col(columns[c])
        same = F.coalesce(F.abs(a - b) <= F.lit(tolerance), a.isNull() & b.isNull()) if number(c) else a.cast("string").eqNullSafe(b.cast("string"))
        return F.col("_found").isNotNull() & ~same

    doubled = j.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("doubled"))
    counts = j.agg(F.count_if(F.col("_found").isNull()).alias("missing"), *[F.count_if(off(c)).alias(f"off_{i}") for i, c in enumerate(columns)]).crossJoin(doubled)
    rows = F.explode(F.array(*[F.struct(F.lit(columns[c]).alias("field"), F.col(f"off_{i}").alias("mismatches")) for i, c in enumerate(columns)])).alias("r")
    return counts.select(rows, "missing", "doubled").select("r.field", "missing", "doubled", "r.mismatches")


def hypothesis_violations(hypotheses: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """hypotheses: hypothesis_id, family_order, direction_sign, expected_enrichment, motif_id, edge_list; vocabulary: motif_id, edge_list.

    Doubled ids, orders that are not 1 to n, signs that don't fit the expected side, motifs that are unknown or
    have other edges.
    """
    h = hypotheses.join(vocabulary.select("motif_id", F.col("edge_list").alias("known")), "motif_id", "left")
    sign = F.when(F.col("expected_enrichment") == "lower", 1).when(F.col("expected_enrichment") == "higher", -1)
    return h.agg(
        (F.count("*") - F.count_distinct("hypothesis_id")).alias("doubled_ids"),
        F.coalesce((F.count_distinct("family_order") < F.count("*")) | (F.min("family_order") != 1) | (F.max("family_order") != F.count("*")), F.lit(False)).alias("wrong_order"),
        F.count_if(~F.coalesce(F.col("direction_sign") == sign, F.lit(False))).alias("wrong_signs"),
        F.count_if(F.col("known").isNull()).alias("unknown_motifs"),
        F.count_if(F.col("known") != F.col("edge_list")).alias("other_edges"),
    )


def target_violations(targets: DataFrame, limits: dict[str, tuple[float, float]], required: dict[str, object]) -> DataFrame:
    """(field, problem) of a table of settings (field, value): required values that differ or are absent, numbers beyond their limits."""
    spark = targets.sparkSession
    want = spark.createDataFrame([(k, str(v)) for k, v in required.items()], "field string, want string")
    range_ = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in limits.items()], "field string, low double, high double")
    other = want.join(targets, "field", "left").where("value IS NULL OR value <> want").select("field", F.when(F.col("value").isNull(), "absent").otherwise("other value").alias("problem"))
    number = F.col("value").try_cast("double")
    beyond = range_.join(targets, "field", "left").where(~F.coalesce(number.between(F.col("low"), F.col("high")), F.lit(False))).select("field", F.lit("beyond its limits").alias("problem"))
    return other.union(beyond)
