"""One-row verdicts, target-population diagnostics and the tables behind figures.

A verdict is a row of measures and boolean gates; `decision` is GO where all gates hold, else HOLD. Gates
that were not assessed are null and do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.columns import average_rank, ratio, whole


def _decision(gates: list[str]) -> Column:
    return F.when(F.forall(F.array(*[F.coalesce(F.col(g), F.lit(True)) for g in gates]), lambda x: x), "GO").otherwise("HOLD")


def structure_verdict(stats: DataFrame, pairs: DataFrame, minimum_graphs: int, minimum_unique: float, low: float, high: float, caution: float) -> DataFrame:
    """Heterogeneity and density of one collection of graphs (mask, edge_count, density)."""
    s = stats.agg(
        F.count("*").alias("eligible_graph_count"), F.count_distinct("mask").alias("unique_edge_sets"), F.min("edge_count").alias("edge_count_minimum"), F.median("edge_count").alias("edge_count_median"),
        F.max("edge_count").alias("edge_count_maximum"), F.median("density").alias("density_median"), F.max("density").alias("density_maximum"),
    )
    p = pairs.agg(F.min("edge_jaccard").alias("jaccard_minimum"), F.median("edge_jaccard").alias("jaccard_median"), F.max("edge_jaccard").alias("jaccard_maximum"), F.avg(F.when(F.col("same_state") & ~F.col("same_ses"), F.col("edge_jaccard"))).alias("mean_within_state_jaccard"))
    out = s.crossJoin(p)  # one row each
    unique = F.coalesce(ratio(F.col("unique_edge_sets"), F.col("eligible_graph_count")), F.lit(0.0))
    out = out.withColumn("unique_edge_set_fraction", unique)
    a = (F.col("eligible_graph_count") >= minimum_graphs) & (F.col("unique_edge_set_fraction") >= minimum_unique) & (F.col("edge_count_maximum") > F.col("edge_count_minimum"))
    out = out.withColumns({"structural_heterogeneity": a, "usable_density": F.col("density_median").between(low, high), "recurrent_motifs": F.lit(None).cast("boolean"), "density_caution": F.col("density_maximum") >= caution})
    return out.withColumn("decision", _decision(["structural_heterogeneity", "usable_density", "recurrent_motifs"]))


def calibration_verdict(calibration: DataFrame, pairs: DataFrame, support: DataFrame, minimum_graphs: int, bootstrap_complete: bool) -> DataFrame:
    """calibration: the one row of the candidate rule; pairs and support: of its graphs."""
    p = pairs.agg(F.median("edge_jaccard").alias("median_raw_jaccard"), F.median("density_z").alias("median_density_adjusted_z"))
    e = support.agg(F.count_if(F.col("support_fraction").between(0.10, 0.90)).alias("variable_recurrent_edge_count"))
    out = calibration.crossJoin(p).crossJoin(e)
    gates = {
        "enough_graphs": F.col("graph_count") >= minimum_graphs,
        "moderately_sparse": F.col("median_edge_target_met") & F.col("maximum_density_target_met"),
        "heterogeneous_but_comparable": (F.col("median_raw_jaccard") < 0.95) & (F.col("median_density_adjusted_z") > 0),
        "recurrent_edge_backbone": F.col("variable_recurrent_edge_count") >= 5,
        "bootstrap_complete": F.lit(bootstrap_complete),
    }
    return out.withColumns(gates).withColumn("decision", _decision(list(gates)))


def selection_verdict(stats: DataFrame, pairs: DataFrame, support: DataFrame, boot: DataFrame, continuity: DataFrame, positive_both: float | None, effect: float, stability: float, s: dict[str, float]) -> DataFrame:
    """The nine gates of the stable rule; s holds their limits."""
    a = stats.agg(F.count("*").alias("graph_count"), F.median("edge_count").alias("median_edge_count"), F.max("density").alias("maximum_density"))
    p = pairs.agg(F.median("edge_jaccard").alias("median_raw_jaccard"), F.median("density_z").alias("median_density_adjusted_z"))
    e = support.agg(F.count_if(F.col("support_fraction").between(0.10, 0.90)).alias("variable_recurrent_edge_count"))
    raw = F.col("pair_eligible") & (F.round("association", 9) >= effect)
    ok = (F.col("bootstrap_status") == "ok") & (F.col("bootstrap_replicates_valid") == F.col("bootstrap_replicates_requested"))
    b = boot.agg(F.bool_and(ok).alias("bootstrap_complete"), F.count_if(raw).alias("raw_edge_count"), F.count_if(raw & ok & (F.col("p_phi_ge_threshold") >= stability)).alias("stable_edge_count"))
    adjacent, outer = F.col("transition_type") == "adjacent", F.col("transition_type") == "outer"
    c = continuity.agg(
        F.bool_and(F.when(adjacent, (F.col("median_edge_jaccard") >= s["adjacent"]) & (F.col("fraction_edge_jaccard_below_050") <= s["below_050"])).when(outer, F.col("median_edge_jaccard") >= s["outer"]) & F.col("all_graphs_nested")).alias("threshold_continuity")
    )
    out = a.crossJoin(p).crossJoin(e).crossJoin(b).crossJoin(c)
    out = out.withColumn("raw_edge_stable_fraction", ratio(F.col("stable_edge_count"), F.col("raw_edge_count")))
    gates = {
        "enough_graphs": F.col("graph_count") >= s["graphs"],
        "moderate_density": (F.col("median_edge_count") <= s["edges_most"]) & (F.col("maximum_density") < s["density"]),
        "meaningful_edge_count": F.col("median_edge_count") >= s["edges_least"],
        "most_raw_edges_stable": F.col("raw_edge_stable_fraction") >= s["stable"],
        "heterogeneous_but_comparable": (F.col("median_raw_jaccard") < s["jaccard"]) & (F.col("median_density_adjusted_z") > 0),
        "recurrent_edge_backbone": F.col("variable_recurrent_edge_count") >= s["recurrent"],
        "adjustment_concordance": F.lit(None if positive_both is None else positive_both >= s["concordance"]).cast("boolean"),
    }
    return out.withColumns(gates).withColumn("decision", _decision([*gates, "bootstrap_complete", "threshold_continuity"]))


def feasibility(index: DataFrame, catalog: DataFrame, fractions: list[str]) -> DataFrame:
    """Graph database and motif catalog in one row."""
    g = index.agg(
        F.count("*").alias("graph_count"), F.avg("edge_count").alias("mean_edge_count"), F.min("edge_count").alias("minimum_edge_count"), F.max("edge_count").alias("maximum_edge_count"),
        F.count_if(F.col("edge_count") >= 5).alias("graphs_with_at_least_five_edges"), F.count_if(F.col("largest_component_nodes") >= 5).alias("graphs_with_five_node_component"), F.count_if(F.col("triangle_count") > 0).alias("graphs_with_triangles"),
    )
    c = catalog.agg(
        F.count("*").alias("motif_count_total"), F.count_if("is_closed").alias("closed_motif_count"), F.count_if("is_maximal").alias("maximal_motif_count"), F.count_distinct("occurrence_class_id").alias("occurrence_class_count"),
        F.min("paired_state_count").alias("paired_state_count_minimum"), F.max("paired_state_count").alias("paired_state_count_maximum"), *[F.count_if(f"support_{n}").alias(f"motifs_{n}") for n in fractions],
    )
    return g.crossJoin(c)


def target_edges(edges: DataFrame, target: str, rules: list[str]) -> DataFrame:
    """Pairs of one population with a column per rule: whether the pair is an edge there."""
    e = edges.where(F.col("graph_id") == target)
    flags = e.groupBy("source_condition", "target_condition").pivot("rule_id", rules).agg(F.bool_or("edge_present"))
    names = flags.select("source_condition", "target_condition", *[F.col(f"`{x}`").alias(f"edge_present_{x}") for x in rules])
    base = e.where(F.col("rule_id") == rules[0]).select("source_condition", "target_condition", F.col("association").alias("weighted_phi"), "n_complete", "cooccurring_cases")
    return base.join(names, ["source_condition", "target_condition"], "left")


def target_prevalence(nodes: DataFrame, target: str, peers: Column) -> DataFrame:
    """Prevalences of one population against the median of its peers, in 1.4826 MADs."""
    own = nodes.where(F.col("graph_id") == target).select("condition", "weighted_prevalence", "n_valid", "n_cases")
    other = nodes.where(peers & (F.col("graph_id") != target)).select("condition", F.col("weighted_prevalence").alias("x"))
    mid = other.withColumn("m", F.median("x").over(whole("condition"))).groupBy("condition").agg(F.max("m").alias("peer_median"), F.median(F.abs(F.col("x") - F.col("m"))).alias("mad"))
    z = F.try_divide(F.col("weighted_prevalence") - F.col("peer_median"), F.when(F.col("mad") > 0, 1.4826 * F.col("mad")))
    return own.join(mid, "condition").select("condition", "weighted_prevalence", "peer_median", z.alias("peer_robust_z"), "n_valid", "n_cases")


def largest_deviations(prevalence: DataFrame, k: int = 3) -> DataFrame:
    return prevalence.orderBy(F.desc_nulls_last(F.abs("peer_robust_z")), "condition").limit(k)


def target_summary(reg: DataFrame, edges: DataFrame, target: str, threshold: float) -> DataFrame:
    """Size, design effect, percentile of the effective size among its category, and near misses of one population."""
    ok = reg.where("eligibility_status = 'eligible'").withColumn("k", F.round("kish_effective_n", 6))
    ranked = ok.withColumn("percentile", average_rank("k", ["ses_category"]) / F.count("*").over(whole("ses_category")))
    own = ranked.where(F.col("graph_id") == target).select("graph_id", "n_unweighted", "kish_effective_n", F.try_divide(F.col("n_unweighted").cast("double"), F.col("kish_effective_n")).alias("design_effect"), "percentile")
    x = F.round("association", 9)
    near = edges.where(F.col("graph_id") == target).agg(F.min("n_complete").alias("minimum_pair_complete_n"), F.count_if((x >= threshold - 0.02) & (x < threshold)).alias("edges_just_below_threshold"))
    return own.crossJoin(near)


def threshold_counts(stats: DataFrame, rules: list[str]) -> DataFrame:
    """Graph x rule edge counts, side by side."""
    p = stats.groupBy("graph_id").pivot("rule_id", rules).agg(F.max("edge_count"))
    return p.select("graph_id", *[F.col(f"`{x}`").alias(x) for x in rules])


def size_by_level(shapes: DataFrame, levels: list[str]) -> DataFrame:
    """Motif counts by node count and support level, 0 where there are none."""
    p = shapes.groupBy("node_count").pivot("support_level", levels).agg(F.sum("motif_count"))
    return p.select("node_count", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) for x in levels])


def stability_bins(edges: DataFrame, threshold: float, width: float = 0.01) -> DataFrame:
    """Median stability in bins of phi above the threshold."""
    b = F.floor((F.round("association", 9) - threshold) / width)
    return edges.groupBy(b.alias("bin")).agg(F.count("*").alias("edges"), F.median("p_phi_ge_threshold").alias("median_stability"))


def definition_sensitivity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Graphs of two definitions joined on state and category, ready for graphs.density_null."""
    from affinis.functions.columns import bits, jaccard

    x = a.select("geography_code", "ses_category", F.col("mask").alias("m1"))
    y = b.select("geography_code", "ses_category", F.col("mask").alias("m2"))
    j = x.join(y, ["geography_code", "ses_category"])
    return j.select("geography_code", "ses_category", bits("m1").alias("edges_a"), bits("m2").alias("edges_b"), jaccard(F.col("m1"), F.col("m2")).alias("edge_jaccard"))
