"""Association graphs as edge masks: statistics, similarity, topology.

A graph over k <= 10 conditions has at most 45 possible edges: a bit each, in a BIGINT. Pairs are numbered
in alphabetical order. A table of graphs has graph_id, mask (edges) and opportunity (eligible pairs).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.functions.columns import MAD_SCALE, average_rank, bits, correlation, jaccard, ratio
from affinis.sources.bridge import CONDITIONS


def pairs_of(conditions: list[str] = CONDITIONS) -> list[tuple[str, str]]:
    return list(combinations(sorted(conditions), 2))


def edge_universe(spark: SparkSession, conditions: list[str] = CONDITIONS) -> DataFrame:
    rows = [(i, a, b, 1 << i) for i, (a, b) in enumerate(pairs_of(conditions))]
    return spark.createDataFrame(rows, "edge_idx int, a string, b string, bit long")


def edge_bit(source: Column, target: Column, conditions: list[str] = CONDITIONS) -> Column:
    """The bit of a pair in either orientation."""
    table = F.create_map(*[x for i, (a, b) in enumerate(pairs_of(conditions)) for x in (F.lit(f"{a}|{b}"), F.lit(1 << i).cast("long"))])
    return F.try_element_at(table, F.concat_ws("|", F.least(source, target), F.greatest(source, target)))


def masks(edges: DataFrame, keys: tuple[str, ...] = ("graph_id",), conditions: list[str] = CONDITIONS) -> DataFrame:
    """Edges and opportunities of each graph as masks; raises on doubled, missing or unknown pairs when run."""
    bit = edge_bit(F.col("source_condition"), F.col("target_condition"), conditions)
    want = len(pairs_of(conditions))
    df = edges.withColumn("bit", bit).groupBy(*keys).agg(
        F.bit_or(F.when(F.col("edge_present"), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("mask"),
        F.bit_or(F.when(F.col("pair_eligible"), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("opportunity"),
        F.count_if(F.col("pair_eligible").isNotNull() & F.col("bit").isNotNull()).alias("known"),
        F.count("*").alias("rows"),
    )
    broken = (F.col("known") != want) | (F.col("rows") != want)
    return df.select(*keys, F.when(broken, F.raise_error(F.lit("a graph lacks pairs, doubles them, or has pairs of unknown eligibility")).cast("long")).otherwise(F.col("mask")).alias("mask"), "opportunity")


def mask_edges(df: DataFrame, mask: str, conditions: list[str] = CONDITIONS) -> DataFrame:
    """df with a row (a, b, edge_idx) per edge of its mask."""
    all_edges = F.array(*[F.struct(F.lit(i).alias("edge_idx"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(1 << i).cast("long").alias("bit")) for i, (a, b) in enumerate(pairs_of(conditions))])
    return df.withColumn("edge", F.explode(F.filter(all_edges, lambda e: F.col(mask).bitwiseAND(e["bit"]) != 0))).withColumns({"edge_idx": F.col("edge.edge_idx"), "a": F.col("edge.a"), "b": F.col("edge.b")}).drop("edge")


def _incident(conditions: list[str], node: int) -> int:
    names = sorted(conditions)
    return sum(1 << i for i, e in enumerate(pairs_of(conditions)) if names[node] in e)


def degrees(mask: Column, conditions: list[str] = CONDITIONS) -> Column:
    """Degree of each node, in alphabetical order."""
    return F.array(*[bits(mask.bitwiseAND(F.lit(_incident(conditions, i)).cast("long"))) for i in range(len(conditions))])


def triangles(mask: Column, conditions: list[str] = CONDITIONS) -> Column:
    at = {e: i for i, e in enumerate(pairs_of(conditions))}
    three = [(1 << at[a, b]) | (1 << at[a, c]) | (1 << at[b, c]) for a, b, c in combinations(sorted(conditions), 3)]
    return F.size(F.filter(F.array(*[F.lit(t).cast("long") for t in three]), lambda t: mask.bitwiseAND(t) == t))


def component_sizes(mask: Column, conditions: list[str] = CONDITIONS) -> Column:
    """Sizes of the connected components, by spreading the smallest label over the edges k - 1 times at most."""
    k = len(conditions)
    names = sorted(conditions)
    ends = [(names.index(a), names.index(b)) for a, b in pairs_of(conditions)]
    adjacency = F.array(*[reduce(lambda x, y: x + y, [F.when(mask.bitwiseAND(F.lit(1 << e).cast("long")) != 0, F.lit(1 << (b if a == i else a))).otherwise(0) for e, (a, b) in enumerate(ends) if i in (a, b)], F.lit(1 << i)) for i in range(k)])

    def spread(adj: Column, sets: Column) -> Column:
        # a set reaches what its members reach
        return F.transform(sets, lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), s, lambda acc, i: F.when(F.call_function("getbit", s, i) == 1, acc.bitwiseOR(F.get(adj, i))).otherwise(acc)))

    def closed(adj: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), adj, lambda sets, _: spread(sets, sets))  # reach doubles each time: 4 rounds for up to 16 nodes

    sets = F.get(F.transform(F.array(adjacency), closed), F.lit(0))
    return F.transform(F.array_distinct(sets), lambda s: F.bit_count(s).cast("int"))


def statistics(graphs: DataFrame, eligible_nodes: str | None = None, conditions: list[str] = CONDITIONS) -> DataFrame:
    """graphs (mask...) with node_count, edge_count, density, components, isolates, degrees, transitivity, triangles.

    eligible_nodes: a column with the number of nodes of each graph; all conditions without it. Nodes that
    aren't eligible must have no edges.
    """
    k = len(conditions)
    nodes = F.col(eligible_nodes) if eligible_nodes else F.lit(k)
    df = graphs.withColumn("_deg", degrees(F.col("mask"), conditions)).withColumn("_comp", component_sizes(F.col("mask"), conditions))
    edge_count = bits("mask")
    alone = F.size(F.filter("_deg", lambda d: d == 0)) - (F.lit(k) - nodes)
    paths = F.aggregate(F.transform("_deg", lambda d: (d * (d - 1)).cast("double") / 2), F.lit(0.0), lambda acc, x: acc + x)
    return df.withColumns(
        {
            "node_count": nodes.cast("int"),
            "edge_count": edge_count,
            "density": F.when(nodes > 1, 2 * edge_count / (nodes * (nodes - 1))).otherwise(0.0),
            "component_count": (F.size("_comp") - (F.lit(k) - nodes)).cast("int"),
            "isolate_count": alone.cast("int"),
            "largest_component_nodes": F.array_max("_comp"),
            "mean_degree": F.when(nodes > 0, 2 * edge_count / nodes).otherwise(0.0),
            "maximum_degree": F.array_max("_deg"),
            "triangle_count": triangles(F.col("mask"), conditions),
            "transitivity": F.coalesce(ratio(3 * triangles(F.col("mask"), conditions), F.when(paths > 0, paths)), F.lit(0.0)),
        }
    ).drop("_deg", "_comp")


def similarity(graphs: DataFrame, possible: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every unordered pair of graphs of equal keys once (graph_id_a < graph_id_b), with Jaccard and agreement.

    Pairs are of population graphs, whose number is the square of a small dimension; the mirror rows and the
    diagonal of a full table follow from `mirrored`.
    """
    a, b = graphs.alias("a"), graphs.alias("b")
    on = F.col("a.graph_id") < F.col("b.graph_id")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    ma, mb = F.col("a.mask"), F.col("b.mask")
    return a.join(b, on).select(
        *[F.col(f"a.{k}") for k in keys],
        F.col("a.graph_id").alias("graph_id_a"), F.col("b.graph_id").alias("graph_id_b"),
        (F.col("a.geography_code") == F.col("b.geography_code")).alias("same_state"), (F.col("a.ses_category") == F.col("b.ses_category")).alias("same_ses"),
        bits(ma).alias("edges_a"), bits(mb).alias("edges_b"), bits(ma.bitwiseAND(mb)).alias("shared"),
        jaccard(ma, mb).alias("edge_jaccard"), (1 - bits(ma.bitwiseXOR(mb)) / F.lit(possible)).alias("edge_agreement"),
    )


def choose_table(spark: SparkSession, n: int = 45) -> DataFrame:
    """Binomial coefficients up to n: exact in a double."""
    from math import comb

    return spark.createDataFrame([(i, k, float(comb(i, k))) for i in range(n + 1) for k in range(i + 1)], "n int, k int, c double")


def density_null(pairs: DataFrame, possible: int) -> DataFrame:
    """pairs (edges_a, edges_b, edge_jaccard) with the null of the Jaccard index at their numbers of edges.

    Worked out once per distinct (edges, edges, Jaccard) and joined back.
    """
    spark = pairs.sparkSession
    c = F.broadcast(choose_table(spark, possible))
    lo = F.greatest(F.lit(0), F.col("edges_a") + F.col("edges_b") - possible)
    cases = pairs.select("edges_a", "edges_b", "edge_jaccard").distinct().withColumn("i", F.explode(F.sequence(lo, F.least("edges_a", "edges_b"))))
    look = lambda d, n, k, name: d.join(c.select(F.col("n").alias(f"{name}_n"), F.col("k").alias(f"{name}_k"), F.col("c").alias(name)), (n == F.col(f"{name}_n")) & (k == F.col(f"{name}_k"))).drop(f"{name}_n", f"{name}_k")
    cases = look(cases, F.col("edges_a"), F.col("i"), "c1")
    cases = look(cases, F.lit(possible) - F.col("edges_a"), F.col("edges_b") - F.col("i"), "c2")
    cases = look(cases, F.lit(possible), F.col("edges_b"), "c3")
    union = F.col("edges_a") + F.col("edges_b") - F.col("i")
    cases = cases.withColumn("p", F.col("c1") * F.col("c2") / F.col("c3")).withColumn("j", F.when(union > 0, F.col("i") / union).otherwise(1.0))
    null = cases.groupBy("edges_a", "edges_b", "edge_jaccard").agg(
        F.sum(F.col("p") * F.col("j")).alias("null_expected"), F.sum(F.col("p") * F.col("j") * F.col("j")).alias("_m2"),
        F.sum(F.when(F.col("j") >= F.col("edge_jaccard") - 1e-12, F.col("p")).otherwise(0.0)).alias("null_p_upper"),
    )
    var = F.col("_m2") - F.col("null_expected") * F.col("null_expected")
    null = null.withColumn("null_sd", F.sqrt(F.when(var > 1e-14, var).otherwise(0.0))).drop("_m2")
    out = pairs.join(null, ["edges_a", "edges_b", "edge_jaccard"])
    return out.withColumn("density_z", F.when(F.col("null_sd") > 0, (F.col("edge_jaccard") - F.col("null_expected")) / F.col("null_sd"))).withColumn("density_excess", F.col("edge_jaccard") - F.col("null_expected"))


def comparison_type() -> Column:
    return (
        F.when(F.col("same_state") & ~F.col("same_ses"), "within_state_different_ses")
        .when(~F.col("same_state") & F.col("same_ses"), "same_ses_cross_state")
        .when(~F.col("same_state") & ~F.col("same_ses"), "cross_ses_cross_state")
        .otherwise("other")
    )


def similarity_summary(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("comparison_type", comparison_type()).where("comparison_type <> 'other'").groupBy("comparison_type").agg(
        F.count("*").alias("pair_count"), F.avg("edge_jaccard").alias("mean_jaccard"), F.median("edge_jaccard").alias("median_jaccard"),
        F.stddev_samp("edge_jaccard").alias("standard_deviation"), F.min("edge_jaccard").alias("minimum_jaccard"), F.max("edge_jaccard").alias("maximum_jaccard"),
        F.avg("density_z").alias("mean_density_adjusted_z"), F.median("density_z").alias("median_density_adjusted_z"),
    )


def association_correlation(edges: DataFrame) -> DataFrame:
    """Correlation of the associations of every pair of graphs over their common pairs (two or more, both varying)."""
    e = edges.where("association IS NOT NULL").select("graph_id", "source_condition", "target_condition", "association")
    a = e.select(F.col("graph_id").alias("graph_id_a"), "source_condition", "target_condition", F.col("association").alias("x"))
    b = e.select(F.col("graph_id").alias("graph_id_b"), "source_condition", "target_condition", F.col("association").alias("y"))
    both = a.join(b, ["source_condition", "target_condition"]).where("graph_id_a < graph_id_b")
    agg = both.groupBy("graph_id_a", "graph_id_b").agg(F.count("*").alias("common_association_count"), correlation("x", "y").alias("c"))
    ok = F.col("common_association_count") >= 2
    return agg.select("graph_id_a", "graph_id_b", "common_association_count", F.when(ok, F.col("c")).alias("association_correlation"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Each unordered pair in both orders, (graph_id, peer_id)."""
    ab = pairs.select("*", F.col("graph_id_a").alias("graph_id"), F.col("graph_id_b").alias("peer_id"))
    ba = pairs.select("*", F.col("graph_id_b").alias("graph_id"), F.col("graph_id_a").alias("peer_id"))
    return ab.unionByName(ba)


def outlier_scores(graphs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarity of each graph to those of its category, and how far it is from their median in MADs."""
    same = mirrored(pairs.where("same_ses")).groupBy("graph_id").agg(
        F.avg("edge_jaccard").alias("mean_same_ses_jaccard"), F.median("edge_jaccard").alias("median_same_ses_jaccard"),
        # a null z of one peer makes the mean unknown
        F.when(F.count_if(F.col("density_z").isNull()) == 0, F.avg("density_z")).alias("mean_same_ses_density_adjusted_z"),
    )
    out = graphs.select("graph_id", "geography_code", "ses_category", bits("mask").alias("edge_count")).join(same, "graph_id", "left")
    for value, name in (("mean_same_ses_jaccard", "robust_similarity_z"), ("mean_same_ses_density_adjusted_z", "robust_density_adjusted_similarity_z")):
        w = Window.partitionBy("ses_category")
        out = out.withColumn("_m", F.median(value).over(w)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
        out = out.withColumn("_s", F.median("_d").over(w))
        out = out.withColumn(name, F.when(F.col("_s") > 0, MAD_SCALE * (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_d", "_s")
    return out


def edge_support(edges: DataFrame, keys: tuple[str, ...] = ("rule_id",)) -> DataFrame:
    """Graphs that have each pair as an edge; pairs without support stay."""
    out = edges.groupBy(*keys, "source_condition", "target_condition").agg(F.count("*").alias("graph_count"), F.count_if("edge_present").alias("support_count"))
    return out.withColumn("support_fraction", ratio(F.col("support_count"), F.col("graph_count")))


def transitions(graphs: DataFrame, rules: dict[str, float], conditions: list[str] = CONDITIONS) -> DataFrame:
    """graphs (graph_id, rule_id, mask): how each graph changes from a threshold to a higher one."""
    order = sorted(rules.items(), key=lambda x: x[1])
    steps = [(*order[i], *order[i + 1], "adjacent") for i in range(len(order) - 1)] + [(*order[0], *order[-1], "outer")] * (len(order) > 2)
    table = graphs.sparkSession.createDataFrame(steps, "from_rule_id string, from_threshold double, to_rule_id string, to_threshold double, transition_type string")
    st = statistics(graphs, None, conditions).select("graph_id", "geography_code", "ses_category", "rule_id", "mask", "component_count", "isolate_count")
    a = st.select("graph_id", "geography_code", "ses_category", F.col("rule_id").alias("from_rule_id"), F.col("mask").alias("m1"), F.col("component_count").alias("c1"), F.col("isolate_count").alias("i1"))
    b = st.select("graph_id", F.col("rule_id").alias("to_rule_id"), F.col("mask").alias("m2"), F.col("component_count").alias("c2"), F.col("isolate_count").alias("i2"))
    df = a.join(F.broadcast(table), "from_rule_id").join(b, ["graph_id", "to_rule_id"])
    m1, m2 = F.col("m1"), F.col("m2")
    out = df.select(
        "graph_id", "geography_code", "ses_category", "transition_type", "from_rule_id", "to_rule_id", "from_threshold", "to_threshold",
        bits(m1).alias("from_edge_count"), bits(m2).alias("to_edge_count"), bits(m1.bitwiseXOR(m1.bitwiseAND(m2))).alias("edges_removed"),
        F.when(bits(m1) == 0, 1.0).otherwise(bits(m1.bitwiseAND(m2)) / bits(m1)).alias("edge_retention_fraction"),
        jaccard(m1, m2).alias("edge_jaccard"), (m1.bitwiseAND(m2) == m2).alias("nested"),
        (F.col("c2") - F.col("c1")).alias("component_count_change"), (F.col("i2") - F.col("i1")).alias("isolate_count_change"),
        degrees(m1, conditions).alias("_d1"), degrees(m2, conditions).alias("_d2"),
    )
    keys = ["graph_id", "from_rule_id", "to_rule_id"]
    long = out.select(*keys, F.posexplode(F.arrays_zip("_d1", "_d2")).alias("node", "d"))
    long = long.select(*keys, average_rank(F.col("d._d1"), keys).alias("r1"), average_rank(F.col("d._d2"), keys).alias("r2"))
    rho = long.groupBy(*keys).agg(correlation("r1", "r2").alias("degree_spearman"))
    return out.drop("_d1", "_d2").join(rho, keys)


def transition_summary(steps: DataFrame) -> DataFrame:
    return steps.groupBy("transition_type", "from_rule_id", "to_rule_id", "from_threshold", "to_threshold").agg(
        F.count("*").alias("graph_count"), F.median("edge_jaccard").alias("median_edge_jaccard"), F.min("edge_jaccard").alias("minimum_edge_jaccard"),
        F.percentile("edge_jaccard", 0.1).alias("q10_edge_jaccard"), F.avg((F.col("edge_jaccard") < 0.5).cast("int")).alias("fraction_edge_jaccard_below_050"),
        F.median("edges_removed").alias("median_edges_removed"), F.sum("edges_removed").alias("total_edges_removed"),
        F.median("degree_spearman").alias("median_degree_spearman"), F.avg((F.col("component_count_change") != 0).cast("int")).alias("fraction_component_count_changed"),
        F.bool_and("nested").alias("all_graphs_nested"),
    )


def calibration_summary(stats: DataFrame, low: int, high: int, dense: float) -> DataFrame:
    return stats.groupBy("rule_id").agg(
        F.count("*").alias("graph_count"), F.min("edge_count").alias("edge_count_minimum"), F.median("edge_count").alias("edge_count_median"), F.max("edge_count").alias("edge_count_maximum"),
        F.min("density").alias("density_minimum"), F.median("density").alias("density_median"), F.max("density").alias("density_maximum"),
        F.avg(F.col("edge_count").between(low, high).cast("int")).alias("fraction_in_preferred_edge_range"), F.count_if(F.col("density") >= dense).alias("high_density_graph_count"),
        F.median("edge_count").between(low, high).alias("median_edge_target_met"), (F.max("density") < dense).alias("maximum_density_target_met"),
    )
