"""Frequent connected motifs of association graphs, as edge masks.

Node labels are unique in a graph, so a motif occurs in a graph exactly if the graph's mask contains the
motif's. All connected patterns of 3 to 5 of k conditions are listed once a worker (191,916 for k = 10: a fixed
number, whatever the data), cut down to pairs that are frequent by themselves, and tested as one array against
the distinct graph masks, with the number of graphs that have each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.functions.columns import contains, ratio
from affinis.operators.graphs import pairs_of
from affinis.operators.tables import settle
from affinis.sources.bridge import CONDITIONS

FRACTIONS = (0.10, 0.20, 0.30)


@lru_cache
def templates(k: int) -> list[int]:
    """Edge subsets (over the pairs of 0..k-1) that connect all k nodes."""
    edges = list(combinations(range(k), 2))
    found = []
    for mask in range(1 << len(edges)):
        reached, grown = {0}, True
        while grown:
            more = {y for i, e in enumerate(edges) if mask >> i & 1 for x, y in (e, e[::-1]) if x in reached} - reached
            reached |= more
            grown = bool(more)
        if len(reached) == k:
            found.append(mask)
    return found


@lru_cache
def pattern_arrays(sizes: tuple[int, ...], conditions: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask, node_count, edge_count) of every connected pattern of `sizes` conditions, one row each."""
    at = {e: i for i, e in enumerate(pairs_of(conditions))}
    found = []
    for k in sizes:
        shapes = np.array(templates(k), np.int64)
        drawn = (shapes[:, None] >> np.arange(k * (k - 1) // 2)) & 1
        for nodes in combinations(sorted(conditions), k):
            bits_ = np.array([1 << at[e] for e in combinations(nodes, 2)], np.int64)
            found.append((drawn @ bits_, np.full(len(shapes), k, np.int32), drawn.sum(axis=1).astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def connected_masks(spark: SparkSession, sizes: tuple[int, ...] = (3, 4, 5), conditions: list[str] = CONDITIONS) -> DataFrame:
    """(mask, node_count, edge_count) of every connected pattern."""
    return spark.createDataFrame(pa.table(dict(zip(("mask", "node_count", "edge_count"), pattern_arrays(tuple(sizes), tuple(conditions)), strict=True))))


def support_thresholds(n: int, fractions: tuple[float, ...] = FRACTIONS) -> dict[float, int]:
    from math import ceil

    return {f: ceil(f * n) for f in fractions}


def _supported(masks: np.ndarray, n: np.ndarray, floor: int, sizes: tuple[int, ...], conditions: tuple[str, ...], common: int) -> tuple[np.ndarray, ...]:
    """(mask, node_count, edge_count, support) of the patterns within `common` that masks (n graphs each) hold `floor` times."""
    patterns = pattern_arrays(sizes, conditions)
    inside = np.flatnonzero((patterns[0] & ~np.int64(common)) == 0)
    mask, support = patterns[0][inside], np.zeros(len(inside), np.int64)
    masks, at = np.unique(masks & np.int64(common), return_inverse=True)
    for m, times in zip(masks, np.bincount(at, weights=n).astype(np.int64), strict=True):
        support += times * ((mask & m) == mask)
    keep = support >= floor
    return mask[keep], *(x[inside[keep]] for x in patterns[1:]), support[keep]


def frequent(graphs: DataFrame, floor: int, keys: tuple[str, ...] = (), sizes: tuple[int, ...] = (3, 4, 5), conditions: list[str] = CONDITIONS) -> DataFrame:
    """(keys, mask, node_count, edge_count, support_count) of patterns in at least `floor` graphs of a key.

    graphs: keys and mask. Equal masks are counted once with their number; patterns with a pair that is in
    fewer than `floor` graphs of a key are dropped before the containment test (support only falls). Without
    keys the masks may be spread over tasks, whose counts are added up; with keys each key, a replicate of the
    populations, is one group.
    """
    sizes, names = tuple(sizes), tuple(conditions)
    pair_bits = [1 << i for i in range(len(pairs_of(conditions)))]
    distinct = graphs.groupBy(*keys, "mask").agg(F.count("*").alias("n"))
    out = "mask long, node_count int, edge_count int, support_count long"
    if keys:

        def mine_key(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
            masks, n = df["mask"].to_numpy(np.int64), df["n"].to_numpy(np.int64)
            common = sum(b for b in pair_bits if n[(masks & b) != 0].sum() >= floor)
            cols = _supported(masks, n, floor, sizes, names, common)
            return pd.DataFrame(dict(zip((*keys, "mask", "node_count", "edge_count", "support_count"), (*key, *cols), strict=True)), columns=[*keys, "mask", "node_count", "edge_count", "support_count"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.select(*keys).schema)
        return distinct.groupBy(*keys).applyInPandas(mine_key, f"{kinds}, {out}")
    bits_ = F.array(*[F.lit(b).cast("long") for b in pair_bits])
    common = distinct.select("n", F.explode(F.filter(bits_, lambda b: F.col("mask").bitwiseAND(b) != 0)).alias("bit"))
    common = common.groupBy("bit").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).agg(F.coalesce(F.bit_or("bit"), F.lit(0).cast("long")).alias("common"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = _supported(b.column(0).to_numpy(), b.column(1).to_numpy(), 1, sizes, names, b.column(2)[0].as_py())
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["mask", "node_count", "edge_count", "support_count"])

    counts = distinct.select("mask", "n").crossJoin(F.broadcast(common)).mapInArrow(count, out)
    return counts.groupBy("mask", "node_count", "edge_count").agg(F.sum("support_count").alias("support_count")).where(F.col("support_count") >= floor)


def grown(graphs: DataFrame, floor: int, nodes: tuple[int, int] = (3, 5)) -> DataFrame:
    """(edges, node_count, edge_count, support_count): connected motifs of any number of conditions, by growth.

    graphs: graph_id and edges, array<struct<a,b>> with a < b. Level by level, patterns that at least `floor` graphs hold
    get one more frequent edge that touches them. A pattern is the sorted list of its edges, so whichever way it
    was grown it is one row; it carries the graphs that hold it as bits in an array of longs, and a grown one's are
    its bits and the edge's. Graphs are populations and edges pairs of conditions, both dimensions: the edges'
    table is the broadcast side. Every connected pattern is met, as taking away the right edge leaves one, which is
    as frequent. Repeated edges of a graph count once.
    """
    numbered = settle(graphs.select(F.array_distinct("edges").alias("edges"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("graph_id")) - 1).alias("g")))
    words = -(-max(1, numbered.count()) // 64)
    bit = F.expr("shiftleft(1L, CAST(g % 64 AS INT))")
    cells = numbered.select("g", F.explode("edges").alias("e")).select("e.a", "e.b", F.floor(F.col("g") / 64).alias("word"), bit.alias("bit")).groupBy("a", "b", "word").agg(F.bit_or("bit").alias("bits"))
    table = cells.groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    held = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0).cast("long")))
    support = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + F.bit_count(x))
    edges = settle(table.select("a", "b", held.alias("held")).where(support("held") >= floor))
    level = edges.select(F.array(F.struct("a", "b")).alias("edges"), F.array("a", "b").alias("nodes"), "held")
    found = []
    step = F.broadcast(edges.select("a", "b", F.col("held").alias("more")))
    for _ in range(nodes[1] * (nodes[1] - 1) // 2 - 1):
        touches = F.array_contains("nodes", F.col("a")) | F.array_contains("nodes", F.col("b"))
        wider = level.join(step, touches & ~F.array_contains("edges", F.struct("a", "b")))
        wider = wider.select(F.array_sort(F.concat("edges", F.array(F.struct("a", "b")))).alias("edges"), F.array_union("nodes", F.array("a", "b")).alias("nodes"), F.zip_with("held", "more", lambda x, y: x.bitwiseAND(y)).alias("held"))
        wider = wider.where((F.size("nodes") <= nodes[1]) & (support("held") >= floor))
        level = settle(wider.groupBy("edges").agg(F.first("nodes").alias("nodes"), F.first("held").alias("held")))
        if level.isEmpty():
            break
        found.append(level)
    out = found[0] if found else level.limit(0)
    for f in found[1:]:
        out = out.union(f)
    return out.where(F.size("nodes") >= nodes[0]).select("edges", F.size("nodes").alias("node_count"), F.size("edges").alias("edge_count"), support("held").alias("support_count"))


def state_pairs(graphs: DataFrame) -> DataFrame:
    """One row per state with both graphs: lower/higher masks, and pairs eligible in both; raises on doubled graphs when run."""
    pick = lambda cat, col: F.max(F.when(F.col("ses_category") == cat, F.col(col)))
    df = graphs.groupBy("geography_code").agg(
        pick("lower", "mask").alias("lower"), pick("higher", "mask").alias("higher"), pick("lower", "opportunity").alias("o1"), pick("higher", "opportunity").alias("o2"),
        F.count("*").alias("n"), F.max(F.when(F.col("ses_category") == "lower", F.col("graph_id"))).alias("lower_id"), F.max(F.when(F.col("ses_category") == "higher", F.col("graph_id"))).alias("higher_id"),
    )
    broken = (F.col("n") != 2) | F.col("lower").isNull() | F.col("higher").isNull()
    return df.select("geography_code", F.when(broken, F.raise_error(F.lit("a state lacks one lower and one higher graph")).cast("long")).otherwise(F.col("lower")).alias("lower"), "higher", F.col("o1").bitwiseAND(F.col("o2")).alias("opportunity"), "lower_id", "higher_id", F.col("o1").alias("lower_opportunity"), F.col("o2").alias("higher_opportunity"))


def evaluability(pairs: DataFrame, motifs: DataFrame) -> DataFrame:
    """motifs with the number of states where all their pairs are eligible in both graphs, and occurrences there."""
    m = F.col("mask")
    lo, hi = contains(F.col("lower"), m), contains(F.col("higher"), m)
    hits = pairs.join(F.broadcast(motifs), contains(F.col("opportunity"), m))
    return hits.groupBy(*motifs.columns).agg(
        F.count("*").alias("paired_state_count"),
        F.sum(lo.cast("int") + hi.cast("int")).alias("support_count"),
        F.count_if(lo | hi).alias("distinct_state_support_count"),
        F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array(F.when(lo, F.col("lower_id")), F.when(hi, F.col("higher_id"))))))).alias("graph_ids"),
    )


def annotated(found: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """Denominators, thresholds ceil(fraction * graphs) and support flags from the counts of evaluability()."""
    n = 2 * F.col("paired_state_count")
    out = found.withColumn("evaluable_graph_count", n).withColumn("support_fraction", F.coalesce(ratio(F.col("support_count"), n), F.lit(0.0)))
    for f in fractions:
        name = f"{round(f * 100):02d}pct"
        limit = F.ceil(F.lit(f) * n)
        out = out.withColumn(f"support_count_{name}", limit).withColumn(f"support_{name}", F.col("support_count") >= limit)
    return out


def mine(graphs: DataFrame, minimum_states: int, fractions: tuple[float, ...] = FRACTIONS, conditions: list[str] = CONDITIONS) -> DataFrame:
    """The motif catalog with opportunity-aware support.

    graphs: paired populations with mask and opportunity. Candidates have the support that the smallest
    fraction needs in the smallest admissible number of states, so none with enough support is missed.
    """
    from math import ceil

    floor = max(1, ceil(min(fractions) * 2 * minimum_states))
    motifs = frequent(graphs.select("mask"), floor, (), (3, 4, 5), conditions).select("mask", "node_count", "edge_count")
    out = annotated(evaluability(state_pairs(graphs), motifs), fractions)
    return out.where((F.col("paired_state_count") >= minimum_states) & F.col(f"support_{round(min(fractions) * 100):02d}pct"))


def shape(catalog: DataFrame) -> DataFrame:
    full = F.col("node_count") * (F.col("node_count") - 1) / 2
    return catalog.withColumns({"motif_density": F.col("edge_count") / full, "is_tree": F.col("edge_count") == F.col("node_count") - 1, "is_clique": F.col("edge_count") == full})


def motif_edges(mask: Column, conditions: list[str] = CONDITIONS) -> Column:
    """The pairs of a mask in order: array of [a, b]."""
    table = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.array(F.lit(a), F.lit(b)).alias("e")) for i, (a, b) in enumerate(pairs_of(conditions))])
    return F.transform(F.filter(table, lambda x: mask.bitwiseAND(x["bit"]) != 0), lambda x: x["e"])


def motif_id(edges: Column) -> Column:
    """motif_ and 16 hex digits of SHA-256 over the compact JSON of sorted edges and nodes."""
    nodes = F.array_sort(F.array_distinct(F.flatten(edges)))
    text = F.concat(F.lit('{"edges":'), F.to_json(edges), F.lit(',"nodes":'), F.to_json(nodes), F.lit("}"))
    return F.concat(F.lit("motif_"), F.substring(F.sha2(text, 256), 1, 16))


def named(catalog: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    edges = motif_edges(F.col("mask"), conditions)
    return catalog.withColumn("motif_id", motif_id(edges)).withColumn("edge_list", F.to_json(edges)).withColumn("node_labels", F.to_json(F.array_sort(F.array_distinct(F.flatten(edges)))))


def submasks(mask: Column, width: int) -> Column:
    """All masks within a mask, itself and none included: 2^edges of them (1,024 at most for five conditions)."""
    bits_ = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(width)]), lambda b: mask.bitwiseAND(b) != 0)
    return F.aggregate(bits_, F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.transform(acc, lambda x: x.bitwiseOR(b))))


def redundancy(catalog: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    """Occurrence classes (equal graph lists), closed and maximal flags, one representative a class.

    A motif is maximal if no other of the catalog contains it, closed if none of its class does. Every motif lists
    the masks within it, which are joined to the catalog by hash: the work is motifs x 2^edges, not motifs x motifs.
    One-edge extensions alone wouldn't do: thresholds depend on the states where a motif is evaluable, so a motif
    between two of the catalog may itself be missing.
    """
    ids = F.concat(F.lit("occ_"), F.substring(F.sha2(F.to_json("graph_ids"), 256), 1, 16))
    c = catalog.withColumn("occurrence_class_id", ids)
    w = Window.partitionBy("occurrence_class_id")
    first = F.row_number().over(w.orderBy(F.desc("node_count"), F.desc("edge_count"), "motif_id")) == 1
    c = c.withColumn("occurrence_class_size", F.count("*").over(w)).withColumn("is_occurrence_representative", first)
    inner = catalog.select(F.col("mask").alias("m2"), ids.alias("c2")).select("m2", "c2", F.explode(submasks(F.col("m2"), len(pairs_of(conditions)))).alias("mask")).where("mask <> m2 AND bit_count(mask) >= 2")
    inner = inner.groupBy("mask").agg(F.collect_set("c2").alias("_above"))
    out = c.join(inner, "mask", "left")
    closed = ~F.coalesce(F.array_contains("_above", F.col("occurrence_class_id")), F.lit(False))
    return out.withColumn("is_closed", closed).withColumn("is_maximal", F.col("_above").isNull()).drop("_above")


def shape_summary(catalog: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """Counts and shapes by support level and size."""
    names = [f"support_{round(f * 100):02d}pct" for f in fractions]
    level = F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names])))
    return shape(catalog).withColumn("support_level", level).groupBy("support_level", "node_count").agg(
        F.count("*").alias("motif_count"), F.count_if("is_closed").alias("closed_motif_count"), F.count_if("is_maximal").alias("maximal_motif_count"),
        F.count_distinct("occurrence_class_id").alias("occurrence_class_count"), F.avg(F.col("is_tree").cast("int")).alias("tree_fraction"), F.avg(F.col("is_clique").cast("int")).alias("clique_fraction"),
        F.median("edge_count").alias("median_edge_count"), F.median("motif_density").alias("median_motif_density"),
    )


def occurrences(graphs: DataFrame, motifs: DataFrame) -> DataFrame:
    """Long (graph..., motif columns) rows where a motif is in a graph; graphs may be many, motifs are a bounded catalog."""
    m = motifs.withColumnRenamed("mask", "motif_mask")
    return graphs.join(F.broadcast(m), contains(F.col("mask"), F.col("motif_mask")))


def swapped(graphs: DataFrame) -> DataFrame:
    """The two graphs of each state with their categories exchanged."""
    return graphs.withColumn("ses_category", F.when(F.col("ses_category") == "lower", "higher").otherwise("lower"))


def database_lines(graphs: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    """(graph_idx, graph_id, block): a graph database in t / v / e lines, graphs in order of their ids."""
    names = sorted(conditions)
    at = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    nodes = F.lit("\n".join(f"v {i} {i + 1}" for i in range(len(names))))
    edge_lines = F.transform(motif_edges(F.col("mask"), conditions), lambda e: F.concat_ws(" ", F.lit("e"), F.element_at(at, F.get(e, 0)).cast("string"), F.element_at(at, F.get(e, 1)).cast("string"), F.lit("1")))
    # the number of graphs is that of populations: a dimension, numbered in one window
    idx = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("graph_id")) - 1
    head = F.concat(F.lit("t # "), F.col("graph_idx").cast("string"))
    return graphs.select("graph_id", "mask", idx.alias("graph_idx")).select("graph_idx", "graph_id", F.array_join(F.concat(F.array(head, nodes), edge_lines), "\n").alias("block"))


