"""SimHash near-duplicates by a binary-trie self-join (operator 10).

A fingerprint's bit is set where over half of the document's shingle hashes (XXH64, seed 42, of four
lower-cased words) set it. Fingerprints link at `budget` or fewer differing bits; components of links
are classes of near-duplicates.

1. Documents are hashed in Arrow batches; equal fingerprints are reduced to one row, with the smallest
   doc_id, before anything is compared.
2. The 64 bits are cut into budget + 2 blocks: two linked fingerprints agree on two blocks at least. Each
   fingerprint goes to one bucket per pair of blocks, 2^20 to 2^22 buckets a pair. Buckets above `chunk` fingerprints are cut into chunks and
   dealt as pairs of chunks, so that none lands in one task whole.
3. In each bucket the fingerprints form a binary trie, walked by pairs of nodes four bits at a time: pairs
   carry their differing bits and end as soon as these exceed the budget. Work is kept on a stack of
   bounded slices. A bucket emits the edges of a spanning forest, not its pairs: n - 1 rows for n members.
4. Forests of all buckets are joined into components by large-star/small-star rounds on DataFrames, with
   the edges cut (checkpointed) every round; nothing is collected.

Defined results: null or empty text has no shingle, hence fingerprint zero, linked like any other; fewer
than four words make one shingle; very long texts are hashed whole; repeated rows fall into one component; rows
with a null doc_id link like others but never name a component (null where no member has an id), and
`deduplicate` keeps them. A document is a doc_id and a text: rows of one doc_id with texts of different classes stay or
go apart, of texts of one class one stays, rows equal in both stay together. An empty table gives no rows; `classes`
ignores other columns, `deduplicate` passes them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import cut

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Fingerprints of a bucket that one task compares with as many others at once.
CHUNK = 20_000
#: Node pairs held at once while a trie is walked.
SLICE = 200_000
STREAM_ROWS = 50_000
EDGES_A_FILE = 1 << 20
#: Buckets above a chunk whose list may be broadcast (16 bytes each); a longer list is joined by shuffle.
BROADCAST_BUCKETS = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    ws = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII alone
    if not ws:
        return 0
    ends, at = [], 0
    for w in ws:
        at += len(w) + 1
        ends.append(at)
    line, h = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        hs = [h(line, SEED)]
    else:
        hs = [h(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)]
    bits = np.zeros(64, np.int64)
    for a in range(0, len(hs), 65536):
        part = np.array(hs[a : a + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hs)).tobytes(), "big")


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(x.as_py()) for x in b.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(prints)], ["doc_id", "tag", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, fp): tag is the text's hash, fp the fingerprint as a signed long."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(_hash_batches, "doc_id long, tag long, fp long")


def blocks(budget: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of budget + 2 blocks of the 64 bits."""
    n = budget + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)


def linked(group: np.ndarray, side: np.ndarray, fp: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) of a forest that spans the linked fingerprints within each group.

    side 1 and 2 of a group are compared with each other only, side 0 within itself.
    """
    order = np.lexsort((fp, side, group))
    g, s, f = group[order], side[order], fp[order]
    n, forest = len(f), _Forest(len(f))
    if n < 2:
        return np.array([], int), np.array([], int)
    levels = [np.zeros(n, np.int64)]  # the node of each fingerprint, level by level; level 0: group and side
    levels[0][1:] = np.cumsum((g[1:] != g[:-1]) | (s[1:] != s[:-1]))
    digits = [((f >> np.uint64(60 - 4 * k)) & np.uint64(15)).astype(np.uint8) for k in range(16)]
    for k in range(16):
        new = np.zeros(n, bool)
        new[1:] = (levels[-1][1:] != levels[-1][:-1]) | (digits[k][1:] != digits[k][:-1])
        levels.append(np.cumsum(new))
    first = [np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) for v in levels]  # first fingerprint of each node
    child = [np.searchsorted(first[k + 1], np.r_[first[k], n]) for k in range(16)]  # children of node i: child[i]..child[i+1]
    pop = np.array([bin(i).count("1") for i in range(16)], np.int8)
    roots = np.arange(len(first[0]))
    alone = s[first[0]] == 0
    two = np.flatnonzero((s[first[0]][:-1] == 1) & (s[first[0]][1:] == 2) & (g[first[0]][:-1] == g[first[0]][1:]))
    stack = [(0, np.r_[roots[alone], two], np.r_[roots[alone], two + 1], np.zeros(alone.sum() + len(two), np.int8))]
    while stack:
        k, a, b, diff = stack.pop()
        if not len(a):
            continue
        if len(a) > SLICE:
            stack += [(k, a[i : i + SLICE], b[i : i + SLICE], diff[i : i + SLICE]) for i in range(0, len(a), SLICE)]
            continue
        if k == 16:
            i, j = first[16][a], first[16][b]
            rest = forest.up[i] != forest.up[j]
            forest.join(i[rest], j[rest])
            continue
        na, nb = child[k][a + 1] - child[k][a], child[k][b + 1] - child[k][b]
        each = na * nb
        at = np.repeat(np.arange(len(a)), each)
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        x, y = child[k][a][at] + nth // nb[at], child[k][b][at] + nth % nb[at]
        own = a[at] == b[at]
        d = diff[at] + pop[digits[k][first[k + 1][x]] ^ digits[k][first[k + 1][y]]]
        stay = (d <= budget) & (~own | (x <= y))
        stack.append((k + 1, x[stay], y[stay], d[stay]))
    up = np.array([forest.root(i) for i in range(n)])
    later = np.flatnonzero(up != np.arange(n))
    return order[later], order[up[later]]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, side, fp) sorted by bucket; whole buckets are gathered and walked together."""
    held: list[np.ndarray] = []

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        a, b = linked(rows[0], rows[1], rows[2].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(rows[2][a]), pa.array(rows[2][b])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]))
        rows = held[0] if len(held) == 1 else np.concatenate(held, axis=1)
        held = [rows]
        last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
        if last >= STREAM_ROWS:
            yield edges(rows[:, :last])
            held = [rows[:, last:]]
    if held:
        yield edges(np.concatenate(held, axis=1))


def forest_edges(prints: DataFrame, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """(a, b): edges that span the linked distinct fingerprints of each bucket."""
    parts = [(F.shiftrightunsigned("fp", lo).bitwiseAND((1 << width) - 1), width) for lo, width in blocks(budget)]
    pairs = [F.shiftleft(x, m).bitwiseOR(y) for (x, _), (y, m) in combinations(parts, 2)]
    top = 2 * max(width for _, width in parts)  # bits of the widest key; pairs and keys are told apart above and below it
    buckets = F.array(*[F.lit(i << top).bitwiseOR(key) for i, key in enumerate(pairs)])
    dealt = prints.select("fp", F.explode(buckets).alias("bucket"))
    large = cut(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("bucket", F.ceil(F.col("n") / chunk).cast("int").alias("c")))
    large = F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large
    dealt = dealt.join(large, "bucket", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), "c").cast("int")).select("fp", "bucket", "c", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    task = F.col("bucket") * F.lit(1 << 30) + lo * F.lit(1 << 15) + hi
    rows = dealt.select(task.alias("bucket"), side.cast("long").alias("side"), "fp")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_walk, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge: root is the smallest node it can reach.

    Alternating large-star and small-star rounds; a round's edges are cut off from the one before. The
    smallest neighbour of each node is found by an aggregate (combined on the map side) and then joined to
    its edges, so a hub's edges may be split over tasks. A round's tables are written in as few files as
    EDGES_A_FILE rows each allow.
    """

    def kept(rows: DataFrame, most: int) -> DataFrame:
        return cut(rows.coalesce(max(1, -(-most // EDGES_A_FILE))))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
        out = both.join(least, "u")
        out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if large else out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return out.where("a <> b").distinct()

    e = cut(edges.where("a <> b").distinct())
    n = e.count()
    stamp = None
    while True:
        e = kept(star(kept(star(e, True), 2 * n), False), 2 * n)  # no round adds edges beyond these
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == stamp:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        stamp = now


def _rooted(docs: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, fp) of every row, and (fp, first, root) of every fingerprint: its smallest document, and its class."""
    prints = cut(fingerprints(docs))
    least = cut(prints.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tag"))).alias("first")))
    roots = cut(components(forest_edges(least.select("fp"), budget)))
    return prints, least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id of the class."""
    prints, named = _rooted(docs, budget)
    ids = cut(named.groupBy("root").agg(F.min("first.doc_id").alias("component_id")))
    named = cut(named.join(ids, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """docs with one document of each class: the one of the smallest doc_id (and then of the smallest hash of its text)."""
    first = _rooted(docs.select("doc_id", "text"), budget)[1].groupBy("root").agg(F.min("first").alias("first")).where("first IS NOT NULL")
    stays = cut(first.select(F.col("first.doc_id").alias("stay_id"), F.col("first.tag").alias("stay_tag")))
    own = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)])
    doc, text = (F.col(f"in_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    kept = own.join(stays, (doc == F.col("stay_id")) & (F.xxhash64(text) == F.col("stay_tag")), "left").where(doc.isNull() | F.col("stay_id").isNotNull())
    return kept.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])
