"""Exact top-k search by MaxScore (operator 1).

Items are vectors of integer weights; dimensions are the terms, and a term's postings are the weights of
a shard's items on it. A query term can add at most upper(term) = max(q * largest, q * smallest weight) to
a score. Per shard and query, terms are put in order of the spread of what they may add; the last ones
whose upper bounds, added up, can't lift an item over the k-th best score so far are non-essential. The
postings of essential terms are traversed whole; the others are probed one by one, only for items that
stay competitive, meaning that their partial score plus the bounds of the terms left reaches the k-th best
score. Equal scores stay in, so ties are exact. The k-th best score rises from block to block of a shard.
Shards (partitions) return their k best per query; these are merged by score, then smaller id.

Queries are taken in blocks of at most QUERY_BLOCK by hash; each block is broadcast (a size bounded by
that number) and meets all items; only k rows per query and shard are shuffled.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows
with a null id; a component or one of the k best scores that doesn't fit a long is an error; vectors of
different lengths are compared as if padded with zeros; repeated items are items of their own; equal query
rows count once, query rows of one id with different vectors get one merged list; items of the query's id
are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import cut

QUERY_BLOCK = 4096
#: Items whose postings are held at once.
SHARD_BLOCK = 4096
#: Non-essential terms probed between two prunings.
STEP = 4


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector can't take part; an error beyond a long."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    large = F.raise_error(F.lit("a component does not fit a long")).cast("long")
    whole = lambda y: F.when(F.abs(y) < F.lit(2.0**63), F.floor(y).cast("long")).otherwise(large)
    return F.when(fit, F.transform(x, lambda v: whole(v * F.lit(float(scale)))))


class Queries:
    """A block of queries: ids and one row of weights each."""

    def __init__(self, ids: list[int], vectors: list[list[int]]):
        self.ids = np.array(ids, np.int64)
        self.weights = padded(vectors)


def largest(a: np.ndarray) -> float:
    return max(float(a.max(initial=0)), -float(a.min(initial=0)))


def padded(vectors: list[list[int]], width: int = 0) -> np.ndarray:
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search_block(q: np.ndarray, q_id: int, ids: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The k best (-score, id) of `best` and a block of items; postings[d] are the items' weights on term d."""
    a, b = q * low, q * high
    upper = np.maximum(a, b)
    order = np.argsort(-np.abs(a - b), kind="stable")
    after = np.r_[np.cumsum(upper[order][::-1])[::-1], 0]  # what the terms from a place on can add at most
    threshold = -best[-1][0] if len(best) >= k else None
    if threshold is not None and after[0] < threshold:
        return best
    alive = np.flatnonzero(ids != q_id)
    if threshold is None:
        # no bar yet: the first items set it
        seed = alive[: 4 * k]
        scores = q @ postings[:, seed]
        best = sorted([*best, *zip((-scores).tolist(), ids[seed].tolist(), strict=True)])[:k]
        alive = alive[4 * k :]
        threshold = -best[-1][0] if len(best) >= k else None
    # essential terms: those before the place from which the terms' bounds alone stay below the bar
    below = np.flatnonzero(after < threshold) if threshold is not None else []
    essential = int(below[0]) if len(below) else len(order)
    first = np.zeros_like(q)
    first[order[:essential]] = q[order[:essential]]
    partial = (first @ postings)[alive]  # whole postings, so no copy of them is made
    at = essential
    while True:
        if threshold is not None:
            stay = partial + after[at] >= threshold
            alive, partial = alive[stay], partial[stay]
        if at >= len(order) or not len(alive):
            break
        # probe the next terms, for competitive items only
        terms = order[at : at + STEP]
        partial = partial + q[terms] @ postings[np.ix_(terms, alive)]
        at += len(terms)
    if len(alive) > 4 * k:
        bar = np.partition(partial, len(partial) - k)[len(partial) - k]
        keep = partial >= bar
        alive, partial = alive[keep], partial[keep]
    return sorted([*best, *zip((-partial).tolist(), ids[alive].tolist(), strict=True)])[:k]


def _search(shipped, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[list[int]]]]:
        for batch in batches:
            for i in range(0, batch.num_rows, SHARD_BLOCK):
                b = batch.slice(i, SHARD_BLOCK)
                yield b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs: Queries = shipped.value
        best: list[list[tuple[int, int]]] = [[] for _ in qs.ids]
        for ids, vectors in blocks(batches):
            items = padded(vectors, qs.weights.shape[1])
            weights = qs.weights if qs.weights.shape[1] == items.shape[1] else np.pad(qs.weights, ((0, 0), (0, items.shape[1] - qs.weights.shape[1])))
            low, high = items.min(axis=0), items.max(axis=0)
            # doubles hold the sums exactly below 2^53, and are multiplied faster; beyond that, integers
            size = largest(items) * largest(weights) * items.shape[1]
            kind = np.float64 if size < 2.0**52 else np.int64 if size < 2.0**62 else object
            postings = np.ascontiguousarray(items.T.astype(kind))
            weights, low, high = weights.astype(kind), low.astype(kind), high.astype(kind)
            for j, q_id in enumerate(qs.ids.tolist()):
                best[j] = search_block(weights[j], q_id, ids, postings, low, high, k, best[j])
        rows = [(q, v, -int(s)) for q, found in zip(qs.ids.tolist(), best, strict=True) for s, v in found]
        q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """queries and items: (vec_id, weights array<long>). Returns (query_id, rank, vec_id, score)."""
    spark = items.sparkSession
    queries = cut(queries.where("weights IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "weights").distinct())
    items = items.where("weights IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "weights")
    n_blocks = max(1, -(-queries.count() // (QUERY_BLOCK * 3 // 4)))  # three quarters full on average
    parts = []
    for block in range(n_blocks):
        # one block of queries, bounded, at a time on the driver
        rows = queries.where(F.pmod(F.xxhash64("vec_id", "weights"), F.lit(n_blocks)) == block).orderBy("vec_id", "weights").collect()
        shipped = spark.sparkContext.broadcast(Queries([r.vec_id for r in rows], [r.weights for r in rows]))
        part = items.mapInArrow(_search(shipped, k), "query_id long, vec_id long, score long")
        parts.append(part if n_blocks == 1 else cut(part))
        if n_blocks > 1:
            shipped.unpersist()
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
