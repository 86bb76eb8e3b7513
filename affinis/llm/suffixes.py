"""Suffix-array dedup with sparse suffixes (operator 6): passages of `size` words or more found twice.

1. Suffixes are kept at minimiser positions only: the place of the smallest hash of a GRAM-word gram in
   each run of WINDOW grams, chosen by content, so that copies of a passage keep suffixes at equal places.
   Any `size` words hold at least one such place.
2. A match of `size` words around a place has half of them right of it, or half left of it. So a suffix is
   keyed by the hash of the nearest half right of its place, and once more by the half left of it. Keys
   found once are dropped before any context is made, by a bitmap of fixed size as in `substring.py`. A
   line that is common, but shorter than half a match, makes no key that is found twice.
3. Suffixes are sorted over the whole corpus, by key and then by context: the next words on the side of
   the key, nearest first, then those on the other side. Partitions are ranges of that order, so a passage
   that a third of all documents hold is spread over as many tasks as it needs.
4. In that order the suffixes that share their next n words are neighbours. For each n from half of `size` to
   all of it, neighbours are compared by the size - n words on the other side; those that agree hold the
   same `size` words around the place. So the match is extended right and left by every split of `size`, and
   no suffix that sorts between two others can hide what these share. Per suffix the windows found make one span.
5. A task works on blocks of whole keys, of BLOCK suffixes or so; a key that goes on in another block or task
   has its suffixes at the edge (those that share the n next words with the block's first or last one) reduced
   to one per window, and these are compared by an aggregate over window hashes.
6. Spans are joined per document: matches longer than a context are tiled by successive suffixes. Every
   window names the earliest place that holds it (smallest doc_id, then place); documents that share windows are
   joined into components.

Result: one row per document with a repeat: doc_id, n_spans, n_words (in spans), spans ('start:end' in
words, end exclusive, comma-joined), n_later and later_spans (the same of windows that are found at an earlier
place too: what a dedup removes), component_id (the smallest doc_id that shared passages lead to). Defined
results: null or empty text has no suffix; rows of one doc_id with equal texts are one document, with different
texts documents of their own, one result row each; rows with a null doc_id are told apart by their texts, come
last in order, and are reported as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm import wordhash as W
from affinis.llm.common import cut, fresh_path
from affinis.llm.simhash import components
from affinis.llm.substring import LAST, identified, identity, in_bitmap, repeated_bitmap

SIZE, GRAM, WINDOW = 50, 5, 40
BITS = 1 << 26
ROWS = 4000
#: Suffixes compared at once: some 30 MB with their contexts and hashes.
BLOCK = 40_000
NAMES = ["key", "side", "context", "doc", "tag", "at"]
SUFFIX = "key long, side byte, context binary, doc long, tag long, at int"
#: What a comparison finds: spans, spans with an earlier place, pairs of documents, windows at the edge of a block.
ANY, LATER, EDGE, WINDOW_AT = range(4)
FOUND = ["kind", "doc", "tag", "a", "b", "doc2", "tag2", "key", "side", "h"]
KINDS_OF = [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64()]
FOUND_SCHEMA = "kind byte, doc long, tag long, a int, b int, doc2 long, tag2 long, key long, side byte, h long"
RIGHT, LEFT = np.uint64(0x51ED270B), np.uint64(0x2545F491)
ODD, GROUP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _anchors(texts: pa.Array, size: int) -> Iterator[tuple]:
    """Per run of texts: word hashes, owner, kept places, and of each place its room left and right in words."""
    for h, owner in W.runs(texts):
        grams = W.windows(h, GRAM)
        at = W.minimisers(grams, WINDOW)
        inside = np.flatnonzero(owner[: len(at)] == owner[WINDOW + GRAM - 2 : WINDOW + GRAM - 2 + len(at)]) if len(at) else at
        places = np.unique(at[inside])
        if len(places):
            first = np.searchsorted(owner, owner[places])
            last = np.searchsorted(owner, owner[places], side="right")
            yield h, owner, places, places - first, last - places


def _half_keys(h: np.ndarray, places: np.ndarray, left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept of places, key) by the half right of a place, and by the half left of it."""
    w = W.windows(h, half)
    r, x = np.flatnonzero(right >= half), np.flatnonzero(left >= half)
    return r, W.mix(w[places[r]] ^ RIGHT), x, W.mix(w[places[x] - half] ^ LEFT)


def _count_keys(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, _, places, left, right in _anchors(batch.column(1), size):
                _, a, _, b = _half_keys(h, places, left, right, size // 2)
                found += [a, b]
            values, n = np.unique(np.concatenate(found) if found else np.array([], np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["h", "n"])

    return run


def _context(h: np.ndarray, start: np.ndarray, room: np.ndarray, reach: int, step: int) -> np.ndarray:
    """Rows of `reach` 4-byte word hashes (big-endian bytes) from start on by step; 0 beyond the text."""
    i = start[:, None] + np.arange(reach) * step
    inside = np.arange(reach) < room[:, None]
    low = (h[np.clip(i, 0, len(h) - 1)] & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    return np.where(inside, low, 0).astype(">u4")


def _suffixes(shipped, shared_ids, size: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shipped.value
        for batch in batches:
            ids, tags = identity(batch, shared_ids.value)
            for h, owner, places, left, right in _anchors(batch.column(1), size):
                r, a, x, b = _half_keys(h, places, left, right, half)
                for side, kept, key in ((0, r, a), (1, x, b)):
                    twice = in_bitmap(bitmap, key, bits)
                    kept, key = kept[twice], key[twice]
                    for i in range(0, len(kept), ROWS):
                        k = kept[i : i + ROWS]
                        fwd = _context(h, places[k], right[k], half if side else size, 1)
                        back = _context(h, places[k] - 1, left[k], size if side else half, -1)
                        rows = np.concatenate([back, fwd] if side else [fwd, back], axis=1)
                        width = rows.shape[1] * 4
                        context = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(k), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(key[i : i + ROWS].view(np.int64)),
                                pa.array(np.full(len(k), side, np.int8)),
                                context,
                                pa.array(ids[owner[places[k]]].astype(np.int64)),
                                pa.array(tags[owner[places[k]]].astype(np.int64)),
                                pa.array(left[k].astype(np.int32)),
                            ],
                            NAMES,
                        )

    return run


def _adjacent(near: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Per row, how many of its near words equal those of the row before."""
    equal = (near[1:] == near[:-1]) & (near[1:] != 0)
    n = np.where(equal.all(axis=1), near.shape[1], equal.argmin(axis=1))
    return np.r_[0, np.where(same, n, 0)].astype(np.int64)


class Block:
    """Suffixes in sorted order, compared by every split of a window."""

    def __init__(self, key: np.ndarray, side: np.ndarray, context: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray, size: int):
        self.key, self.side, self.doc, self.tag, self.at, self.size = key, side, doc, tag, at, size
        self.near, far = context[:, :size], context[:, size:]
        self.prev = _adjacent(self.near, (key[1:] == key[:-1]) & (side[1:] == side[:-1]))
        self.room_near, self.room_far = (self.near != 0).sum(axis=1), (far != 0).sum(axis=1)
        self.far = [np.zeros(len(key), np.uint64)]  # hash of the first 0, 1, ... words on the other side
        for i in range(far.shape[1]):
            self.far.append(self.far[-1] * ODD + far[:, i])
        order = np.lexsort((at, tag, doc))
        step = lambda *v: np.r_[False, np.any([x[order][1:] != x[order][:-1] for x in v], axis=0)]
        # a place's rank; rows of one place (repeated rows) have one rank
        self.rank, self.node = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        self.rank[order], self.node[order] = np.cumsum(step(doc, tag, at)), np.cumsum(step(doc, tag))
        self.first_of_rank = order[np.flatnonzero(np.r_[True, np.diff(self.rank[order]) > 0])]
        self.first_of_node = order[np.flatnonzero(np.r_[True, np.diff(self.node[order]) > 0])]

    def levels(self, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(n, rows) for each split n: rows with n near and size - n far words, and reach of at least n."""
        half = self.size // 2
        live = np.flatnonzero(reach >= half)
        for n in range(half, self.size + 1):
            live = live[(reach[live] >= n) & (self.room_near[live] >= n)]
            rows = live[self.room_far[live] >= self.size - n]
            if len(rows):
                yield n, rows

    def repeats(self) -> Iterator[pa.RecordBatch]:
        """Spans (ANY) and spans with an earlier place (LATER) of the rows, and edges between documents."""
        n_rows = len(self.key)
        low, high = {k: np.full(n_rows, self.size + 1) for k in (ANY, LATER)}, {k: np.zeros(n_rows, np.int64) for k in (ANY, LATER)}
        edges = []
        for n, rows in self.levels(np.maximum(self.prev, np.r_[self.prev[1:], 0])):
            h = W.mix(self.far[self.size - n][rows] + np.cumsum(self.prev < n)[rows].astype(np.uint64) * GROUP)
            order = np.argsort(h)
            h, rows = h[order], rows[order]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            rank, count = self.rank[rows], np.diff(np.r_[head, len(h)])
            least, most = np.repeat(np.minimum.reduceat(rank, head), count), np.repeat(np.maximum.reduceat(rank, head), count)
            for kind, some in ((ANY, most > least), (LATER, rank > least)):
                i = rows[some]
                low[kind][i], high[kind][i] = np.minimum(low[kind][i], n), n
            later = rank > least
            a, b = self.node[rows[later]], self.node[self.first_of_rank[least[later]]]
            edges.append(np.unique(a[a != b] * n_rows + b[a != b]))
        for kind in (ANY, LATER):
            i = np.flatnonzero(high[kind])
            right, left = self.side[i] == 0, self.size - low[kind][i]
            start = self.at[i] - np.where(right, left, high[kind][i])
            yield from _rows(kind, self.doc[i], self.tag[i], start, self.at[i] + np.where(right, high[kind][i], left))
        pairs = np.unique(np.concatenate(edges)) if edges else np.array([], np.int64)
        a, b = self.first_of_node[pairs // n_rows], self.first_of_node[pairs % n_rows]
        yield from _rows(EDGE, self.doc[a], self.tag[a], doc2=self.doc[b], tag2=self.tag[b])

    def edge_windows(self, before: bool, after: bool) -> Iterator[pa.RecordBatch]:
        """One row per window of the suffixes that may have their like before the block's first or after its last."""
        n_rows, none = len(self.key), np.zeros(len(self.key), np.int64)
        first = np.minimum.accumulate(np.r_[self.size, self.prev[1:]]) if before else none
        last = np.minimum.accumulate(np.r_[self.size, self.prev[1:][::-1]])[::-1] if after else none
        near, have = np.zeros(n_rows, np.uint64), 0
        for n, rows in self.levels(np.maximum(first, last)):
            while have < n:
                near, have = near * ODD + self.near[:, have], have + 1
            h = W.mix(W.mix(near[rows]) + self.far[self.size - n][rows])
            order = np.lexsort((self.rank[rows], h))
            i = rows[order[np.flatnonzero(np.r_[True, np.diff(h[order]) > 0])]]
            h = np.unique(h)
            yield from _rows(WINDOW_AT, self.doc[i], self.tag[i], self.at[i], np.full(len(i), n), key=self.key[i], side=self.side[i], h=h.view(np.int64))


def _rows(kind: int, doc, tag, a=None, b=None, doc2=None, tag2=None, key=None, side=None, h=None) -> Iterator[pa.RecordBatch]:
    columns = [np.full(len(doc), kind), doc, tag, a, b, doc2, tag2, key, side, h]
    for i in range(0, len(doc), 50_000):
        s = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(doc[s]), t) if c is None else pa.array(c[s].astype(t.to_pandas_dtype())) for c, t in zip(columns, KINDS_OF, strict=True)], FOUND)


def _compare(size: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted suffixes, block by block: whole keys, or a part of a key that fills a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, True

        def done(part: list[np.ndarray], after: bool) -> Iterator[pa.RecordBatch]:
            if len(part[0]):
                whole = Block(*part, size)
                yield from whole.repeats()
                if before or after:
                    yield from whole.edge_windows(before, after)

        for batch in batches:
            if not batch.num_rows:
                continue
            # the context comes as big-endian bytes, which sort like its words
            context = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(batch.num_rows, -1).astype(np.uint32)
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), context, *(batch.column(i).to_numpy().astype(np.int64) for i in (3, 4, 5))]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            n = len(held[0])
            if n >= block:
                cut = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
                at = int(cut[-1]) + 1 if len(cut) else n  # the last key may go on
                yield from done([x[:at] for x in held], at == n)
                held, before = [x[at:] for x in held], at == n
        if held is not None:
            yield from done(held, True)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def union(start: np.ndarray, end: np.ndarray) -> tuple[int, int, str]:
        if not len(start):
            return 0, 0, ""
        order = np.argsort(start, kind="stable")
        start, upto = start[order], np.maximum.accumulate(end[order])
        head = np.r_[True, start[1:] > upto[:-1]]
        begin = start[head]
        stop = upto[np.r_[np.flatnonzero(head)[1:] - 1, len(upto) - 1]]
        return len(begin), int((stop - begin).sum()), ",".join(f"{a}:{b}" for a, b in zip(begin, stop, strict=True))

    for batch in batches:
        out = []
        for spans in batch.column(2):
            kind, start, end = (x.to_numpy() for x in spans.values.flatten())
            _, n_later, later = union(start[kind == LATER], end[kind == LATER])
            out.append((*union(start[kind == ANY], end[kind == ANY]), n_later, later))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True))], ["doc", "tag", "n_spans", "n_words", "spans", "n_later", "later_spans"])


def matches(docs: DataFrame, size: int = SIZE, bits: int = BITS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(kind, doc, tag, start, end) of windows found twice, joined per suffix, and (doc, tag, doc2, tag2) of documents that share one."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(repeated_bitmap(docs.select("doc_id", "text").mapInArrow(_count_keys(size), "h long, n byte"), bits))
    slim, shared_ids = identified(docs)
    order = ["key", "side", "context", "doc", "tag", "at"]
    rows = slim.mapInArrow(_suffixes(shipped, shared_ids, size, bits), SUFFIX).repartitionByRange(*order).sortWithinPartitions(*order)
    # a written table: read three times, and columns that are mostly null take no room
    path = fresh_path(spark, "repeats")
    rows.mapInArrow(_compare(size, block), FOUND_SCHEMA).write.parquet(path)
    found = spark.read.schema(FOUND_SCHEMA).parquet(path)
    place = F.struct("doc", "tag", "at")
    # rows of a window: one per block that holds it
    edge = found.where(F.col("kind") == WINDOW_AT).withColumnRenamed("a", "at").withColumnRenamed("b", "n")
    of = Window.partitionBy("key", "side", "n", "h")
    edge = edge.withColumn("least", F.min(place).over(of)).withColumn("most", F.max(place).over(of)).where(F.col("least") != F.col("most"))
    back = F.when(F.col("side") == 0, F.lit(size) - F.col("n")).otherwise(F.col("n"))
    own = [F.col("doc"), F.col("tag"), (F.col("at") - back).alias("a"), (F.col("at") - back + F.lit(size)).alias("b")]
    edge = cut(edge.select(*own, (place != F.col("least")).alias("later"), F.col("least.doc").alias("doc2"), F.col("least.tag").alias("tag2")))
    across = edge.select(F.explode(F.when(F.col("later"), F.array(F.lit(ANY), F.lit(LATER))).otherwise(F.array(F.lit(ANY))).cast("array<byte>")).alias("kind"), "doc", "tag", "a", "b")
    spans = found.where(F.col("kind").isin(ANY, LATER)).select("kind", "doc", "tag", "a", "b").union(across)
    links = found.where(F.col("kind") == EDGE).select("doc", "tag", "doc2", "tag2").union(edge.select("doc", "tag", "doc2", "tag2"))
    return spans.withColumnsRenamed({"a": "start", "b": "end"}), links.where("doc <> doc2 OR tag <> tag2")


def repeated_passages(docs: DataFrame, size: int = SIZE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    spans, links = matches(docs, size, bits, block)
    node = lambda doc, tag: F.concat_ws(":", doc, tag)
    roots = cut(components(links.select(node("doc", "tag").alias("a"), node("doc2", "tag2").alias("b"))))
    # spans of a document that start at one word are combined on the map side, then those of a document
    found = spans.groupBy("doc", "tag", "kind", "start").agg(F.max("end").alias("end"))
    per = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("kind", "start", "end")).alias("spans"))
    per = cut(per.mapInArrow(_joined, "doc long, tag long, n_spans long, n_words long, spans string, n_later long, later_spans string"))
    named = per.withColumn("node", node("doc", "tag")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = cut(named.groupBy("root").agg(F.min("doc").alias("component_id")))
    null = lambda c, name: F.when(F.col(c) != LAST, F.col(c)).alias(name)
    return named.join(least, "root").select(null("doc", "doc_id"), "n_spans", "n_words", "spans", "n_later", "later_spans", null("component_id", "component_id"))
