"""Substring dedup: words covered by a window of `size` words that starts earlier elsewhere (operator 7).

1. Anchors. Every window has one anchor: the smallest of its `GRAM`-word grams by hash (the leftmost of
   equals). Equal windows have equal anchors, so a window can only repeat if its anchor's gram is found at
   two places or more. Anchors, about one in eight words, are counted over the corpus (combined per batch,
   then by an aggregate).
2. The grams found twice or more go into a bitmap of BITS bits: a fixed size, whatever the corpus; it is
   built by bitmap aggregates and broadcast. A full bitmap lets more windows through and drops none.
3. Windows whose anchor is in the bitmap are keyed by 96 bits of hash. A batch keeps one row per key, its
   earliest; its others repeat for certain and go on as runs without a key. So a window that a third of
   all documents hold reaches a task at most once per batch. Per key, all but the earliest repeat.
4. Repeats per document are joined to the texts, and the words they cover are removed.

The corpus is its own reference here. A suffix automaton of every reference shard, streamed by every
document, costs (shards x corpus) steps; `automaton.py` has that form for a reference of bounded size, and
README.md the figures.

Defined results: null or empty text has no words; fewer than `size` words make no window; rows of one
doc_id with equal texts do not repeat each other, and rows of one doc_id with different texts are documents
of their own, told apart by a hash of the text; so are rows with a null doc_id, which come last in order; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm import wordhash as W

SIZE, GRAM = 20, 6
#: Bits of the bitmap of repeated anchors: 16 MB.
BITS = 1 << 27
LAST = 2**63 - 1
#: Bits of the bitmap of doc_ids that more than one row has: 1 MB.
ID_BITS = 1 << 23
#: Texts in one outgoing batch.
ROWS = 256


def _runs(batch: pa.RecordBatch, size: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of texts: (word hashes, owner of each word, windows' starts, anchor places of these, gram hashes)."""
    for h, owner in W.runs(batch.column(1)):
        grams = W.windows(h, gram)
        at = W.minimisers(grams, size - gram + 1)
        if len(at):
            inside = np.flatnonzero(owner[: len(at)] == owner[size - 1 : size - 1 + len(at)])
            yield h, owner, inside, at[inside], grams


def _anchor_counts(size: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams[np.unique(at)] for _, _, _, at, grams in _runs(batch, size, gram)]
            values, n = np.unique(np.concatenate(found) if found else np.array([], np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["h", "n"])

    return run


def repeated_bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bits (modulo `bits`) of the keys h whose n adds up to two or more, as bytes: bits / 8 of them."""
    twice = keys.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select((F.pmod("h", F.lit(bits)) + 1).alias("p"))
    rows = twice.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(bits // 8 + 8192, np.uint8)
    for r in rows.toLocalIterator():  # at most bits / 32768 rows of 4 KB
        # buckets and p count from 1
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, h: np.ndarray, bits: int = BITS) -> np.ndarray:
    p = (h & np.uint64(bits - 1)).astype(np.int64) if bits & (bits - 1) == 0 else (h.view(np.int64) % bits)
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def identified(docs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(doc_id, text, id_hash, tag) of docs, and the bitmap of doc_ids that several rows have, for `identity`."""
    ids = docs.where("doc_id IS NOT NULL").select(F.xxhash64("doc_id").alias("h"), F.lit(1).alias("n"))
    slim = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("id_hash"), F.xxhash64("text").alias("tag"))
    return slim, docs.sparkSession.sparkContext.broadcast(repeated_bitmap(ids, ID_BITS))


def identity(batch: pa.RecordBatch, shared_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, tag) of each row: LAST for null ids; the text's hash for ids that several rows may share, 0 (which compresses well) for all others."""
    ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
    several = (ids == LAST) | in_bitmap(shared_ids, batch.column(2).to_numpy().view(np.uint64), ID_BITS)
    return ids, np.where(several, batch.column(3).to_numpy(), 0)


def _windows(shipped, shared_ids, size: int, gram: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shipped.value
        for batch in batches:
            ids, tags = identity(batch, shared_ids.value)
            found = []
            for h, owner, start, at, grams in _runs(batch, size, gram):
                take = in_bitmap(bitmap, grams[at], bits)
                i = start[take]
                first = np.searchsorted(owner, owner[i])  # of the words of the window's text
                other = W.windows(W.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), size)[i] >> np.uint64(32)
                found.append((W.windows(h, size)[i], other, ids[owner[i]], tags[owner[i]], i - first))
            if not found:
                continue
            h1, h2, doc, tag, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((at, tag, doc, h2, h1))
            h1, h2, doc, tag, at = h1[order], h2[order], doc[order], tag[order], at[order]
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])][: len(h1)]
            head = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
            own = (doc == doc[head]) & (tag == tag[head]) & (at == at[head])
            yield from _emit(h1[own], h2[own], doc[own], tag[own], at[own], np.ones(int(own.sum()), np.int64), False)
            doc, tag, at = doc[~own], tag[~own], at[~own]
            order = np.lexsort((at, tag, doc))
            doc, tag, at = doc[order], tag[order], at[order]
            begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] > at[:-1] + 1)][: len(doc)])
            last = np.r_[begin[1:], len(doc)] - 1 if len(begin) else begin
            key = W.mix(doc[begin].astype(np.uint64) * np.uint64(31) + at[begin].astype(np.uint64))
            yield from _emit(key, key >> np.uint64(32), doc[begin], tag[begin], at[begin], at[last] - at[begin] + 1 if len(begin) else begin, True)

    return run


def _emit(h1, h2, doc, tag, at, run, sure: bool) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(h1), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h1[s].view(np.int64)), pa.array(h2[s].astype(np.uint32).view(np.int32)), pa.array(doc[s].astype(np.int64)), pa.array(tag[s].astype(np.int64)), pa.array(at[s].astype(np.int32)), pa.array(run[s].astype(np.int32)), pa.array(np.full(len(h1[s]), sure))],
            ["h1", "h2", "doc", "tag", "at", "run", "sure"],
        )


def repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """(doc, tag, at, run): `run` windows from word `at` on, each found earlier too; tag is 0 or the hash of the text."""
    slim = docs.select("doc_id", "text")
    keys = slim.mapInArrow(_anchor_counts(size, gram), "h long, n byte")
    shipped = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(keys, bits))
    slim, shared_ids = identified(docs)
    rows = slim.mapInArrow(_windows(shipped, shared_ids, size, gram, bits), "h1 long, h2 int, doc long, tag long, at int, run int, sure boolean")
    nth = F.rank().over(Window.partitionBy("sure", "h1", "h2").orderBy("doc", "tag", "at"))
    return rows.withColumn("nth", nth).where("sure OR nth > 1").select("doc", "tag", "at", "run")


def _removed(make_row: Callable[[bytes, list | None], tuple], types: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                spans = b.column(2)
                new = []
                for text, span in zip(b.column(1), spans, strict=True):
                    at = None
                    if span.is_valid and len(span):
                        flat = span.values.flatten()
                        at = flat[0].to_numpy(zero_copy_only=False), flat[1].to_numpy(zero_copy_only=False)
                    new.append(make_row((text.as_py() or "").encode(), at))
                cols = list(zip(*new, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, types)], [f"c{j}" for j in range(len(types) + 1)])

    return run


def keep_words(text: bytes, spans: tuple[np.ndarray, np.ndarray] | None, size: int = SIZE) -> tuple[list[bytes], int]:
    """(words left, words removed)."""
    ws = text.split()
    if spans is None:
        return ws, 0
    step = np.zeros(len(ws) + 1, np.int64)
    np.add.at(step, spans[0], 1)
    np.add.at(step, spans[0] + spans[1] + size - 1, -1)
    stay = np.cumsum(step[:-1]) == 0
    return [w for w, s in zip(ws, stay.tolist(), strict=True) if s], int(len(ws) - stay.sum())


def _joined(docs: DataFrame, size: int, gram: int, bits: int) -> DataFrame:
    spans = repeats(docs, size, gram, bits).groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "run")).alias("spans"))
    spans = spans.withColumn("key", F.when(F.col("doc") == LAST, F.col("tag")).otherwise(F.col("doc")))
    slim = docs.select("doc_id", "text")
    known = F.coalesce(slim["doc_id"], F.lit(LAST))
    # rows without an id are joined by their text's hash, so they don't meet in one task
    same = F.when(known == LAST, F.xxhash64(slim["text"])).otherwise(known) == F.col("key")
    own = (F.col("tag") == 0) | (F.col("tag") == F.xxhash64(slim["text"]))
    return slim.join(spans, same & (known == F.col("doc")) & own, "left").select("doc_id", "text", "spans")


def deduplicate(docs: DataFrame, size: int = SIZE, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """(doc_id, text, n_words, n_removed): text is the words that stay, joined by one space."""

    def row(text, spans):
        left, gone = keep_words(text, spans, size)
        return b" ".join(left).decode(), len(left) + gone, gone

    return _joined(docs, size, gram, bits).mapInArrow(_removed(row, [pa.string(), pa.int64(), pa.int64()]), "doc_id long, text string, n_words long, n_removed long")


def digests(docs: DataFrame, size: int = SIZE, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""

    def row(text, spans):
        left, gone = keep_words(text, spans, size)
        return len(left) + gone, gone, hashlib.sha256(b" ".join(left)).hexdigest()

    return _joined(docs, size, gram, bits).mapInArrow(_removed(row, [pa.int64(), pa.int64(), pa.string()]), "doc_id long, n_words long, n_removed long, kept_sha256 string")
