"""Importance resampling towards a target distribution by hashed n-grams (operator 12).

Features of a text are its runs of 1 to 2 words. The corpus holds S of them, s in a bucket of `BUCKETS`; the
target texts hold T and t. A bucket's gain is floor(1000 ln((t+1)(S+BUCKETS) / ((s+1)(T+BUCKETS)))), a document's
weight the floored mean of its features' gains. Adding Gumbel noise from a hash of doc_id and taking the highest
scores draws documents without replacement, with chances in proportion to exp(weight / 1000).

By a dictionary of distinct features:

1. Texts are worked on in runs of about 2 MB. A run's n-gram strings are counted by document, and each distinct
   string leaves once, with its documents and counts, in a block of its part (a hash of the string). A string
   that every document holds leaves once a run, so no part is hot.
2. A part collects the strings of all runs in one dictionary, which hashes each distinct string once. Strings go
   no further: from here on a run's features are bucket numbers with documents and counts. This table is cut.
3. The table's counts by bucket give s, the target's texts t. The gains (one number a bucket: a fixed size) are
   broadcast and joined back to the per-document counts; a run's sums of gains by document are added up over its parts.

Parts are as many as PART bytes of text ask for, within limits; a dictionary of more than DICTIONARY strings starts
anew, so a worker's memory has a bound whatever the corpus (a string met again later is then hashed again). Ranks come from counts by score (integers of
a bounded range), then from the order within one score; no task sorts all documents.

Defined results: null or empty text, and text without a word, has no feature and weight 0, and is not drawn; a text
of one word has one feature; very long texts are read whole, as a run of their own; rows are scored one by one, so
repeated rows count each time and rows that share a doc_id have the same noise; a null doc_id has the noise of '7:'
and comes last among equals; rows of equal score and doc_id are ordered by n_features; an empty table gives no rows;
an empty target has T = 0; other columns, whatever their names, are ignored. Row numbers are taken in the first step
alone, so docs whose order may change when a lost part is made again (rows after a shuffle) should be cut before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm import arrowwords as A
from affinis.llm.common import cut, only

BUCKETS, SIZES, SEED, PERCENT, LEAST_WORDS = 10_000, 2, 7, 25, 20
#: Bytes of a run; distinct strings that a dictionary holds; bytes of text for each part, and most parts.
RUN, DICTIONARY, PART, MOST_PARTS = 1 << 21, 1 << 20, 1 << 24, 20_000
#: Tasks that add up the tasks' bucket counts, an array each.
ADDERS = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIELDS = "first long, part int, strings binary, docs binary, rows array<struct<doc_id:long,n_features:long,n_words:long>>"


def _packed(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers as one value, each in the fewest bytes and compressed."""
    out = b""
    for a in arrays:
        kind = np.min_scalar_type(int(a.max(initial=0)))
        body = _packed(a.astype(kind))
        out += np.array([kind.itemsize, len(a), len(body)], "<u4").tobytes() + body
    return out


def unpacked(value: bytes) -> list[np.ndarray]:
    found, at = [], 0
    while at < len(value):
        width, n, size = np.frombuffer(value, "<u4", 3, at).tolist()
        raw = pa.decompress(value[at + 12 : at + 12 + size], decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
        found.append(np.frombuffer(raw, f"<u{width}"))
        at += 12 + size
    return found


def fronted(strings: pa.Array) -> bytes:
    """Sorted strings without a newline as one value: the bytes each shares with the one before (16 at most), and the rest."""
    ends = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, 4 * strings.offset).astype(np.int64)
    raw = np.frombuffer(strings.buffers()[2], np.uint8)
    size = np.diff(ends)
    head = raw[np.minimum(ends[:-1, None] + np.arange(16), ends[-1] - 1)]
    same = (head[1:] == head[:-1]) & (np.arange(16) < np.minimum(size[1:], size[:-1])[:, None])
    shared = np.r_[0, np.cumprod(same, axis=1).sum(axis=1)]
    keep = np.arange(ends[0], ends[-1]) >= np.repeat(ends[:-1] + shared, size)
    return packed(shared, size - shared, raw[ends[0] : ends[-1]][keep])


def unfronted(value: bytes) -> Iterator[bytes]:
    shared, size, rest = unpacked(value)
    rest, at, before = rest.tobytes(), 0, b""
    for n, m in zip(shared.tolist(), size.tolist(), strict=True):
        before = before[:n] + rest[at : at + m]
        at += m
        yield before


def ngrams(words: pa.Array, owner: np.ndarray, sizes: int = SIZES) -> tuple[pa.Array, np.ndarray]:
    """(features, the text's number of each): runs of 1 to `sizes` words of one text, joined by a space."""
    found, owners, longer = [words], [owner], words
    for n in range(2, sizes + 1):
        m = max(len(words) - n + 1, 0)
        longer = pc.binary_join_element_wise(longer.slice(0, m), words.slice(n - 1, m), pa.scalar(b" ", pa.binary()))
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        found.append(longer.filter(pa.array(inside)))
        owners.append(owner[:m][inside])
    return pa.concat_arrays(found), np.concatenate(owners)


def spread(strings: pa.Array, parts: int) -> np.ndarray:
    """The part of each string, from the sum of its bytes' powers."""
    ends = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, 4 * strings.offset)
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    size = np.diff(ends)
    place = (np.arange(len(raw)) - np.repeat(ends[:-1] - ends[0], size)).astype(np.uint64)
    each = (raw + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * _ODD
    each ^= each >> np.uint64(29)
    each *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.r_[np.uint64(0), np.cumsum(each, dtype=np.uint64)]
    h = total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]
    return ((h ^ (h >> np.uint64(32))) % np.uint64(parts)).astype(np.int32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.struct([("doc_id", pa.int64()), ("n_features", pa.int64()), ("n_words", pa.int64())])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["first", "part", "strings", "docs", "rows"])


def _by_run(parts: int, sizes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (row, doc_id, text) to a block for each run and part, and to one row (without a part's strings) of each run's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in A.runs(batch.column(2), RUN):
                words, owner = A.words(texts, A.ALPHANUMERIC)
                features, owners = ngrams(words, owner, sizes)
                at, n = batch.column(0)[first].as_py(), len(texts)
                counts = (batch.column(1).slice(first, n).to_pylist(), np.bincount(owners, minlength=n).tolist(), np.bincount(owner, minlength=n).tolist())
                yield _batch([(at, at % parts, None, None, [dict(zip(("doc_id", "n_features", "n_words"), x, strict=True)) for x in zip(*counts, strict=True)])])
                if not len(features):
                    continue
                coded = features.dictionary_encode()
                del features
                order = pc.sort_indices(coded.dictionary)  # neighbours share their first bytes, which compresses
                strings = coded.dictionary.take(order)
                part = spread(strings, parts)
                grouped = np.argsort(part, kind="stable")
                rank = np.empty(len(part), np.int64)
                rank[order.to_numpy()[grouped]] = np.arange(len(part))
                pair, times = np.unique(rank[coded.indices.to_numpy()] * n + owners, return_counts=True)
                del coded
                string, doc = pair // n, pair % n
                strings, part = strings.take(pa.array(grouped)), part[grouped]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
                    lo, hi = np.searchsorted(string, [a, b])
                    docs = packed(np.bincount(string[lo:hi] - a, minlength=b - a), doc[lo:hi], times[lo:hi])
                    yield _batch([(at, int(part[a]), fronted(strings.slice(a, b - a)), docs, None)])

    return run


def _dictionaries(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks sorted by part: a part's dictionary turns strings into buckets, each distinct string hashed once."""
    from zlib import crc32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                part, value = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if value is None:
                    yield batch.slice(i, 1)
                    continue
                if part != now:
                    now, known = part, {}
                if len(known) > DICTIONARY:
                    known = {}
                ids = []
                for s in unfronted(value):
                    b = known.get(s)
                    if b is None:
                        b = known[s] = crc32(s) % buckets
                    ids.append(b)
                ids = packed(np.array(ids, np.int64))
                yield _batch([(batch.column(0)[i].as_py(), part, ids, batch.column(3)[i].as_py(), None)])

    return run


def feature_table(docs: DataFrame, sizes: int = SIZES, buckets: int = BUCKETS, parts: int | None = None) -> DataFrame:
    """Blocks (first, part, strings: bucket numbers, docs) and, where `rows` isn't null, the documents of a run; cut."""
    slim = only(docs, "doc_id", "text")
    if parts is None:
        size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(least, min(MOST_PARTS, -(-size // PART)))
    rows = slim.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = rows.mapInArrow(_by_run(parts, sizes), _FIELDS)
    return cut(blocks.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_dictionaries(buckets), _FIELDS))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids, docs in zip(batch.column(0), batch.column(1), strict=True):
            (bucket,), (each, _, times) = unpacked(ids.as_py()), unpacked(docs.as_py())
            total = _plus(total, np.bincount(np.repeat(bucket, each), weights=times).astype(np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([len(total)], pa.int32()), pa.array([packed(total)], pa.binary())], ["k", "counts"])


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return out


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for counts in batch.column(1):
            total = _plus(total, unpacked(counts.as_py())[0].astype(np.int64))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def bucket_counts(features: DataFrame) -> DataFrame:
    """(bucket, n) of a feature_table(): one array a task, added up in a few tasks, then by bucket."""
    arrays = features.where("rows IS NULL").select("strings", "docs").mapInArrow(_bucket_counts, "k int, counts binary")
    few = arrays.withColumn("k", F.pmod(F.xxhash64("counts"), F.lit(ADDERS)).cast("int")).repartition(ADDERS, "k").mapInArrow(_add_counts, "bucket int, n long")
    return few.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from both bucket counts."""
    spark = corpus.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    df = every.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    total = df.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1.0) * (d("all_s") + float(buckets))) / ((d("s") + 1.0) * (d("all_t") + float(buckets)))
    return df.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weighted(features: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, n_words, weight): gains joined back to per-document counts, the mean floored.

    Each block leaves its documents' sums as one row; a run's sums and its documents then meet in one task.
    """
    table = np.zeros(buckets, np.int64)
    for r in gain.collect():  # one row a bucket
        table[r.bucket] = r.gain
    shipped = features.sparkSession.sparkContext.broadcast(table)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, listed = batch.column(0), batch.column(3)
            for i in range(batch.num_rows):
                if listed[i].is_valid:
                    yield pa.RecordBatch.from_arrays([firsts.slice(i, 1), pa.nulls(1, pa.binary()), listed.slice(i, 1)], ["first", "sums", "rows"])
                    continue
                (bucket,), (each, doc, times) = unpacked(batch.column(1)[i].as_py()), unpacked(batch.column(2)[i].as_py())
                total = np.bincount(doc, weights=shipped.value[np.repeat(bucket, each)] * times.astype(np.int64)).astype(np.int64)
                seen = np.flatnonzero(np.bincount(doc))
                value = packed(np.diff(seen, prepend=0), np.maximum(total[seen], 0), np.maximum(-total[seen], 0))
                yield pa.RecordBatch.from_arrays([firsts.slice(i, 1), pa.array([value], pa.binary()), pa.nulls(1, listed.type)], ["first", "sums", "rows"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, np.int64)  # of a run whose documents come after its blocks
        for batch in batches:
            for first, value, rows in zip(*(batch.column(i) for i in range(3)), strict=True):
                if first.as_py() != now:
                    now, total = first.as_py(), np.zeros(0, np.int64)
                if value.is_valid:
                    gap, up, down = unpacked(value.as_py())
                    own = np.zeros(int(gap.sum()) + 1, np.int64)
                    own[np.cumsum(gap, dtype=np.int64)] = up.astype(np.int64) - down.astype(np.int64)
                    total = _plus(total, own)
                    continue
                docs = rows.values
                n = docs.field(1).to_numpy()
                weight = np.where(n > 0, _plus(total, np.zeros(len(n), np.int64)) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([docs.field(0), docs.field(1), docs.field(2), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

    kind = features.schema["rows"].dataType.simpleString()
    blocks = features.select("first", "strings", "docs", "rows").mapInArrow(sums, f"first long, sums binary, rows {kind}")
    runs = blocks.repartition("first").sortWithinPartitions("first", F.col("rows").isNotNull())
    return runs.mapInArrow(added, "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) of u from the first 32 bits of sha256(seed:doc_id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_features, n_words, weight, score) with the rank of the drawn: percent of the documents of least_words."""
    able = scored.where(F.col("n_words") >= least_words)
    # scores are integers within some tens of thousands: one row each, counted on the map side
    by_score = cut(able.groupBy("score").agg(F.count("*").alias("n")))
    upto = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = by_score.select("score", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    quota = able.sparkSession.sql("SELECT 1").crossJoin(by_score.agg(F.floor(F.coalesce(F.sum("n"), F.lit(0)) * percent / 100).alias("quota"))).select("quota")
    within = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    ranked = able.join(F.broadcast(before), "score").withColumn("nth", F.col("before") + F.row_number().over(within)).crossJoin(F.broadcast(quota))
    out = ranked.select("doc_id", "n_features", "n_words", "weight", "score", F.when(F.col("nth") <= F.col("quota"), F.col("nth")).cast("long").alias("rank"))
    return out.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) of every row of docs; rank is null where not drawn.

    docs: doc_id, text; target: text.
    """
    features = feature_table(docs)
    aim = feature_table(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    out = weighted(features, gains(bucket_counts(features), bucket_counts(aim)))
    return drawn(cut(out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))), percent, least_words)
