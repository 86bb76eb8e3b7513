"""Byte-level BPE encoding and decoding (operator 5).

A text is split by the tokenizer's pattern; each distinct piece is merged once and its ids are used
wherever it occurs. Merging folds over the piece's bytes: the adjacent pair of the lowest rank is joined
until no pair has a rank. Decoding concatenates the tokens' bytes.

Two forms of the same fold:

* `merge_words`: Spark higher-order functions over the byte arrays of a table of distinct words, with the
  rank table as one literal (hash-bucketed arrays, as a map literal is searched from end to end).
* `encode`: Arrow batches, with the pieces merged in a cache of at most CACHE pieces per worker. It is the
  one the query uses; README.md gives the reason and figures: the higher-order form needs a join of all
  occurrences with the distinct words, which moves several times the text through disk.

Defined results: null text is encoded as the empty text (no ids); any text round-trips, as all 256 bytes
have ranks; very long texts are encoded whole, and a piece of any length in n log n steps; repeated rows are
encoded one by one; an empty table gives no rows; `encode` and `decode` pass other columns, `digests` returns
those asked for.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import let

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces a worker remembers; beyond that it starts over. Bounds its memory, not the result.
CACHE = 300_000
#: Texts in one outgoing batch.
MAX_ROWS = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank: a fixed file of the tokenizer, read on the driver and sent with the code."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: a fold over merges in order of rank (the leftmost of equal ones first)."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    if len(piece) > 64:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return tuple(ranks[p] for p in parts)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same fold with a heap and linked parts: n log n, for pieces of any length."""
    import heapq

    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, heap = [True] * n, []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop or ranks.get(piece[i:stop]) != r:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


class Encoder:
    """Ids of texts; remembers the pieces it has merged."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        import regex

        self.ranks, self.split, self.most = ranks, regex.compile(pattern).findall, cache
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.known = self._known()

    def _known(self):
        ranks = self.ranks

        class Known(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                self[piece] = ids = merge(piece.encode(), ranks)
                return ids

        return Known()

    def encode(self, text: str | None) -> list[int]:
        if len(self.known) > self.most:
            self.known = self._known()
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text or ""))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def over_texts(make: Callable[[], Callable[[str | None], tuple]], types: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: the first columns pass, the last is a text that make()(text) turns into the new columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for whole in batches:
            for at in range(0, whole.num_rows, MAX_ROWS):
                b = whole.slice(at, MAX_ROWS)
                new = list(zip(*[one(x.as_py()) for x in b.column(b.num_columns - 1)], strict=True))
                kept = [b.column(i) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, new, types)], names=[f"c{i}" for i in range(len(kept) + len(types))])

    return run


def _schema(df: DataFrame, names: list[str], new: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names] + [new])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, column: str = "text") -> DataFrame:
    """docs with `ids` in place of the text column."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)  # the tokenizer's own fixed size

    def make():
        e = Encoder(shipped.value, pattern)
        return lambda text: (e.encode(text),)

    rest = [c for c in docs.columns if c != column]
    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`")).mapInArrow(over_texts(make, [pa.list_(pa.int32())]), _schema(docs, rest, "`ids` array<int>"))


def decode(encoded: DataFrame, ranks: dict[bytes, int], column: str = "ids") -> DataFrame:
    """encoded with `decoded`, the bytes of the ids, in place of the ids."""
    shipped = encoded.sparkSession.sparkContext.broadcast(ranks)

    def make():
        e = Encoder(shipped.value, "")
        return lambda ids: (e.decode(ids or []),)

    rest = [c for c in encoded.columns if c != column]
    return encoded.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`")).mapInArrow(over_texts(make, [pa.binary()]), _schema(encoded, rest, "`decoded` binary"))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_tokens, ids_sha256, decoded_sha256: ids are encoded, then decoded, within one pass."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        e = Encoder(shipped.value, pattern)
        text_of = list(map(str, range(len(e.bytes))))

        def one(text):
            ids = e.encode(text)
            listed = ",".join(map(text_of.__getitem__, ids))
            return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()

        return one

    kinds = [pa.int64(), pa.string(), pa.string()]
    schema = _schema(docs.select(*keep), list(keep), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(*keep, "text").mapInArrow(over_texts(make, kinds), schema)


def _rank_table(ranks: dict[bytes, int], buckets: int) -> Column:
    """ranks as one literal: bucket of crc32 -> 'hex=rank;' strings."""
    import zlib

    rows = [[] for _ in range(buckets)]
    for token, rank in ranks.items():
        rows[zlib.crc32(token) % buckets].append(f"{token.hex().upper()}={rank};")
    return F.split(F.lit("|".join(";" + "".join(r) for r in rows)), r"\|")


def merge_words(words: DataFrame, ranks: dict[bytes, int], column: str = "word", buckets: int = 1 << 14) -> DataFrame:
    """words (one row per distinct word) with `ids`: the fold as higher-order functions, no Python on executors."""
    df = words.withColumn("_ranks", _rank_table(ranks, buckets))

    def rank(token: Column) -> Column:
        row = F.get(F.col("_ranks"), F.pmod(F.crc32(F.unhex(token)), F.lit(buckets)).cast("int"))
        at = F.call_function("instr", row, F.concat(F.lit(";"), token, F.lit("=")))
        return F.when(at > 0, F.substring_index(F.substring(row, at + F.length(token) + 2, F.lit(12)), ";", 1).cast("int"))

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.struct(rank(F.concat(p, F.get(parts, i + 1))).alias("r"), i.alias("i")))
        best = F.array_min(F.filter(pairs, lambda x: x["r"].isNotNull()))
        return let(best, lambda b: F.when(b.isNull(), parts).otherwise(F.concat(F.slice(parts, F.lit(1), b["i"]), F.array(F.concat(F.get(parts, b["i"]), F.get(parts, b["i"] + 1))), F.slice(parts, b["i"] + 3, F.size(parts)))))

    hexed = F.hex(F.encode(F.col(f"`{column}`"), "utf-8"))
    parts = let(hexed, lambda h: F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.substring(h, i, F.lit(2))))
    folded = let(parts, lambda p: F.aggregate(F.slice(p, F.lit(2), F.size(p)), p, step))
    return df.withColumn("ids", F.transform(folded, rank)).drop("_ranks")
