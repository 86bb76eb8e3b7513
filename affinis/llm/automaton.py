"""Substring removal against a reference of bounded size, by broadcast suffix automata (operator 7's second form).

The reference is cut into shards of about SHARD_WORDS words. One shard at a time is read by the driver, made
into a suffix automaton and broadcast; documents stream through it: after each word the automaton is in the
state of the longest suffix of what was read that occurs in the shard (matching statistics). Maximal spans of
at least `threshold` words are written to the shared folder, the broadcast is dropped, and the next shard
follows; in the end the spans of all passes are removed from the texts.

A reference of more than REFERENCE_WORDS words is refused: a pass over the documents per shard is no way to
go further. For a corpus that is its own reference this costs corpus x shards steps; see README.md for the
figures and `substring.py` for the form that op7's query uses. Defined results: null or empty text has no words;
an empty reference removes nothing; rows are treated one by one, whatever their doc_id; a text longer than a
shard is a shard of its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm import wordhash as W
from affinis.llm.common import cut, words
from affinis.llm.substring import _removed, keep_words

THRESHOLD, SHARD_WORDS, REFERENCE_WORDS = 20, 200_000, 10_000_000


class SuffixAutomaton:
    """All substrings of the sequences added; a separator that matches nothing keeps them apart."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, word: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        now = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = now
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(word) == q:
                    nxt[p][word] = copy
                    p = link[p]
                link[q] = link[now] = copy
        self.last = now

    def extend(self, words: list[int]) -> None:
        for w in words:
            self.add(w)
        self.last = 0  # the next sequence starts anew: no substring crosses

    def statistics(self, words: list[int]) -> list[int]:
        """Per position, the length of the longest match that ends there."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def spans(statistics: list[int], threshold: int) -> list[tuple[int, int]]:
    """Maximal (start, end) spans covered by matches of at least `threshold` words."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(statistics, 1):
        if n >= threshold:
            start = end - n
            if out and start <= out[-1][1]:
                start = min(start, out.pop()[0])
            out.append((start, end))
    return out


def shards(reference: DataFrame, column: str, most: int = SHARD_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata over the reference, read row by row; a text longer than a shard fills one of its own."""
    found, n = SuffixAutomaton(), 0
    for row in reference.select(column).where(f"`{column}` IS NOT NULL").toLocalIterator():
        words = W.hash_words(row[0].encode())[0].tolist()
        if n and n + len(words) > most:
            yield found
            found, n = SuffixAutomaton(), 0
        found.extend(words)
        n += len(words)
    if n:
        yield found


def _matches(shipped, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = W.hash_words((text.as_py() or "").encode())[0].tolist()
                rows += [(row, a, b - a) for a, b in spans(shipped.value.statistics(hashes), threshold)]
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["row", "at", "run"])

    return run


def remove_reference(docs: DataFrame, reference: DataFrame, column: str = "text", threshold: int = THRESHOLD, most: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text, n_words, n_removed): docs without spans that the reference holds."""
    spark = docs.sparkSession
    size = reference.agg(F.sum(F.size(words(F.col(f"`{column}`"))))).first()[0] or 0
    if size > REFERENCE_WORDS:
        raise ValueError(f"a reference of {size} words is too large: {REFERENCE_WORDS} at most")
    # rows are told apart by a number that is fixed once written
    docs = cut(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    found = spark.createDataFrame([], "row long, at int, run int")
    for automaton in shards(reference, column, most):
        shipped = spark.sparkContext.broadcast(automaton)
        found = found.union(cut(docs.select("row", "text").mapInArrow(_matches(shipped, threshold), "row long, at int, run int")))
        shipped.unpersist()
    per = found.groupBy("row").agg(F.collect_list(F.struct("at", "run")).alias("spans"))  # of one text each

    def row(text: bytes, at: tuple[np.ndarray, np.ndarray] | None) -> tuple[str, int, int]:
        left, gone = keep_words(text, at, 1)
        return b" ".join(left).decode(), len(left) + gone, gone

    out = _removed(row, [pa.string(), pa.int64(), pa.int64()])
    return docs.join(per, "row", "left").select("doc_id", "text", "spans").mapInArrow(out, "doc_id long, text string, n_words long, n_removed long")
