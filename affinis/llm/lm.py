"""Language-model scoring (operator 11): a gated recurrent network trained and applied over all documents.

1. Words of the training documents are counted: by run of texts on the map side, then over the corpus. The table
   is cut; N, V and the masses of the tail's classes are aggregates of it. It grows with the corpus and stays
   distributed; only its most frequent words with their counts are broadcast, as many whole levels of frequency
   (eighths of an octave) as hold KNOWN words at most.
2. The HEAD most frequent tokens, the end of a text among them, are tokens of the network (recurrent.py); other words
   fall into the classes of the tail and have their share of the class's counts, an unknown word the share of one.
3. Training: documents are dealt to ROUNDS passes by hash, so that each is learned from once, whole. In a pass
   each task starts from the common weights and learns from its documents by truncated backpropagation; the tasks'
   weights are averaged by tokens, first in AVERAGERS groups, so the driver holds as many models, not one a task.
4. Scoring: each text is read whole, its state carried from window to window. Words beyond the broadcast ones leave
   with their document's row, are joined to the counts, and their logarithms added up by document. A word that
   frequent words leave behind is in at most N / KNOWN training tokens, so the join has no hot key but words that
   only documents outside the training set hold, which an exchange on either side lets AQE split.

base_score is the sum over a text's tokens of log10((c + 1) / (N + V + 1)), score the network's log10 probability.

Defined results: null or empty text, and text of white space, is its end alone (n_tokens 1); very long texts are
read whole; repeated rows count each time in training and are scored alike; a null doc_id is not held out and is
learned from; without training documents N, V and base_score are 0 (one outcome a token), and score is that of the
untrained classes; an empty table gives no rows; other columns, whatever their names, are ignored. Row numbers are
taken in scoring, whose rows are cut before they are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm import arrowwords as A
from affinis.llm import recurrent as R
from affinis.llm.common import cut, only

HEAD, KNOWN, CLASSES = 2048, 65_536, 32
#: Sixteenths of the documents in each round of training; tokens that a task should learn from at least; averages sent to the driver.
ROUNDS, TASK_TOKENS, AVERAGERS = (1, 3, 6, 6), 2_000_000, 16
#: Tokens that are trained on, or scored, at once.
TRAIN_TOKENS, SCORE_TOKENS = 1 << 20, 1 << 22
_LN10 = float(np.log(10))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in A.runs(batch.column(0)):
            counts = pc.value_counts(A.words(texts, A.NOT_SPACE)[0])
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["word", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the column text; words are bytes in lower case (A-Z only)."""
    return texts.select(F.col("text").cast("string")).mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def tail_class(words: pa.Array) -> np.ndarray:
    """0 to 7: by bytes (4, 7, 10 at most, or more), and whether all are ASCII."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    beyond = np.r_[0, np.cumsum(np.frombuffer(words.buffers()[2] or b"", np.uint8)[: ends[-1]] >= 128)] if len(words) else np.zeros(1, int)
    return np.searchsorted([4, 7, 10], size, side="left") + 4 * (beyond[ends[1:]] > beyond[ends[:-1]])


class Vocabulary:
    """The broadcast part: known words in falling order of count, N, V, and the network's shape. Head ids are places in its order."""

    def __init__(self, known: list[bytes], counts: np.ndarray, texts: int, n: int, v: int, head: int = HEAD, classes: int = CLASSES):
        self.known, self.counts, self.n, self.v = pa.array(known, pa.binary()), counts.astype(np.float64), n, v
        end = int(np.searchsorted(-self.counts[: head - 1], -texts, side="right"))  # the end's place by its count
        self.n_head = min(len(known), head - 1)
        self.head_counts, self.end = np.insert(self.counts[: self.n_head], end, texts), end
        self.classes, self.shape = classes, None

    def shaped(self, tail_mass: np.ndarray) -> Vocabulary:
        self.shape = R.Shape(self.head_counts, self.end, tail_mass, self.classes)
        return self

    def log_share(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place among the known or -1, network token) of each word."""
        place = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        inside = (place >= 0) & (place < self.n_head)
        token = np.where(inside, place + (place >= self.end), 0)
        rest = np.flatnonzero(~inside)
        token[rest] = len(self.head_counts) + tail_class(words)[rest]
        return place, token


def laid_out(owner: np.ndarray, token: np.ndarray, texts: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts, each with its end; number of tokens of each text)."""
    n = np.bincount(owner, minlength=texts) + 1
    out = np.full(len(token) + texts, end, np.int64)
    out[np.arange(len(token)) + owner] = token
    return out, n


def vocabulary(counts: DataFrame, texts: int, head: int = HEAD, known: int = KNOWN) -> Vocabulary:
    """counts: word_counts(), cut; texts: number of training documents."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    level = F.floor(F.log2("c") * 8)
    least, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # 8 for each doubling of a count
        held += r["count"]
        if held > known:
            break
        least = r.level
    top = counts.where(level >= least).collect() if least is not None else []  # KNOWN words at most
    top = sorted(top, key=lambda r: (-r.c, bytes(r.word)))
    v = Vocabulary([bytes(r.word) for r in top], np.array([r.c for r in top], np.int64), texts, total.n + texts, total.v + (texts > 0), head)
    shipped = counts.sparkSession.sparkContext.broadcast(v)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shipped.value
        for batch in batches:
            token = voc.encode(batch.column(0))[1] - len(voc.head_counts)
            mass = np.bincount(token[token >= 0], weights=batch.column(1).to_numpy()[token >= 0] + 1, minlength=R.TAIL_CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(R.TAIL_CLASSES, dtype=np.int32)), pa.array(mass.astype(np.int64))], ["k", "mass"])

    tail = np.ones(R.TAIL_CLASSES)  # one for an unknown word
    for r in counts.mapInArrow(masses, "k int, mass long").groupBy("k").agg(F.sum("mass").alias("mass")).collect():
        tail[r.k] += r.mass
    return v.shaped(tail)


def _encoded(batches: Iterator[pa.RecordBatch], voc: Vocabulary, least: int) -> Iterator[np.ndarray]:
    """Tokens of successive texts, `least` at once where there are as many."""
    held, n = [], 0
    for batch in batches:
        for _, texts in A.runs(batch.column(0)):
            words, owner = A.words(texts, A.NOT_SPACE)
            held.append(laid_out(owner, voc.encode(words)[1], len(texts), voc.shape.end)[0].astype(np.int32))
            n += len(held[-1])
            if n >= least:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def train(docs: DataFrame, voc: Vocabulary, rounds: tuple[int, ...] = ROUNDS, task_tokens: int = TASK_TOKENS, hidden: int = R.HIDDEN) -> dict[str, np.ndarray]:
    """The network's weights, learned from all of docs (doc_id, text); the tokens of a text are learned from in one round."""
    context, share = docs.sparkSession.sparkContext, sum(rounds)
    model = R.start(voc.shape, hidden)
    dealt = docs.select("text", F.pmod(F.xxhash64("doc_id", F.col("text")), F.lit(share)).alias("turn"))
    first = 0
    for size in rounds:
        shipped = context.broadcast((voc, model))

        def learn(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            v, common = shipped.value
            own, n = R.Trainer({k: x.copy() for k, x in common.items()}, v.shape), 0
            for tokens in _encoded(batches, v, TRAIN_TOKENS):
                own.learn(tokens)
                n += len(tokens)
            if n:
                moved = (R.flat(own.p) - R.flat(common)).astype(np.float16)
                key = int(np.frombuffer(moved.tobytes()[:4], np.uint32)[0]) ^ n
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([n], pa.int64()), pa.array([moved.tobytes()], pa.binary())], ["key", "n", "moved"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = None, 0
            for batch in batches:
                for m, moved in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    part = np.frombuffer(moved.as_buffer(), np.float16).astype(np.float64) * m
                    total, n = part if total is None else total + part, n + m
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["key", "n", "moved"])

        turn = dealt.where((F.col("turn") >= first) & (F.col("turn") < first + size)).select("text")
        tasks = max(1, int(voc.n * size / share / task_tokens))
        models = turn.coalesce(tasks).mapInArrow(learn, "key long, n long, moved binary")
        means = models.repartition(AVERAGERS, "key").mapInArrow(average, "key long, n long, moved binary").orderBy("moved").collect()  # AVERAGERS rows at most
        if n := sum(r.n for r in means):
            model = R.unflat(R.flat(model) + sum(np.frombuffer(r.moved, np.float32) * (r.n / n) for r in means), model)
        first += size
        shipped.unpersist()
    return model


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<word:binary,n:int>>"


def _scoring(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, model = shipped.value
        shape = voc.shape

        def text_run(rows: pa.RecordBatch, texts: pa.Array) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
            """What of a run needs no network: tokens, lengths, sums without the network's part, words beyond the known."""
            words, owner = A.words(texts, A.NOT_SPACE)
            place, token = voc.encode(words)
            tokens, n = laid_out(owner, token, len(texts), shape.end)
            known = place >= 0
            share, add = voc.log_share(np.r_[voc.counts, 0])[place], lambda w: np.bincount(owner, weights=w, minlength=len(texts))
            base = add(np.where(known, share, 0.0)) + voc.log_share(np.array([voc.head_counts[shape.end]]))
            count = np.r_[voc.counts, 0][place]
            tail = token >= shape.head
            inner = np.zeros(len(token))
            inner[tail] = np.log10(np.where(known[tail], count[tail] + 1, 1.0)) - np.log10(shape.tail_mass[token[tail] - shape.head])
            far = np.flatnonzero(~known)
            coded = words.take(pa.array(far)).dictionary_encode()
            k = max(len(coded.dictionary), 1)
            pair, times = np.unique(owner[far] * k + coded.indices.to_numpy(), return_counts=True)
            of = np.searchsorted(pair // k, np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(of), pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pair % k)), pa.array(times.astype(np.int32))], ["word", "n"]))
            sums = np.stack([n, add(known.astype(float)) + (voc.head_counts[shape.end] > 0), base, add(inner)])
            return rows, tokens.astype(np.int32), n, sums, lists

        def flush(held: list) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            logp = R.score(model, shape, np.concatenate([x[1] for x in held]).astype(np.int64), np.concatenate([x[2] for x in held])) / _LN10
            at = 0
            for rows, _, n, sums, lists in held:
                own = logp[at : at + len(n)]
                at += len(n)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3] + own), lists], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail"])

        held, size = [], 0
        for batch in batches:
            for first, texts in A.runs(batch.column(3)):
                held.append(text_run(batch.slice(first, len(texts)), texts))
                size += len(held[-1][1])
                if size >= SCORE_TOKENS:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    return run


def scored(docs: DataFrame, counts: DataFrame, voc: Vocabulary, model: dict[str, np.ndarray]) -> DataFrame:
    """docs (doc_id, text, held_out) with n_tokens, n_known, base_score and score; counts: word_counts() of training, cut."""
    shipped = docs.sparkSession.sparkContext.broadcast((voc, model))  # KNOWN words and the weights: a fixed size
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    near = cut(rows.mapInArrow(_scoring(shipped), _SCORED))
    far = near.select("row", F.explode("tail").alias("x")).select("row", "x.word", "x.n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = far.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(voc.n + voc.v + 1)))).alias("b"),
        F.sum(F.col("n") * F.log10((c + 1).cast("double"))).alias("s"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return near.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(voc.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"),
    )


def score_documents(docs: DataFrame, head: int = HEAD, known: int = KNOWN, rounds: tuple[int, ...] = ROUNDS, hidden: int = R.HIDDEN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learned from the documents that aren't held out."""
    slim = only(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    training = slim.where("NOT held_out")
    counts = cut(word_counts(training))
    voc = vocabulary(counts, training.count(), head, known)
    return scored(slim, counts, voc, train(training, voc, rounds, hidden=hidden))
