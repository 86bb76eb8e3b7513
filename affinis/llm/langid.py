"""Language identification (operator 2): sparse multinomial logistic regression on TF-IDF character n-grams.

1. Features: the text in lower case, letters kept and all else one space, its 1- to 3-grams of code points
   hashed to DIM places; (1 + log count) * idf, scaled to length 1. Whole texts, in chunks of CHUNK code
   points whose counts are added up; a chunk starts with the last two code points kept of the one before.
2. Document frequencies are counted over all training documents: each task adds up one array of DIM counts,
   and the arrays are summed by place, so what reaches the driver has a fixed size.
3. The classifier is fitted on at most SAMPLE training documents per language, those of the smallest hashes of their
   id; follow-the-regularised-leader with L1 and L2 penalties on four of five of a language's documents, its first
   among them, then one temperature, fitted to the rest by likelihood.
4. Every text is scored in Arrow batches.

The training set is given by the caller; the language of a document never goes into its own prediction.
Every value of lang can be learned and predicted; a model has DIM weights a language, so the labels in use must be
a set of names (DIM x 8 bytes each on the driver and on workers), not free text. Defined results: null text, or
text without a letter, is `und` with score 0; so is everything where nothing can be learned; of languages of equal
score the first by name; repeated rows are predicted alike, and each counts in training; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 1 << 15
CHUNK = 1 << 18
SAMPLE = 500
ALPHA, BETA, L1, L2, ROUNDS = 0.5, 1.0, 0.02, 0.01, 3
UNKNOWN = "und"


class Grams:
    """Counts of hashed n-grams of a text."""

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str) -> np.ndarray | None:
        """DIM counts; null if the text has no letter."""
        total, found, text = None, False, text.lower()
        before = np.array([], np.uint64)  # the last two code points kept so far
        for i in range(0, len(text), CHUNK):
            c = np.frombuffer(text[i : i + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = self.letter[c]
            found |= bool(letter.any())
            # of other code points the first of each run stays, as a space
            keep = letter | np.r_[not len(before) or before[-1] != 32, letter[:-1]]
            c = np.where(letter, c, 32)[keep].astype(np.uint64)
            n, c = len(c), np.r_[before, c]
            before = c[-2:]
            two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]
            three = two[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[2:]
            counts = sum(np.bincount(self.place(g[max(0, len(g) - n) :]), minlength=DIM) for g in (c, two, three))
            total = counts if total is None else total + counts
        return total if found else None

    @staticmethod
    def place(g: np.ndarray) -> np.ndarray:
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (g >> np.uint64(49)).astype(np.int64)


def weigh(place: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[place]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


class Model:
    """Weights by language and place, biases, temperature and idf."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float = 1.0):
        self.languages, self.weights, self.bias, self.idf, self.temperature = languages, weights, bias, idf, temperature

    def predict(self, counts: np.ndarray | None) -> tuple[str, float]:
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        place = np.flatnonzero(counts)
        x = weigh(place, counts[place], self.idf)
        p = softmax((x @ self.weights[place] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], held: list[tuple[np.ndarray, np.ndarray, str]], languages: list[str], idf: np.ndarray) -> Model:
    """FTRL-proximal over the samples (place, count, language), then a temperature from the held ones."""
    k, of = len(languages), {x: i for i, x in enumerate(languages)}
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))  # the last place is the bias, without penalty

    def weights(place: np.ndarray) -> np.ndarray:
        zp = z[place]
        l1 = np.where(place == DIM, 0, L1)[:, None]
        return np.where(np.abs(zp) <= l1, 0.0, -(zp - np.sign(zp) * l1) / ((BETA + np.sqrt(n[place])) / ALPHA + np.where(place == DIM, 0, L2)[:, None]))

    ready = [(np.r_[p, DIM], np.r_[weigh(p, c, idf), 1.0], of[y]) for p, c, y in samples]
    for r in range(ROUNDS):
        for i in np.random.Generator(np.random.PCG64(r)).permutation(len(ready)):
            place, x, y = ready[i]
            w = weights(place)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            root = np.sqrt(n[place])
            n[place] += g * g
            z[place] += g - (np.sqrt(n[place]) - root) / ALPHA * w
    all_w = weights(np.arange(DIM + 1))
    model = Model(languages, all_w[:DIM], all_w[DIM], idf)
    logits = np.array([weigh(p, c, idf) @ model.weights[p] + model.bias for p, c, _ in held]).reshape(-1, k)
    truth = np.array([of[y] for _, _, y in held], int)
    if len(held):
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        model.temperature = min(np.exp(np.linspace(np.log(0.05), np.log(20), 121)).tolist(), key=loss)
    return model


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, df, n = Grams(), np.zeros(DIM, np.int64), 0
    for batch in batches:
        for x in batch.column(0):
            if (counts := grams(x.as_py() or "")) is not None:
                df += counts > 0
                n += 1
    # place -1 has the number of documents
    place = np.r_[-1, np.flatnonzero(df)]
    yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(np.r_[n, df[df > 0]], pa.int64())], ["place", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        rows = []
        for text, lang, o in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if (counts := grams(text or "")) is not None:
                place = np.flatnonzero(counts)
                rows.append((lang, o, place.astype(np.int32).tobytes(), counts[place].astype(np.int32).tobytes()))
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["lang", "o", "place", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: (doc_id, text, lang) of the training documents."""
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("o"))
    sizes = docs.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return Model([], np.zeros((DIM, 0)), np.zeros(0), np.zeros(DIM))
    seen = {r.place: r.n for r in docs.select("text").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}  # DIM + 1 rows at most
    df = np.zeros(DIM)
    for place, n in seen.items():
        if place >= 0:
            df[place] = n
    idf = np.log((1 + seen.get(-1, 0)) / (1 + df)) + 1
    # somewhat more than `sample` of each language by their hash, then exactly the first ones: no language yields to another
    wide = lambda n: min(1 << 40, (1 << 40) * (sample + 8 * math.isqrt(sample) + 64) // n)
    below = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(wide(r["count"])))])
    chosen = docs.where(F.col("o") < F.coalesce(F.try_element_at(below, F.col("lang")), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("o", F.xxhash64("text")))
    chosen = chosen.withColumn("nth", nth).where(F.col("nth") <= sample).select("text", "lang", "o")
    rows = sorted(chosen.mapInArrow(_features, "lang string, o long, place binary, n binary").collect(), key=lambda r: (r.o, r.lang, bytes(r.place)))
    ready, turn, held = [(np.frombuffer(r.place, np.int32), np.frombuffer(r.n, np.int32), r.lang) for r in rows], {}, []
    for r in rows:  # every fifth of a language is for calibration, its first four are not
        turn[r.lang] = turn.get(r.lang, 0) + 1
        held.append(turn[r.lang] % 5 == 0)
    languages = sorted({r.lang for r in rows})
    if not languages:
        return Model([], np.zeros((DIM, 0)), np.zeros(0), idf)
    return fit([x for x, h in zip(ready, held, strict=True) if not h], [x for x, h in zip(ready, held, strict=True) if h], languages, idf)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, lang_pred and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Grams(), shipped.value
        for batch in batches:
            found = [m.predict(grams(x.as_py() or "")) for x in batch.column(batch.num_columns - 1)]
            lang, score = zip(*found, strict=True) if found else ((), ())
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [f"c{i}" for i in range(len(cols) + 2)])

    slim = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1])
    return slim.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the documents that aren't held out."""
    docs = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(docs.where("NOT held_out AND doc_id IS NOT NULL").select("doc_id", "text", "lang"), sample)
    return predict(docs, model, ["doc_id", "held_out"])
