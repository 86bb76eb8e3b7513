import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm import lm, recurrent

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_of(docs):
    """(doc_id, held_out, n_tokens, n_known, N, base) of each document, by the contract."""
    c, texts = collections.Counter(), 0
    for i, t in docs:
        if not is_held(i):
            c.update(words(t))
            texts += 1
    n, v = sum(c.values()) + texts, len(c) + (texts > 0)
    out = []
    for i, t in docs:
        ws = words(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((texts + 1) / (n + v + 1))
        out.append((i, is_held(i), len(ws) + 1, sum(c[w] > 0 for w in ws) + (texts > 0), n, round(base, 6)))
    return sorted(out, key=repr)


def score(spark, docs, **limits):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({k: F.lit("x") for k in ("row", "word", "tail", "c", "score")})
    return lm.score_documents(d, **limits).toPandas()


def base_rows(got):
    rows = [(None if r.doc_id != r.doc_id else int(r.doc_id), bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples()]
    return sorted(rows, key=repr)


def random_docs(n, size=60, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "ça", "x,", "日本", "\x00"] + [f"word{i}" for i in range(80)]
    chance = 1 / np.arange(1, len(vocabulary) + 1)
    return [(i, " ".join(rng.choice(vocabulary, rng.integers(0, size), p=chance / chance.sum()))) for i in range(n)]


def test_counts_and_base_score_on_edges(spark):
    docs = random_docs(60)
    docs += [(100, None), (101, ""), (102, " \t\n"), (None, "null id words"), (None, None), (7, "another text of id 7"), (7, "another text of id 7"), (103, "Long\nlonger " * 20000 + "Ünknown")]
    for known in (65536, 20):  # with few broadcast words most counts come by the join
        got = score(spark, docs, known=known, head=12, rounds=(1,), hidden=4)
        assert base_rows(got) == base_of(docs)
        assert np.isfinite(got.score).all() and (got.score <= 0).all()


def test_empty_table_and_no_training(spark):
    assert not len(score(spark, []))
    held = [i for i in range(100) if is_held(i)][:3]
    got = score(spark, [(i, "a b c") for i in held])
    assert base_rows(got) == base_of([(i, "a b c") for i in held]) and (got.base_score == 0).all()
    assert np.isfinite(got.score).all() and (got.score < 0).all()


def test_known_words_are_whole_levels(spark):
    words = {"a": 100, "b": 60, "c": 60, "d": 3, "e": 3, "f": 3, "g": 1}
    counts = spark.createDataFrame([(w.encode(), n) for w, n in words.items()], "word binary, c long")
    for known, want in ((100, "abcdefg"), (6, "abcdef"), (5, "abc"), (2, "a"), (0, "")):
        v = lm.vocabulary(counts, 4, known=known)
        assert v.known.to_pylist() == [x.encode() for x in want] and (v.n, v.v) == (234, 8)
        assert v.shape.tail_mass[0] == 1 + sum(n + 1 for w, n in words.items() if w not in want)


def test_broadcast_size_does_not_change_the_model(spark):
    docs = random_docs(50)
    a, b = (score(spark, docs, known=k, head=12, rounds=(1,), hidden=4).sort_values(["doc_id"]) for k in (65536, 20))
    assert np.allclose(a.score, b.score, atol=1e-4)


def tiny(seed=0, hidden=5):
    rng = np.random.default_rng(seed)
    shape = recurrent.Shape(np.array([50, 40, 30, 20, 10, 5, 4, 3, 2, 1]), 3, np.array([7.0, 3.0]), 4)
    p = {k: v.astype(np.float64) + 0.3 * rng.normal(size=v.shape) for k, v in recurrent.start(shape, hidden).items()}
    return rng, shape, p


def test_probabilities_add_up_to_one():
    rng, shape, p = tiny()
    hs = rng.normal(size=(3, 5))
    total = sum(np.exp(recurrent.outputs(p, shape, hs, np.full(3, t))[0]) for t in range(shape.head + 2))
    assert np.allclose(total, 1)
    fresh = recurrent.start(shape, 5)
    share = np.exp([recurrent.outputs(fresh, shape, np.zeros((1, 5), np.float32), np.array([t]))[0][0] for t in range(shape.head)])
    assert np.allclose(share, (shape.counts + 1) / ((shape.counts + 1).sum() + shape.tail_mass.sum()), rtol=1e-4)


def test_gradients_are_those_of_differences():
    rng, shape, p = tiny()
    t = recurrent.Trainer(p, shape, 6, 3)
    given, aim, counted, h0 = rng.integers(0, 12, (6, 3)), rng.integers(0, 12, (6, 3)), rng.random((6, 3)) < 0.9, rng.normal(size=(3, 5))
    g, _, _, met = t.gradients(given, aim, counted, h0)
    loss = lambda: t.gradients(given, aim, counted, h0)[2]
    for name, values in p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in values.shape)
            if name == "E":
                at = (int(rng.choice(met)), at[1])
            was = values[at]
            values[at] = was + 1e-2
            up = loss()
            values[at] = was - 1e-2
            down = loss()
            values[at] = was
            mine = g[name][np.searchsorted(met, at[0])][at[1]] if name == "E" else g[name][at]
            assert abs((down - up) / 2e-2 - mine) < 2e-3


@pytest.mark.parametrize(("lanes", "window"), [(1, 1), (2, 3), (7, 64), (1024, 5)])
def test_state_is_carried_across_windows(lanes, window):
    rng, shape, p = tiny()
    lengths = np.array([1, 9, 40, 3, 3, 70, 1])
    tokens = rng.integers(0, 12, lengths.sum())
    want, at = [], 0
    for n in lengths:  # one text and one step at a time
        h, before, total = np.zeros((1, 5)), shape.end, 0.0
        for t in tokens[at : at + n]:
            h = recurrent._step(p, p["E"][[before]], h)[0]
            total += recurrent.outputs(p, shape, h, np.array([t]))[0][0]
            before = t
        want.append(total)
        at += n
    assert np.allclose(recurrent.score(p, shape, tokens, lengths, lanes, window), want, atol=1e-3)


def test_training_learns_what_follows_what(spark):
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(30)]
    docs = []
    for i in range(400):
        a, ws = int(rng.integers(30)), []
        for _ in range(60):
            ws.append(names[a])
            a = (a * 7 + 3) % 30 if rng.random() < 0.9 else int(rng.integers(30))
        docs.append((i, " ".join(ws)))
    got = score(spark, docs)
    held = got[got.held_out]
    assert len(held) > 20 and held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.3
    again = score(spark, docs)
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score)


def test_averages_weigh_tasks_by_tokens(spark):
    docs = spark.createDataFrame(random_docs(40), "doc_id long, text string").repartition(5)
    counts = lm.word_counts(docs)
    voc = lm.vocabulary(counts, 40, head=20)
    one, five = lm.train(docs, voc, (1,), 10**9), lm.train(docs, voc, (1,), 1)
    start = recurrent.start(voc.shape)
    assert all(np.isfinite(m[k]).all() and m[k].shape == start[k].shape for m in (one, five) for k in start)
    assert np.abs(recurrent.flat(five) - recurrent.flat(start)).max() > 1e-3


def test_query(spark):
    from affinis.llm.queries import op11_lm_scoring

    got = op11_lm_scoring(spark, "/root/testdata/sf0.001").toPandas()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert list(got.columns) == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert base_rows(got) == base_of(docs)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
