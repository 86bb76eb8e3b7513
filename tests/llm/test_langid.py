import zlib

import numpy as np

from affinis.llm import langid, queries


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and docs[r.doc_id].lang and any(c.isalpha() for c in docs[r.doc_id].text or "")]
    right = [r.lang_pred == docs[r.doc_id].lang for r in test]
    assert np.mean(right) > 0.97
    # calibration: mean score is near accuracy
    assert abs(np.mean([r.score for r in test]) - np.mean(right)) < 0.05


def test_l1_makes_weights_sparse_and_grams_count_whole_texts(monkeypatch):
    rng = np.random.default_rng(0)
    data = [(np.sort(rng.choice(2000, 40, replace=False)) + 5000 * y, np.ones(40, int), "ab"[y]) for y in (0, 1) for _ in range(50)]
    model = langid.fit(data[:40] + data[50:90], data[40:50] + data[90:], ["a", "b"], np.ones(langid.DIM))
    assert (model.weights == 0).mean() > 0.8 and model.temperature > 0
    whole = langid.Grams()("ab cd " * 1000)
    assert whole.sum() == 6000 + 5999 + 5998
    assert langid.Grams()("12 !?") is None


def test_nothing_to_learn_nulls_and_extra_columns(spark):
    rows = [(1, None, "en", "x", 1), (2, "12 34", "en", "x", 1), (3, "abc", None, "x", 1), (None, "abc", None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (None, "und", 0.0)], key=str)
    assert langid.identify(df.limit(0)).collect() == []


def test_very_long_texts_are_read_whole(spark):
    rows = [(i, ("the and of " if i % 2 else "der und die ") * 40, "en" if i % 2 else "de") for i in range(120)]
    rows += [(1000, "1 " * 400_000 + "der und die ", None), (1001, "x" * 300_000 + " the and of" * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert got[1000] == "de" and got[1001] == "en" and all(got[i] == ("en" if i % 2 else "de") for i in range(120))


def plain_counts(text):
    """Hashed 1- to 3-grams of the text's letters, all else one space, in Python integers."""
    kept = []
    for ch in text.lower():
        if ch.isalpha() or not kept or kept[-1] != 32:
            kept.append(ord(ch) if ch.isalpha() else 32)
    out = {}
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            g = 0
            for c in kept[i : i + n]:
                g = (g * 0x9E3779B97F4A7C15 + c) % 2**64
            g = (g ^ (g >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
            out[g >> 49] = out.get(g >> 49, 0) + 1
    return out


def test_counts_do_not_depend_on_chunks(monkeypatch):
    text = "Été — 12 ab, cd!  ÀÉ\n" * 40 + "..." * 30 + "zz  y"
    want = plain_counts(text)
    for chunk in (1, 2, 3, 7, 1 << 18):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        counts = langid.Grams()(text)
        assert {int(p): int(counts[p]) for p in np.flatnonzero(counts)} == want


def test_predictions_equal_a_plain_scorer(spark):
    """lang_pred and score of the query, recomputed from the fitted weights in plain Python."""
    import math

    d = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{d}/documents.parquet")
    model = langid.train(df.where(~langid.held_out(langid.F.col("doc_id"))).select("doc_id", "text", "lang"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op2_language_id(spark, d).collect()}
    for r in df.collect():
        text = r.text or ""
        if not any(c.isalpha() for c in text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        x = {p: (1 + math.log(n)) * model.idf[p] for p, n in plain_counts(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        logits = [(sum(v / norm * model.weights[p, k] for p, v in x.items()) + model.bias[k]) / model.temperature for k in range(len(model.languages))]
        e = [math.exp(v - max(logits)) for v in logits]
        best = max(range(len(e)), key=lambda k: e[k])
        lang, score = got[r.doc_id]
        assert lang == model.languages[best] and abs(score - e[best] / sum(e)) < 1e-9


def test_many_languages_ties_and_repeated_rows(spark):
    rows = [(i, chr(0x4E00 + i % 250) * 20, f"l{i % 250:03}") for i in range(1000)] + [(5000, "zzz", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == [f"l{i:03}" for i in range(250)]
    assert langid.Model(["a", "b"], np.zeros((langid.DIM, 2)), np.zeros(2), np.ones(langid.DIM)).predict(langid.Grams()("x")) == ("a", 0.5)
    pred = langid.predict(df, model, ["doc_id"]).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % 250:03}" for r in pred if r.doc_id < 1000]) > 0.9  # the temperature is fitted to one in five
    assert len({(r.lang_pred, r.score) for r in pred if r.doc_id == 5000}) == 1


def test_a_language_with_one_document_is_learned_whatever_its_id(spark):
    en, es = "the quick brown fox jumps over the lazy dog and then some", "el perro come la comida de la casa y luego duerme un rato"
    ru = "съешь же ещё этих мягких французских булок да выпей чаю"
    many = [(i, f"{en} {i}", "en") for i in range(1000, 1030)] + [(i, f"{es} {i}", "es") for i in range(2000, 2030)]
    ids = [i for i in range(60) if not spark.range(1).select(langid.held_out(langid.F.lit(i))).first()[0]][:20]
    for i in ids[:3]:
        m = langid.train(spark.createDataFrame([*many, (i, ru, "ru")], "doc_id long, text string, lang string"))
        assert m.languages == ["en", "es", "ru"] and m.predict(langid.Grams()(ru))[0] == "ru"
    # every place among the samples: ids stand in for hashes, so the rest need no model of their own
    for i in ids[3:]:
        assert langid.train(spark.createDataFrame([(i, ru, "ru"), *many[:2], *many[-2:]], "doc_id long, text string, lang string"), 2).languages == ["en", "es", "ru"]


def test_the_sample_is_bounded_for_each_language(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda samples, held, languages, idf: seen.append((samples, held, languages)))
    docs = [(i, f"text number {i}", f"l{i % 3}") for i in range(300)] + [(1000 + i, f"rare text {i}", f"r{i}") for i in range(30)]
    langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), 20)
    samples, held, languages = seen[0]
    count = lambda rows: {x: sum(r[2] == x for r in rows) for x in languages}
    assert len(languages) == 33 and all(count(samples)[f"r{i}"] == 1 for i in range(30))
    assert all((count(samples)[f"l{i}"], count(held)[f"l{i}"]) == (16, 4) for i in range(3))
