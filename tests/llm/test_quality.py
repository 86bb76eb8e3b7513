import corpus_pipeline
import pytest
from test_pipeline import plain_quality

from affinis.llm import quality

LONG = " ".join(f"w{i}" for i in range(70))
TEXTS = [None, "", " \n\t\n", "a b c", "x y z " * 30, LONG, LONG + "\n" + LONG, "# $ * \n#\n#", "é𝄞 " * 60, "\n".join(["same line here"] * 40), "a b c a b c", "v " * 30000]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, 1) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string, host int, lines int")


def test_base_counts_by_hand(spark):
    got = {r.doc_id: r for r in quality.assess(docs(spark, [(t, "s") for t in TEXTS])).collect()}
    assert [got[i].n_words for i in range(5)] == [0, 0, 0, 3, 90]
    assert got[4].n_repeat_words == 90 and got[4].base_failed and got[5].n_repeat_words == 0 and got[5].kept
    assert got[6].n_dup_lines == 1 and got[6].n_repeat_words == 140
    assert got[7].n_symbols == 5 and got[7].n_dup_lines == 1 and got[8].word_chars == 120
    assert got[9].n_dup_lines == 39 and got[10].n_repeat_words == 6 and got[11].n_repeat_words == 30000
    assert not got[0].kept and got[0].base_failed


@pytest.mark.parametrize("copies", [15, 40])
def test_boilerplate_lines_and_depleted_documents(spark, copies):
    head = "Accept   all COOKIES " + " ".join(f"c{i}" for i in range(60))
    rows = []
    for i in range(copies):
        own = " ".join(f"d{i}x{j}" for j in range(80 if i % 2 else 20))
        rows.append((f"{head if i % 3 else head.lower()}\n{own}", "host" if i % 5 else None))
    rows += [(" ".join(f"e{i}x{j}" for j in range(60)), "host") for i in range(20)]
    df = docs(spark, rows)
    want = {r["doc_id"]: r["text"] for r in plain_quality([r.asDict() for r in df.collect()])}
    kept = quality.filter_documents(df)
    assert kept.columns == df.columns
    assert {r.doc_id: r.text for r in kept.collect()} == want
    assert any("cookies" not in t.lower() for t in want.values()) if copies == 40 else all("\n" in t for i, t in want.items() if i < copies)


def test_empty_table(spark):
    assert quality.assess(docs(spark, []).limit(0)).collect() == []


def test_a_group_of_copies_leaves_one_document(spark):
    """A third of all rows are copies, and another third near copies, of several lines; a real common line still goes."""
    lines = lambda tag: [" ".join(f"{tag}{k}x{j}" for j in range(40)) for k in range(8)]
    head = "Accept all cookies of this host"
    near = [[*lines("near"), f"one{i}"] for i in range(40)]
    rows = ["\n".join(lines("copy"))] * 40 + ["\n".join(x) for x in near] + [head + "\n" + " ".join(f"d{i}x{j}" for j in range(80)) for i in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = df
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, out, "")
        if name == "quality_rules":
            out = out.cache()
            assert out.count() == 120
    got = {r.doc_id: r.text for r in out.collect()}
    assert sorted(i for i in got if i < 80) == [0, 40] and len(got) == 42
    assert not any(head in t for t in got.values())


def test_a_line_counts_distinct_documents(spark):
    """One doc_id 30 times is one document; 30 rows without an id are 30."""
    head = " ".join(f"h{i}" for i in range(60))
    rows = [(7, f"{head}\n{LONG}", "s")] * 30 + [(100 + i, " ".join(f"e{i}x{j}" for j in range(60)), "s") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert quality.boilerplate(df, "source", 20, 0.1).collect() == []
    out = quality.assess(df).where("doc_id = 7").collect()
    assert len(out) == 30 and all(r.kept and r.kept_words == r.n_words for r in out)
    alone = df.selectExpr("nullif(doc_id, 7) AS doc_id", "text", "source")
    assert [len(r.lines) for r in quality.boilerplate(alone, "source", 20, 0.1).collect()] == [2]
    assert {r.kept for r in quality.assess(alone).where("doc_id IS NULL").collect()} == {False}
    assert {r["doc_id"] for r in plain_quality([r.asDict() for r in alone.collect()])} == set(range(100, 140))


def test_lists_too_long_to_broadcast_are_joined(spark):
    rows = [(" ".join(f"x{j}" for j in range(60)) + f"\nown{i} " + LONG, f"s{i % 2}") for i in range(60)]
    df = docs(spark, rows)
    want = sorted(map(tuple, quality.assess(df).collect()))
    assert sorted(map(tuple, quality.assess(df, broadcast_lines=1).collect())) == want and any(r[-3] != r[-5] for r in want)


def test_repeated_words_of_very_long_texts_take_linear_time(spark):
    import time

    text = " ".join(f"w{i}" for i in range(200_000))
    began = time.monotonic()
    got = quality.assess(docs(spark, [(f"{text} {text}", "s")])).first()
    assert got.n_repeat_words == 400_000 and time.monotonic() - began < 60


def test_columns_named_like_results_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", "s", "own", -1, "other")], "doc_id long, text string, source string, kept string, n_words int, t string")
    got = quality.assess(df).first()
    assert (got.kept, got.n_words, got.t) == (False, 2, "other")
    assert quality.filter_documents(df).columns == df.columns
