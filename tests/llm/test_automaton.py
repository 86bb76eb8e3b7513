import random

import pytest

from affinis.llm import automaton as A


def naive(reference, words):
    seen = {tuple(r[i:j]) for r in reference for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    return [max((n for n in range(1, e + 1) if tuple(words[e - n : e]) in seen), default=0) for e in range(1, len(words) + 1)]


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(60):
        reference = [[rng.randrange(3) for _ in range(rng.randrange(25))] for _ in range(3)]
        a = A.SuffixAutomaton()
        for r in reference:
            a.extend(r)
        words = [rng.randrange(4) for _ in range(40)]
        assert a.statistics(words) == naive(reference, words)


def test_spans_are_maximal():
    assert A.spans([1, 2, 3, 0, 1, 2], 2) == [(0, 3), (4, 6)] and A.spans([1, 2, 3, 2, 3], 2) == [(0, 5)]


def test_reference_spans_go(spark):
    ref = spark.createDataFrame([("a b c d e f",), (None,), ("x y z",)], "passage string")
    docs = spark.createDataFrame([(1, "p b c d e q"), (2, None), (3, "x  y z\n x y z"), (4, "a b c")], "doc_id long, text string")
    for most in (3, 1000):
        got = {r.doc_id: (r.text, r.n_removed) for r in A.remove_reference(docs, ref, "passage", 3, most).collect()}
        assert got == {1: ("p q", 4), 2: ("", 0), 3: ("", 6), 4: ("", 3)}
    assert A.remove_reference(docs, ref.limit(0), "passage").where("n_removed > 0").count() == 0
    with pytest.MonkeyPatch.context() as m, pytest.raises(ValueError, match="too large"):
        m.setattr(A, "REFERENCE_WORDS", 8)
        A.remove_reference(docs, ref, "passage")


def test_repeated_and_null_ids(spark):
    ref = spark.createDataFrame([("a b c d e f",)], "text string")
    docs = spark.createDataFrame([(1, "p a b c"), (1, "q r s t u v"), (None, "c d e x"), (None, "y")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.n_words, r.n_removed) for r in A.remove_reference(docs, ref, "text", 3).collect())
    assert got == [("1", "p", 4, 3), ("1", "q r s t u v", 6, 0), ("None", "x", 4, 3), ("None", "y", 1, 0)]
