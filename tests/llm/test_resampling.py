import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinis.llm import arrowwords, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target):
    """The contract, row by row."""

    def features(text):
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(ws), collections.Counter(zlib.crc32(x.encode()) % 10000 for x in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])

    rows = [(i, *features(t)) for i, t in docs]
    s, t = collections.Counter(), collections.Counter()
    for _, _, c in rows:
        s.update(c)
    for x in target:
        t.update(features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    scored = []
    for i, n, c in rows:
        k = sum(c.values())
        w = sum(gain[b] * m for b, m in c.items()) // k if k else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((n, i, k, w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    rank = {id(r): j + 1 for j, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((*r[1:], rank.get(id(r))) for r in scored), key=repr)


def found(spark, docs, target, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for name, value in more.items():
        d = d.withColumn(name, F.lit(value))
    out = resampling.resample(d, spark.createDataFrame([(x,) for x in target], "text string"))
    assert out.columns == ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    return sorted((tuple(r) for r in out.drop("n_words").collect()), key=repr)


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = ["Ab", "ça", "c3", "ΔΣ", "the", "x-y", "日本"] + [f"w{i}" for i in range(60)]
    return [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(n)]


def test_agrees_with_the_contract_on_edges(spark):
    docs = list(enumerate(texts(80)))
    docs += [(100, None), (101, ""), (102, "!!! ,,"), (103, "one"), (7, "other text of an id"), (None, "null id " * 20), (None, "second " * 25)]
    docs += [(200, docs[3][1]), (200, docs[3][1]), (201, "long " * 30000 + "Ébène\x00A\n" * 5)]
    target = texts(9, 2) + [None, ""]
    assert found(spark, docs, target, rows=1, part=2, first="x", row=3) == plain(docs, target)


def test_empty_tables(spark):
    assert found(spark, [], ["a b"]) == []
    docs = list(enumerate(texts(12)))
    assert found(spark, docs, []) == plain(docs, [])


def test_a_string_in_every_document_leaves_once_a_run(spark):
    docs = spark.createDataFrame([(i, f"hot line w{i}") for i in range(3000)], "doc_id long, text string").coalesce(3)
    table = resampling.feature_table(docs, parts=4)
    assert {r.part for r in table.where("rows IS NULL").collect()} == {0, 1, 2, 3}
    strings = sum(len(resampling.unpacked(r.strings)[0]) for r in table.where("rows IS NULL").collect())
    assert strings == 3 * 3 + 2 * 3000  # hot, line, hot line once for each run; w{i}, line w{i} for each document
    got = {r.bucket: r.n for r in resampling.bucket_counts(table).collect()}
    assert sum(got.values()) == 5 * 3000
    assert got[zlib.crc32(b"hot line") % 10000] >= 3000


def test_a_full_dictionary_starts_anew(spark, monkeypatch):
    monkeypatch.setattr(resampling, "DICTIONARY", 10)
    table = resampling._dictionaries(10_000)
    many = sorted(b"w%d" % i for i in range(50))
    batch = pa.concat_tables([pa.Table.from_batches([resampling._batch([(i, 0, resampling.fronted(pa.array(many, pa.binary())), b"", None)])]) for i in range(3)]).combine_chunks().to_batches()
    for out in table(iter(batch)):
        assert resampling.unpacked(out.column(2)[0].as_py())[0].tolist() == [zlib.crc32(x) % 10_000 for x in many]


def test_query_agrees_with_sql(spark):
    import duckdb

    from affinis.llm.queries import op12_resampling
    from affinis.llm.sql import OP12

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = op12_resampling(spark, d)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP12})").fetchall(), key=repr)


@pytest.mark.parametrize("limit", [1, 20, 1 << 20])
def test_words_of_runs(limit):
    column = pa.array(["Ab cD", None, "", "  é-É\t", "x", "y z", "\x00"])[0:]
    got = []
    for first, part in arrowwords.runs(column, limit):
        words, owner = arrowwords.words(part, arrowwords.ALPHANUMERIC)
        got += [(first + int(o), w.as_py().decode()) for o, w in zip(owner, words)]
    assert got == [(0, "ab"), (0, "cd"), (3, "é"), (3, "É"), (4, "x"), (5, "y"), (5, "z")]
    words, owner = arrowwords.words(pa.array(["z", "ab", "c"])[1:], arrowwords.NOT_SPACE)
    assert words.to_pylist() == [b"ab", b"c"] and owner.tolist() == [0, 1]


def test_packed_arrays():
    arrays = [np.array([], np.int64), np.array([0, 3, 70000]), np.arange(10)]
    assert all((a == b).all() for a, b in zip(arrays, resampling.unpacked(resampling.packed(*arrays)), strict=True))


def test_strings_without_their_common_beginnings():
    strings = sorted({b"a", b"ab", b"abc", b"b", "é x".encode(), "éx".encode(), b"long words share much, but 16 bytes at most", b"long words share much, and more", b"\xff" * 40})
    array = pa.array([b"zz", *strings, b"q"], pa.binary()).slice(1, len(strings))
    assert list(resampling.unfronted(resampling.fronted(array))) == strings
