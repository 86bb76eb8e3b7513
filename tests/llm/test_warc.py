import base64
import gzip
import hashlib
import random

import pytest

from affinis.llm import queries, warc


def naive(pages, least=0):
    first, out = {}, {}
    for i, html in sorted(pages.items()):
        p = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(p).digest()).decode()
        if len(p) >= least and d in first:
            out[i] = (len(p), d, "revisit", first[d])
        else:
            out[i] = (len(p), d, "response", None)
            if len(p) >= least:
                first[d] = i
    return out


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least, tmp_path):
    rng = random.Random(2)
    pages = {i: rng.choice([None, "", "a", "<p>é𝄞</p>", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n", "line\nline\r\n", "x" * 100_000, f"own {i}"]) for i in range(80)}
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"http://x/{i}\r\n", h, "d") for i, h in pages.items()], "page_id long, url string, html string, digest string").repartition(3)
    rows = warc.round_trip(df, f"file://{tmp_path}/a", least).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == naive(pages, least)
    assert len(rows) == len(pages) and all(r.intact for r in rows)
    files = list((tmp_path / "a").rglob("*.gz"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID") for f in files) == len(pages)


def test_query_and_empty(spark):
    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op4_warc(spark, d).collect()}
    assert got == naive(pages)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    monkeypatch.setattr(warc, "STEPS", [100, 1000])
    pages = {i: "x%d " % i * (1 + (i * 37) % 300) for i in range(200)} | {900: "y" * 9000, 901: "y" * 9000, 902: None}
    df = spark.createDataFrame([(i, "u", h) for i, h in pages.items()], "page_id long, url string, html string").coalesce(1)
    rows = warc.round_trip(df, f"file://{tmp_path}/a").collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == naive(pages)
    sizes = [[len(p) for _, p in warc.parse(f.read_bytes())] for f in (tmp_path / "a").rglob("*.gz")]
    assert all(sum(s) <= 4000 or len(s) == 1 for s in sizes) and max(map(len, sizes)) > 10
    assert {int(f.parent.name[5:]) for f in (tmp_path / "a").rglob("*.gz")} == {0, 1, 2}


def test_a_broken_record_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "def")], "page_id long, url string, html string").coalesce(1)
    warc.write(df, f"file://{tmp_path}/a")
    (file,) = (tmp_path / "a").rglob("*.gz")
    whole = gzip.decompress(file.read_bytes())
    assert {r.page_id: r.intact for r in warc.read(spark, f"file://{tmp_path}/a").collect()} == {1: True, 2: True}
    with pytest.raises(ValueError, match="early"):
        list(warc.parse(gzip.compress(whole[:-6])))
    assert [p for _, p in warc.parse(gzip.compress(whole[:100]) + gzip.compress(whole[100:]))] == [b"abc", b"def"]
    (file.parent / f".{file.name}.crc").unlink()
    file.write_bytes(gzip.compress(whole.replace(b"abc", b"abd")))
    with pytest.MonkeyPatch.context() as m, pytest.raises(Exception, match="broken record of page 1"):
        m.setattr(warc, "write", lambda *_: None)
        warc.round_trip(df, f"file://{tmp_path}/a")


def test_repeated_and_null_ids(spark):
    rows = [(1, "same"), (1, "same"), (2, "same"), (2, "same"), (None, "same"), (None, "none"), (None, "none"), (1, "other")]
    df = spark.createDataFrame([(i, "u", h, "x") for i, h in rows], "page_id long, url string, html string, refers_to string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == sorted([("1", 4, "response", None), ("1", 4, "response", None), ("2", 4, "revisit", 1), ("2", 4, "revisit", 1), ("None", 4, "response", None),
                          ("None", 4, "response", None), ("None", 4, "response", None), ("1", 5, "response", None)], key=str)
