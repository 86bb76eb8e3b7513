import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_pii import plain_mask, plain_spans
from test_simhash import naive_classes, naive_print

from affinis.llm import bpe, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(rows):
    norm = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")
    docs, holders = {}, {}
    for i, r in enumerate(rows):
        host, doc = r["source"] or "", r["doc_id"] if r["doc_id"] is not None else f"row {i}"
        docs.setdefault(host, set()).add(doc)
        for x in (r["text"] or "").split("\n"):
            if norm(x):
                holders.setdefault((host, norm(x)), set()).add(doc)
    hosts, seen = Counter({k: len(v) for k, v in docs.items()}), Counter({k: len(v) for k, v in holders.items()})
    out = []
    for r in rows:
        host, ws = r["source"] or "", WORD.findall(r["text"] or "")
        tri = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        again = {j for i, t in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if tri[t] > 1 for j in (i, i + 1, i + 2)}
        gone = lambda x, host=host: norm(x) and seen[host, norm(x)] > 20 and seen[host, norm(x)] > hosts[host] * 0.1
        text = "\n".join(x for x in (r["text"] or "").split("\n") if not gone(x))
        if len(ws) >= 50 and 100 * len(again) <= 50 * len(ws) and len(WORD.findall(text)) >= 0.5 * len(ws):
            out.append(dict(r, text=text, n_chars=len(text)))
    return out


def plain_dedup(rows):
    comp = naive_classes({r["doc_id"]: naive_print(r["text"]) for r in rows})
    return [r for r in rows if comp[r["doc_id"]] == r["doc_id"]]


def plain_mix(rows, share):
    """Water filling by repeated shares, then prefixes in hash order."""
    from test_mixing import naive_fill

    h = lambda s: hashlib.md5(s.encode()).hexdigest()
    leaf = {}
    for r in rows:
        s = r["source"] or ""
        n = len(WORD.findall(r["text"]))
        if n:
            leaf.setdefault((f"d{int(h(s)[0], 16) % 4}", r["lang"] or "", s), []).append((r["doc_id"], n))
    size = {k: sum(n for _, n in v) for k, v in leaf.items()}
    w = lambda *p: mixing.WEIGHTS.get("/".join(p), 1.0)

    def share_out(budget, depth, prefix):
        kids = sorted({k[: depth + 1] for k in size if k[:depth] == prefix})
        got = naive_fill(budget, {k: sum(n for x, n in size.items() if x[: depth + 1] == k) for k in kids}, {k: w(*k) for k in kids})
        return {k: int(v + 1e-6) for k, v in got.items()}

    taken = set()
    for d, bd in share_out(int(sum(size.values()) * share), 0, ()).items():
        for lg, bl in share_out(bd, 1, d).items():
            for k, b in share_out(bl, 2, lg).items():
                times, rest = divmod(b, size[k])
                up = 0
                for i, n in sorted(leaf[k], key=lambda x: (int(h(f"{mixing.SEED}:{times + 1}:{x[0]}")[:10], 16), x[0])):
                    up += n
                    if times or up <= rest:
                        taken.add(i)
    return [r for r in rows if r["doc_id"] in taken]


def test_pipeline_equals_a_plain_version(spark):
    d = "/root/testdata/sf0.01"
    rows = [r.asDict() for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = plain_dedup(plain_quality(rows))
    masked = {r["doc_id"]: plain_mask(r["text"], plain_spans(r["text"])) for r in want}
    assert any(masked[r["doc_id"]] != r["text"] for r in want)
    want = plain_mix([dict(r, text=masked[r["doc_id"]]) for r in want], corpus_pipeline.MIX_SHARE)
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert sorted(out) == sorted(r["doc_id"] for r in want)
    for r in want:
        ids = enc.encode_ordinary(r["text"])
        assert out[r["doc_id"]].n_tokens == len(ids)
        assert out[r["doc_id"]].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[r["doc_id"]].decoded_sha256 == hashlib.sha256(r["text"].encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    assert zlib.crc32(b"") == 0
    rows = [(1, "w" + " w%d" % 1, "en", "s", 3, 0), (2, None, None, None, None, 1), (3, " ".join("v%d" % i for i in range(80)), "en", None, 3, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, host int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "host"]


def through(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, host int, t string"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    return corpus_pipeline.run(spark, f"file://{tmp_path}").collect()


def test_an_empty_table_and_one_of_nulls(spark, tmp_path):
    assert through(spark, tmp_path / "a", []) == []
    assert through(spark, tmp_path / "b", [(None,) * 7] * 3 + [(1, None, "en", "s", 0, 1, "t"), (2, "", None, None, 0, 1, "t")]) == []


def test_repeated_ids_null_ids_and_long_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "MIX_SHARE", 1.0)
    text = lambda tag, n=80: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, text("a"), "en", "s", 9, 0, "x")] * 2 + [(1, text("b"), "en", "s", 9, 0, "x"), (None, text("c"), None, None, 9, 0, "x"), (4, text("d", 60_000), "de", "s2", 9, 0, "x"), (5, text("a"), "en", "s", 9, 0, "y")]
    rows += [(6, text("e") + " joe@x.org", "en", "s", 9, 0, "z")]
    got = through(spark, tmp_path, rows)
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "4", "6", "None"]
    digest = {r.decoded_sha256 for r in got}
    assert digest == {hashlib.sha256(t.encode()).hexdigest() for t in (text("a"), text("b"), text("c"), text("d", 60_000), text("e") + " <EMAIL>")}


def test_a_text_survives_another_text_of_its_id_that_has_a_copy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "MIX_SHARE", 1.0)
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(80))
    rows = [(3, text("a"), "en", "s", 9, 0, "x"), (7, text("a"), "en", "s", 9, 0, "x"), (7, text("b"), "en", "s", 9, 0, "x")]
    got = through(spark, tmp_path, rows)
    assert sorted((r.doc_id, r.decoded_sha256) for r in got) == sorted((i, hashlib.sha256(text(t).encode()).hexdigest()) for i, t in ((3, "a"), (7, "b")))
