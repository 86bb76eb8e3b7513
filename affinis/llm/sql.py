"""DuckDB SQL for the opN_<name> queries that SQL can express."""

from __future__ import annotations

from affinis.llm import mixing

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Counts from word and line lists; a line is boilerplate above 20 distinct documents and a tenth of its host's.
OP9 = rf"""
WITH d AS (
  SELECT doc_id, r, coalesce(CAST(doc_id AS VARCHAR), 'row ' || r) AS doc, coalesce(text, '') AS t, coalesce(source, '') AS host, {_WORDS} AS ws
  FROM (SELECT *, row_number() OVER () AS r FROM documents)
), tri AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), spots AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri
), covered AS (
  SELECT r, count(DISTINCT j) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM spots WHERE n > 1) GROUP BY r
), lines AS (
  SELECT r, doc, host, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, doc, host, unnest(string_split(t, chr(10))) AS line FROM d)
), lined AS (
  SELECT r, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup FROM lines GROUP BY r
), hosts AS (SELECT host, count(DISTINCT doc) AS n_docs FROM d GROUP BY host
), boiler AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc) AS c FROM lines WHERE norm <> '' GROUP BY host, norm) JOIN hosts USING (host)
  WHERE c > 20 AND c > n_docs * CAST(0.10 AS DOUBLE)
), gone AS (
  SELECT r, sum(n) AS n_gone FROM lines JOIN boiler USING (host, norm) GROUP BY r
), counted AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ws) - coalesce(n_gone, 0) AS BIGINT) AS kept_words
  FROM d LEFT JOIN covered USING (r) LEFT JOIN lined USING (r) LEFT JOIN gone USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_words >= n_words * CAST(0.5 AS DOUBLE) AS kept
FROM counted
"""



def _fill(name: str, source: str, parent: str, key: str, budget: str, out: str) -> str:
    """A table `name`: water filling of each parent's budget over its children in order of capacity / weight."""
    rows = f"PARTITION BY {parent} ORDER BY cap / w, {key} ROWS BETWEEN"
    return f"""{name}_level AS (
  SELECT *, ({budget} - coalesce(sum(cap) OVER ({rows} UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER ({rows} CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {source}
), {name}_first AS (
  SELECT *, first_value(CASE WHEN level * w < cap THEN level END IGNORE NULLS) OVER ({rows} UNBOUNDED PRECEDING AND CURRENT ROW) AS first FROM {name}_level
), {name} AS (
  SELECT *, CASE WHEN first IS NULL THEN cap ELSE least(cap, CAST(floor(first * w) AS BIGINT)) END AS {out} FROM {name}_first
)"""


def mixing_ctes(documents: str, share: float, epochs: int, seed: int, weights: dict[str, float]) -> str:
    """CTEs that end in `mixed`: doc_id, domain, n and copies of each document with a token."""
    given = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in sorted(weights.items()))
    return f"""given(path, gw) AS (VALUES {given}
), slim AS (
  SELECT doc_id, 'd' || (CAST('0x' || substr(md5(coalesce(source, '')), 1, 1) AS BIGINT) % 4) AS domain, coalesce(lang, '') AS language,
         coalesce(source, '') AS origin, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM {documents}
), leaf0 AS (
  SELECT domain, language, origin, CAST(sum(n) AS BIGINT) AS t, CAST(sum(n) * {epochs} AS BIGINT) AS cap FROM slim WHERE n > 0 GROUP BY ALL
), dom0 AS (
  SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, CAST(floor((SELECT sum(t) FROM leaf0) * CAST({share} AS DOUBLE)) AS BIGINT) AS b FROM leaf0 GROUP BY domain
), dom1 AS (SELECT d.*, 0 AS top, coalesce(gw, CAST(1 AS DOUBLE)) AS w FROM dom0 d LEFT JOIN given ON path = domain
), {_fill("dom", "dom1", "top", "domain", "b", "d_got")}, lang0 AS (
  SELECT domain, language, CAST(sum(cap) AS BIGINT) AS cap FROM leaf0 GROUP BY ALL
), lang1 AS (SELECT l.*, d_got, coalesce(gw, CAST(1 AS DOUBLE)) AS w FROM lang0 l JOIN dom USING (domain) LEFT JOIN given ON path = domain || '/' || language
), {_fill("lng", "lang1", "domain", "language", "d_got", "l_got")}, leaf1 AS (
  SELECT f.*, l_got, coalesce(gw, CAST(1 AS DOUBLE)) AS w FROM leaf0 f JOIN lng USING (domain, language)
  LEFT JOIN given ON path = domain || '/' || language || '/' || origin
), {_fill("leaf", "leaf1", "domain, language", "origin", "l_got", "budget")}, ordered AS (
  SELECT s.*, budget // t AS times, budget % t AS rest,
         CAST('0x' || substr(md5('{seed}:' || (budget // t + 1) || ':' || doc_id), 1, 10) AS BIGINT) AS o
  FROM slim s JOIN leaf USING (domain, language, origin) WHERE n > 0
), mixed AS (
  SELECT doc_id, domain, n, CAST(times + CASE WHEN sum(n) OVER (PARTITION BY domain, language, origin ORDER BY o, doc_id) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM ordered
)"""


OP8 = f"""WITH {mixing_ctes("documents", mixing.SHARE, mixing.EPOCHS, mixing.SEED, mixing.WEIGHTS)}
SELECT doc_id, domain AS mix_domain, n AS mix_tokens, copies AS mix_copies FROM mixed
UNION ALL SELECT doc_id, domain, n, 0 FROM slim WHERE n = 0"""

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (v >> {0}) % 32 AS BIGINT), 1)"
#: Five hex digits of SHA-1 are four base-32 digits.
OP4 = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, string_agg(q, '' ORDER BY i) AS digest FROM (
    SELECT page_id, i, {" || ".join(_DIGIT.format(k) for k in (15, 10, 5, 0))} AS q FROM (
      SELECT page_id, i, CAST('0x' || substr(h, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT) AS v FROM (SELECT page_id, h, unnest(range(0, 8)) AS i FROM p)
    )
  ) GROUP BY page_id
), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN p.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> first THEN first END AS refers_to
FROM p JOIN d USING (page_id) JOIN f USING (h)
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w
), gone AS (
  SELECT DISTINCT doc_id, i + o AS j FROM (SELECT doc_id, i, unnest(range(0, 20)) AS o FROM r WHERE k > 1)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.j = x.j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def crc32_table() -> list[int]:
    """What eight steps of the reflected polynomial 0xEDB88320 make of each byte."""
    out = list(range(256))
    for _ in range(8):
        out = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(g) + 1), lambda i: CAST('0x' || h[2 * i - 1 : 2 * i] AS BIGINT))), lambda c, b: xor({crc32_table()}[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _grams(name: str, table: str) -> str:
    """CTEs {name}_g (r, doc_id, n_words, g): a row for each run of one or two words of a text; g is null where there is none."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ident = "doc_id" if table == "documents" else "item_id AS doc_id"
    return rf"""{name}_w AS (SELECT row_number() OVER () AS r, {ident}, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {table}
), {name}_g AS (
  SELECT r, doc_id, len(ws) AS n_words, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END) AS g FROM {name}_w
)"""


#: Each distinct string gets its CRC-32 once; the CRC is a fold over the bytes of its hexadecimal form.
OP12 = f"""
WITH {_grams("d", "documents")}, {_grams("b", "benchmark")}, strings AS (
  SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM d_g WHERE g IS NOT NULL UNION SELECT g FROM b_g WHERE g IS NOT NULL)
), coded AS (SELECT g, {_CRC} % 10000 AS bucket FROM strings
), s AS (SELECT bucket, count(*) AS s FROM d_g JOIN coded USING (g) GROUP BY 1
), t AS (SELECT bucket, count(*) AS t FROM b_g JOIN coded USING (g) GROUP BY 1
), counts AS (
  SELECT x AS bucket, CAST(coalesce(s, 0) AS DOUBLE) AS s, CAST(coalesce(t, 0) AS DOUBLE) AS t FROM range(10000) r(x) LEFT JOIN s ON s.bucket = x LEFT JOIN t ON t.bucket = x
), gain AS (
  SELECT bucket, floor(CAST(1000 AS DOUBLE) * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000)))) AS gain FROM counts CROSS JOIN (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts)
), weights AS (
  SELECT r, doc_id, n_words, count(g) AS n_features, CAST(coalesce(floor(sum(gain) / nullif(CAST(count(g) AS DOUBLE), 0)), 0) AS BIGINT) AS weight
  FROM d_g LEFT JOIN coded USING (g) LEFT JOIN gain USING (bucket) GROUP BY r, doc_id, n_words
), scored AS (
  SELECT *, weight + CAST(floor(CAST(-1000 AS DOUBLE) * ln(-ln((CAST('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weights
), able AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS nth, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 25 * n // 100 THEN nth END AS rank FROM scored LEFT JOIN able USING (r)
"""


ORACLE = {"op4_warc": OP4, "op7_substring_dedup": OP7, "op1_top_k": OP1, "op8_mixing": OP8, "op9_quality_rules": OP9, "op12_resampling": OP12}
