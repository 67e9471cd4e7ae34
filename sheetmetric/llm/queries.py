"""Registered queries of this folder, each over its whole table with production parameters."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sheetmetric.llm import bpe, collocations, extract, jaccard, packing, quality, resample, secrets, topk, toxicity, urls, warc, wordpiece
from sheetmetric.llm.text import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_topk": op2_exact_topk,
    "op3_url_filters": op3_url_filters,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_secret_scans": op6_secret_scans,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_quality_rules": op8_quality_rules,
    "op9_html_extraction": op9_html_extraction,
    "op10_token_counts": op10_token_counts,
    "op11_collocations": op11_collocations,
    "op12_resampling": op12_resampling,
    "op13_warc": op13_warc,
}

WORDS = r"'[^\x20\x09-\x0D]+'"

RULE_ROWS = ", ".join(f"('{r.host}', '{r.path}', '{r.text}', '{r.verdict}')" for r in urls.RULES)

ORACLES: dict[str, str] = {
    "op2_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op3_url_filters": rf"""
WITH rules(rhost, rpath, rule, verdict) AS (VALUES {RULE_ROWS}),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM (
  SELECT page_id, host, path, (
    SELECT max(struct_pack(n := length(rhost) + length(rpath), v := verdict, rule := rule, verdict := verdict)) FROM rules
    WHERE host <> '' AND (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best
  FROM p)""",
    "op7_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(other) AS component_id FROM reach GROUP BY id) c USING (doc_id)""",
    "op8_quality_rules": rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) x(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS shouted
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR (n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines) OR 10 * shouted > n_words) AS kept
FROM f""".replace("\\\\", "\\"),
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS MATERIALIZED (
  SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, any_value(ws[i:i + size - 1]) AS ws, count(*) AS n
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (VALUES (1), (2), (3)) x(size)) GROUP BY lang, size, phrase),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM g WHERE size > 1 AND n >= 10),
cover AS (
  SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(n) AS most FROM c, (VALUES (1), (2)) x(i) WHERE size = 3 GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN cover ON c.size = 2 AND c.lang = cover.lang AND c.phrase = cover.phrase WHERE most IS NULL OR 100 * most < 50 * c.n),
cuts AS (
  SELECT k.lang, k.phrase, k.n AS a, cut, l.n AS l, r.n AS r, CAST(1000000 * k.n::HUGEINT * k.n // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS cut FROM kept) k
  JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:cut], ' ') JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n, score
FROM best JOIN total USING (lang) QUALIFY rank <= 2000""",
    "op12_resampling": r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda k: CAST(k AS BIGINT))),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (
  SELECT 's' AS part, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
w AS (
  SELECT part, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts),
f AS (
  SELECT part, id, unnest(ws) AS feature FROM w
  UNION ALL SELECT part, id, ws[i] || ' ' || ws[i + 1] FROM (SELECT part, id, ws, unnest(range(1, len(ws))) AS i FROM w)),
distinct_f AS MATERIALIZED (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM f),
bytes AS (
  SELECT feature, list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i:
    CAST(16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT))) AS b FROM distinct_f),
crc AS MATERIALIZED (
  SELECT feature, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, steps),
g AS MATERIALIZED (SELECT part, id, bucket FROM f JOIN crc USING (feature)),
sizes AS (SELECT count(*) FILTER (part = 's') AS s, count(*) FILTER (part = 't') AS t FROM g),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((count(*) FILTER (part = 't') + 1) * (any_value(sizes.s) + 10000) AS DOUBLE)
    / CAST((count(*) FILTER (part = 's') + 1) * (any_value(sizes.t) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM g, sizes GROUP BY bucket),
per_doc AS (SELECT id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM g JOIN gain USING (bucket) WHERE part = 's' GROUP BY id),
h AS (
  SELECT doc_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', sha256('7:' || doc_id)[i]) - 1 AS BIGINT))),
    lambda a, b: 16 * a + b) AS h FROM documents),
scored AS (
  SELECT h.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= 20 AS able,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h.h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM h JOIN w ON w.part = 's' AND w.id = h.doc_id LEFT JOIN per_doc ON per_doc.id = h.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n_able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n_able // 100 THEN place END AS rank FROM r""",
    "op13_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
}
