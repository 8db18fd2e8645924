"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfold.llm import alignment, bpe, fertility, htmltext, langid, media, mixing, neardup, packing, quality, resample, secrets, toxicity
from peakfold.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_documents(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("row", "live", "examples")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    return quality.score_quality(table(spark, sf_dir, "documents"), ratings)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, docs.select("doc_id", "lang"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, loss=packing.LOSS, loss_mask=packing.word_mask(path))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def base2_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_media that SQL can express."""
    return op2_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def base7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_fertility that SQL can express."""
    return op7_fertility(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_media, op3_secrets, op4_html, op5_quality, op6_toxicity, op7_fertility, op8_neardup, op9_langid, op10_packing, op11_mixing, op12_alignment, op13_resample, base2_payload, base7_rules)}

_WORD = r"[^\x20\x09-\x0D]+"


def _matches(kind: int, pattern: str, group: int = 0, keep: str = "true") -> str:
    """Rows (doc_id, kind, start, end, value) of a pattern's matches: the text between them and they themselves end to end."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, (list_sum(list_transform(g[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: len(x))), 0))::BIGINT AS start, w[k] AS whole, v[k] AS value
FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS w, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM docs WHERE regexp_matches(t, '{p}')), unnest(range(1, len(w) + 1)) AS u(k) WHERE {keep}"""


_RANDOM = "(regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '[A-Za-z]') AND len(list_distinct(string_split({0}, ''))) >= 8)"
_SECRETS = f"""WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({_matches(0, secrets.ASSIGN, 2, "len(v[k]) >= 8")}
UNION ALL {_matches(1, secrets.ACCESS)}
UNION ALL {_matches(2, secrets.HEX)}
UNION ALL {_matches(9, secrets.TOKEN, 0, _RANDOM.format("v[k]"))}),
base AS (SELECT doc_id, kind, start, start + len(whole) AS stop FROM found WHERE kind < 9),
cand AS (SELECT DISTINCT f.doc_id, source, start + len(whole) - len(value) AS start, start + len(whole) AS stop, value, {_RANDOM.format("value")} AS random FROM found f JOIN docs d ON d.doc_id = f.doc_id),
own AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos FROM cand GROUP BY 1),
judged AS (SELECT DISTINCT doc_id, CASE WHEN owners >= {secrets.COPIED_OWNERS} OR repos >= {secrets.COPIED_REPOS} THEN 4 WHEN owners <= {secrets.OWN_OWNERS} AND repos <= {secrets.OWN_REPOS} AND random THEN 3 END AS kind, start, stop FROM cand c JOIN own o ON o.value = c.value),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM judged WHERE kind IS NOT NULL),
named AS (SELECT *, ['assign', 'access', 'hex', 'owned', 'copied'][kind + 1] || ':' || start || ':' || stop AS name FROM spans),
listed AS (SELECT doc_id, string_agg(name, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS b, string_agg(name, ',' ORDER BY start, kind, stop) AS a, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3, count(*) FILTER (kind = 4) AS n4 FROM named GROUP BY 1)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n3, 0) AS n_owned, coalesce(n4, 0) AS n_copied FROM docs d LEFT JOIN listed l ON l.doc_id = d.doc_id"""

_PAYLOAD = """SELECT doc_id, octet_length(b) AS n_bytes, p AS payload_bytes, sha256(b || repeat('\\x00'::BLOB, p - octet_length(b))) AS payload_sha256
FROM (SELECT doc_id, b, greatest(64, (octet_length(b) + 63) // 64 * 64) AS p FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents))"""

_RULES = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w FROM docs),
three AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS x FROM split, unnest(range(1, len(w) - 1)) AS u(k)),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, x) AS n FROM three) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM twice, unnest([0, 1, 2]) AS u(j) GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM docs),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM line WHERE regexp_matches(x, '{_WORD}') GROUP BY 1)
SELECT s.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM split s LEFT JOIN rep r ON r.doc_id = s.doc_id LEFT JOIN dup d ON d.doc_id = s.doc_id"""

_NEAR = f"""WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
item AS (SELECT DISTINCT doc_id, md5(CASE WHEN len(w) >= 3 THEN w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] ELSE array_to_string(w, ' ') END) AS x FROM split, unnest(range(1, greatest(len(w) - 1, 2))) AS u(k) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM item GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM item a JOIN item b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common c JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
adj AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS id, a AS r FROM adj UNION SELECT reach.id, adj.b FROM reach JOIN adj ON adj.a = reach.r),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN comp c ON c.id = d.doc_id"""

_MIX = f"""WITH RECURSIVE docs AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
keyed AS (SELECT doc_id, src, size, -ln((('0x' || substr(md5('{mixing.SEED}:' || doc_id || ':' || md5(t)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496) / CASE WHEN size = 0 THEN 0.1 ELSE least(1.0, greatest(0.1, len(regexp_extract_all(t, '\\p{{L}}+'))::DOUBLE / size)) END AS key FROM docs),
src AS (SELECT src, sum(size)::BIGINT AS n, [3, 1, 2][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w FROM keyed GROUP BY 1),
shared(round, level, capped) AS (SELECT 0, 1.5::DOUBLE * sum(n) / sum(w), list(NULL::VARCHAR) FILTER (false) FROM src
 UNION ALL SELECT s.round + 1, x.level, x.capped FROM shared s, LATERAL (SELECT (1.5::DOUBLE * (SELECT sum(n) FROM src) - coalesce(sum(2 * n) FILTER (2 * n / w::DOUBLE <= s.level), 0)) / sum(w) FILTER (2 * n / w::DOUBLE > s.level) AS level, list(src ORDER BY src) FILTER (2 * n / w::DOUBLE <= s.level) AS capped FROM src) x WHERE x.capped IS DISTINCT FROM s.capped AND s.round < 1000),
plan AS (SELECT src, n, CASE WHEN 2 * n / w::DOUBLE <= level OR level IS NULL THEN 2.0 * n ELSE w * level END::DOUBLE AS target FROM src, (SELECT arg_max(level, round) AS level FROM shared)),
lined AS (SELECT k.doc_id, k.size, p.n, p.target, CASE WHEN p.n > 0 THEN floor(p.target / p.n) ELSE 0 END::BIGINT AS epochs, sum(size) OVER (PARTITION BY k.src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS done FROM keyed k JOIN plan p ON p.src = k.src)
SELECT doc_id, size, n AS source_size, target, (size * (epochs + CASE WHEN 2 * done - size <= 2 * (target - epochs * n) THEN 1 ELSE 0 END))::BIGINT AS taken, epochs FROM lined"""

_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
_RESAMPLE = f"""WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc),
split AS (SELECT 0 AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
 UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
word AS (SELECT k, doc_id, unnest(ws) AS w FROM split),
code AS (SELECT w, {_CRC} % 10000 AS b FROM (SELECT DISTINCT w FROM word), tab),
hold AS (SELECT b, count(*) FILTER (k = 0) AS s, count(*) FILTER (k = 1) AS t FROM word JOIN code USING (w) GROUP BY 1),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM hold),
mean AS (SELECT doc_id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM word JOIN code USING (w) JOIN gain USING (b) WHERE k = 0 GROUP BY 1),
scored AS (SELECT s.doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || s.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM split s LEFT JOIN mean m ON m.doc_id = s.doc_id WHERE k = 0),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id"""

#: Whole results of op3 and op8, and of the others what SQL can express.
ORACLE_SQL: dict[str, str] = {"op3_secrets": _SECRETS, "op8_neardup": _NEAR, "base2_payload": _PAYLOAD, "base7_rules": _RULES, "op11_mixing": _MIX, "op13_resample": _RESAMPLE}
