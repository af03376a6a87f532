"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_duplicates, decontaminate, licences, near_duplicates, personal_data, pieces, quality, secrets, warc, word_duplicates
from .runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_duplicates.repeated_bytes(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.duplicate_classes(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_duplicates.repeated_words(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents")).drop("spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.capture_histories(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES: dict[str, Query] = {
    "op1_personal_data": op1_personal_data,
    "op2_decontamination": op2_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "pipeline": pipeline,
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(ws, i, i + least(len(ws), 10) - 1) AS g, least(len(ws), 10) AS m
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, list_slice(ws, i, i + m - 1) AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, sizes WHERE len(ws) >= m)),
hit AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

# The rules of the scan as (kind, pattern, group that is measured, its least length); letters in either case are spelt out.
_OP3_RULES = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google_api", "AIza[A-Za-z0-9_-]+", 0, 39),
    ("stripe", "[sr]k_live_[A-Za-z0-9]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
]
_OP3_CUTS = "\n  UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs, string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}')"
    for k, (kind, p, group, least) in enumerate(_OP3_RULES)
)
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS ({_OP3_CUTS}),
f AS (SELECT doc_id, k, kind, least, unnest(ms) AS m, unnest(gs) AS g,
  unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0))) AS a FROM c),
s AS (SELECT doc_id, k, a, kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(m) AS BIGINT) AS VARCHAR) AS said FROM f WHERE length(g) >= least),
n AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
  string_agg(said, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(said, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (doc_id)
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, k, substr(h, 1 + 2000 * k, 2098) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2000 + 1)) AS k FROM d)),
w AS (SELECT doc_id, 1000 * k + j AS i, substr(s, 1 + 2 * j, 100) AS g FROM (SELECT doc_id, k, s, unnest(range(0, least(1000, length(s) // 2 - 49))) AS j FROM b WHERE length(s) >= 100)),
least_id AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN least_id USING (g) WHERE m < doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i - p > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM gone),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, r, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY r), 0) AS a, a AS z FROM span
  UNION ALL SELECT doc_id, max(r) + 1, max(z), NULL FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 1 + 2 * gap.a, coalesce(2 * (gap.z - gap.a), length(h))), '' ORDER BY r) AS h FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN least_id ON a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(list_slice(ws, i, i + 34), ' ')) AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE c > 1)),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), n AS (SELECT *, len(ws) AS n FROM w),
pos AS (SELECT doc_id, n, ws, unnest(range(1, n + 1)) AS i FROM n),
w3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + 2)) AS c FROM pos WHERE i + 2 <= n),
r3 AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM w3 WHERE c > 1) GROUP BY doc_id),
w8 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + 7)) AS c FROM pos WHERE i + 7 <= n),
r8 AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM w8 WHERE c > 1) GROUP BY doc_id),
lw AS (SELECT doc_id, i, n, ws, greatest(40, n // 4 + 1) AS m FROM pos),
rl AS (SELECT DISTINCT doc_id FROM (
  SELECT doc_id, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + m - 1)) AS c FROM lw WHERE i + m - 1 <= n) WHERE c > 1),
f AS (
  SELECT n.doc_id, n.n, length(array_to_string(ws, '')) AS chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS dups,
    coalesce(r3.k, 0) AS k3, coalesce(r8.k, 0) AS k8, rl.doc_id IS NOT NULL AS long_repeat
  FROM n LEFT JOIN r3 USING (doc_id) LEFT JOIN r8 USING (doc_id) LEFT JOIN rl USING (doc_id)
), v AS (SELECT *, n < 50 OR 100 * k3 > 50 * n AS failed FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols,
  CAST(dups AS BIGINT) AS n_dup_lines, CAST(k3 AS BIGINT) AS n_repeat_words, failed AS base_failed,
  NOT failed AND k8 <= 0.3 * n AND NOT long_repeat AND symbols <= 0.4 * n AND chars >= 2.0 * n AND chars <= 14.0 * n AS kept
FROM v
"""

OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < keeper THEN keeper END AS refers_to
FROM q
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op3_secret_scan": OP3_SQL, "op4_suffix_array_dedup": OP4_SQL, "op5_near_duplicates": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op9_quality_rules": OP9_SQL, "op10_warc": OP10_SQL}
