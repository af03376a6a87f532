"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import lint
from ..operators import retrieval as R
from ..operators.numbering import running
from ..session import EngineConfig, table
from ..storage import stored

TERMS = ["licensed", "version", "the", "password"]
_LIST = "['" + "', '".join(TERMS) + "']"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _title():
    return F.regexp_extract("text", r"^([^\n]*)", 1)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.term_counts(table(spark, sf, "documents"), "doc_id", "text", TERMS, _title())


def _bm25(spark, sf):
    return R.bm25(_counts(spark, sf), "doc_id", len(TERMS))


BM25_CTE = rf"""
tok AS (SELECT doc_id, source, lang, n_chars, text, lower(regexp_extract(text, '^([^\n]*)', 1)) AS title,
  list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1) AS toks FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM tok),
tf AS (SELECT doc_id, source, lang, n_chars, text, len(toks) AS dl, t, title, len(list_filter(toks, lambda x: x = t)) AS tf
  FROM tok, (SELECT unnest({_LIST}) AS t)),
df AS (SELECT t, count(*) AS df FROM tf WHERE tf > 0 GROUP BY t),
bm AS (SELECT doc_id, any_value(source) AS source, any_value(lang) AS lang, any_value(n_chars) AS n_chars, any_value(text) AS text,
  sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) + CASE WHEN contains(title, t) THEN 2.0 ELSE 0.0 END) AS score
  FROM tf JOIN df USING (t), st WHERE tf > 0 GROUP BY doc_id),
bmr AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm)
"""

COS_CTE = """
q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
cs AS (SELECT vec_id AS doc_id, list_dot_product(CAST(embedding AS DOUBLE[]), qv) AS score FROM embeddings, q),
csr AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM cs WHERE score > 0)
"""


def _query_vector(spark, sf) -> list[float]:
    return list(table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"])


def _cosine(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return R.cosine(vectors, "doc_id", "embedding", _query_vector(spark, sf))


@query("bm25_topk", f"WITH {BM25_CTE} SELECT doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 50")
def bm25_topk(spark, sf):
    return R.top(_bm25(spark, sf), "doc_id", 50).select("doc_id", F.round("score", 6).alias("score"), "rank")


@query("corpus_stats", rf"""SELECT count(*) AS n_docs, CAST(sum(len(k)) AS BIGINT) AS n_tokens, round(avg(len(k)), 6) AS mean_length
FROM (SELECT list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1) AS k FROM documents)""")
def corpus_stats(spark, sf):
    sizes = table(spark, sf, "documents").select(F.size(T.lexical_tokens("text")).alias("k"))
    return sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("k").alias("n_tokens"), F.round(F.avg("k"), 6).alias("mean_length"))


def _tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.lexical_tokens("text")).alias("term"))


_TOK_SQL = r"SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) > 1)) AS term FROM documents"


@query("doc_freq", f"SELECT term, count(DISTINCT doc_id) AS df FROM ({_TOK_SQL}) GROUP BY term")
def doc_freq(spark, sf):
    once = table(spark, sf, "documents").select(F.explode(F.array_distinct(T.lexical_tokens("text"))).alias("term"))
    return once.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("term_freq_topk", f"SELECT term, count(*) AS n FROM ({_TOK_SQL}) GROUP BY term ORDER BY n DESC, term LIMIT 100")
def term_freq_topk(spark, sf):
    return _tokens(spark, sf).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(100)


@query("lexical_tokens", r"SELECT doc_id, CAST(len(k) AS BIGINT) AS n_tokens, array_to_string(k, ' ') AS tokens FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) > 1) AS k FROM documents)")
def lexical_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.lexical_tokens("text").alias("k")).select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.array_join("k", " ").alias("tokens"))


_STOP = "['" + "', '".join(T.STOP_WORDS) + "']"


@query("unique_tokens_nostop", rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x)) AS k FROM documents)
SELECT doc_id, CAST(len(list_distinct(k)) AS BIGINT) AS n_tokens, array_to_string(list_sort(list_distinct(k)), ' ') AS tokens FROM t""")
def unique_tokens(spark, sf):
    k = table(spark, sf, "documents").select("doc_id", T.unique_tokens("text").alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.array_join(F.array_sort("k"), " ").alias("tokens"))


@query("fnv_hash", "SELECT p_partkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, x: (xor(a, x) * 16777619) & 4294967295) AS h FROM part")
def fnv_hash(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.fnv1a("p_name").alias("h"))


_FEATURE_SQL = r"""
WITH t AS (SELECT item_id, lower(text) AS x, regexp_replace(lower(text), '\s+', ' ', 'g') AS y FROM benchmark),
f AS (
  SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(x, '[\p{L}\p{N}]+'), lambda w: length(w) > 1 AND NOT list_contains(""" + _STOP + r""", w)))) AS f FROM t
  UNION ALL SELECT item_id, substring(y, i, 3) FROM (SELECT item_id, y, unnest(range(1, length(y) - 1)) AS i FROM t)
), h AS (SELECT item_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(f, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, x: (xor(a, x) * 16777619) & 4294967295) AS h FROM f),
b AS (SELECT item_id, h % 256 AS bucket, CAST(sum(CASE WHEN h & 256 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS w FROM h GROUP BY 1, 2),
n AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM b GROUP BY 1)
SELECT item_id, bucket, round(w / norm, 6) AS weight FROM b JOIN n USING (item_id) WHERE w <> 0"""


@query("feature_hash_vectors", _FEATURE_SQL)
def feature_hash_vectors(spark, sf):
    flat = F.regexp_replace(F.lower("text"), r"\s+", " ")
    grams = F.when(F.length(flat) >= 3, F.transform(F.sequence(F.lit(1), F.length(flat) - 2), lambda i: F.substring(flat, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf, "benchmark").select("item_id", F.explode(F.concat(T.unique_tokens("text"), grams)).alias("f")).select("item_id", V.fnv1a("f").alias("h"))
    sign = F.when(F.col("h").bitwiseAND(F.lit(256)) == 0, 1.0).otherwise(-1.0)
    b = rows.groupBy("item_id", (F.col("h") % 256).alias("bucket")).agg(F.sum(sign).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("item_id")))
    return b.withColumn("norm", norm).where("w <> 0").select("item_id", "bucket", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


@query("cosine_topk", f"WITH {COS_CTE} SELECT doc_id, round(score, 6) AS score, rank FROM csr WHERE rank <= 20")
def cosine_topk(spark, sf):
    return R.top(_cosine(spark, sf), "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"), "rank")


@query("l2_normalise", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS first FROM embeddings")
def l2_normalise(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.l2_norm("embedding"), 5).alias("norm"), F.round(V.l2_normalise("embedding")[0], 5).alias("first"))


@query("vector_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_missing(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("vector_join", "SELECT doc_id, label FROM documents JOIN embeddings ON vec_id = doc_id")
def vector_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")


_RRF = f"""WITH {BM25_CTE}, {COS_CTE},
u AS (SELECT doc_id, 1.0 / (60 + rank) AS part, 'bm25' AS channel, score FROM bmr
  UNION ALL SELECT doc_id, 1.0 / (60 + rank), 'embedding', score FROM csr)"""


@query("rrf_fusion", _RRF + " SELECT doc_id, round(sum(CAST(part AS DOUBLE)), 9) AS rrf FROM u GROUP BY doc_id")
def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("doc_id", F.round("rrf", 9).alias("rrf"))


def _fused(spark, sf):
    return R.fuse({"bm25": R.ranked(_bm25(spark, sf), "doc_id"), "embedding": R.ranked(_cosine(spark, sf), "doc_id")}, "doc_id")


@query("rrf_channel_scores", _RRF + " SELECT doc_id, round(max(CASE WHEN channel = 'bm25' THEN score END), 6) AS bm25_score, round(max(CASE WHEN channel = 'embedding' THEN score END), 6) AS embedding_score FROM u GROUP BY doc_id")
def rrf_channel_scores(spark, sf):
    return _fused(spark, sf).select("doc_id", F.round("bm25_score", 6).alias("bm25_score"), F.round("embedding_score", 6).alias("embedding_score"))


@query("hits_path_quota", f"WITH {BM25_CTE}, h AS (SELECT doc_id, source, rank, row_number() OVER (PARTITION BY source ORDER BY rank) AS place FROM bmr) SELECT * FROM h WHERE place <= 2")
def hits_path_quota(spark, sf):
    hits = R.ranked(_bm25(spark, sf), "doc_id").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return R.quota(hits.select("doc_id", "source", "rank"), "source")


@query("hits_char_budget", f"WITH {BM25_CTE}, h AS (SELECT doc_id, rank, CAST(sum(n_chars) OVER (ORDER BY rank) AS BIGINT) AS used FROM bmr) SELECT * FROM h WHERE used <= 60000")
def hits_char_budget(spark, sf):
    """Running sums by ranges, so that the whole ranking is summed without one task."""
    hits = R.ranked(_bm25(spark, sf), "doc_id").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return running(stored(hits.select("doc_id", "rank", "n_chars"), "hits"), ["rank"], "k", {"used": F.col("n_chars")}).where("used <= 60000").select("doc_id", "rank", "used")


@query("snippet", f"""WITH {BM25_CTE},
p AS (SELECT doc_id, text, list_min(list_filter(list_transform({_LIST}, lambda t: strpos(lower(text), t)), lambda x: x > 0)) AS hit FROM bmr),
s AS (SELECT doc_id, text, greatest(coalesce(hit, 1) - 300, 1) AS a FROM p)
SELECT doc_id, CASE WHEN a > 1 THEN '…' ELSE '' END || substring(text, a, 900) || CASE WHEN a + 899 < length(text) THEN '…' ELSE '' END AS snippet FROM s""")
def snippet(spark, sf):
    return table(spark, sf, "documents").join(_bm25(spark, sf).select("doc_id"), "doc_id").select("doc_id", T.snippet("text", TERMS).alias("snippet"))


@query("fair_interleave", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents) SELECT * FROM r ORDER BY place, lang LIMIT 300")
def fair_interleave(spark, sf):
    return R.interleave(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 300).select("doc_id", "lang", "place")


@query("candidate_union", f"""WITH {BM25_CTE}, {COS_CTE},
u AS (SELECT doc_id, 1 AS prio, rank FROM bmr WHERE rank <= 500 UNION ALL SELECT doc_id, 2, rank FROM csr WHERE rank <= 250),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prio, rank) AS k FROM u)
SELECT doc_id, CAST(prio AS BIGINT) AS prio, rank FROM d WHERE k = 1 ORDER BY prio, rank LIMIT 600""")
def candidate_union(spark, sf):
    a = R.top(_bm25(spark, sf), "doc_id", 500).select("doc_id", F.lit(1).cast("long").alias("prio"), "rank")
    b = R.top(_cosine(spark, sf), "doc_id", 250).select("doc_id", F.lit(2).cast("long").alias("prio"), "rank")
    first = a.unionByName(b).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("prio", "rank"))).where("k = 1")
    return first.orderBy("prio", "rank").limit(600).select("doc_id", "prio", "rank")


@query("long_term_gate", "SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed') OR contains(lower(text), 'password')")
def long_term_gate(spark, sf):
    long = F.array(*(F.lit(t) for t in TERMS if len(t) >= 8))
    return table(spark, sf, "documents").where(F.exists(long, lambda t: F.lower("text").contains(t))).select("doc_id")


@query("provisional_exclusion", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def provisional_exclusion(spark, sf):
    hidden = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf, "documents").select("doc_id").join(hidden, "doc_id", "left_anti")


@query("benchmark_queries", rf"""WITH q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x)))) AS t FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1))) AS t FROM documents),
m AS (SELECT item_id, doc_id, count(*) AS shared FROM q JOIN d USING (t) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM m)
SELECT item_id, doc_id, shared, rank FROM r WHERE rank <= 5""")
def benchmark_queries(spark, sf):
    """Many queries at once: a text meets all of them in its task, and only the best of a task are sent on."""
    q = table(spark, sf, "benchmark").select("item_id", F.explode(T.unique_tokens("text")).alias("t"))
    d = table(spark, sf, "documents").select("doc_id", F.array_distinct(T.lexical_tokens("text")).alias("tokens"))
    return R.most_shared(d, "doc_id", "tokens", q, "item_id", "t", 5)


# -- the link graph of web pages ------------------------------------------------------------

_TITLE = r"(?s)<title>(.*?)</title>"
PAGES_CTE = r"""
pg AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, html FROM pages),
keyed AS (SELECT page_id, title, lower(regexp_extract(title, '^([\p{L}\p{N}]+)', 1)) AS key FROM pg),
keys AS (SELECT key, max(page_id) AS target FROM keyed WHERE key <> '' GROUP BY key),
raw AS (SELECT DISTINCT page_id AS source, lower(unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1))) AS key FROM pg),
edges AS (SELECT source, target FROM raw JOIN keys USING (key) WHERE source <> target)
"""


def _pages(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", _TITLE, 1).alias("title"), "html")
    return p.withColumn("key", F.lower(F.regexp_extract("title", r"^([\p{L}\p{N}]+)", 1)))


def _raw_links(p):
    return p.select(F.col("page_id").alias("source"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)), lambda x: F.lower(x)))).alias("key"))


def _graph(spark, sf):
    p = _pages(spark, sf)
    keys = p.where("key <> ''").groupBy("key").agg(F.max("page_id").alias("target"))
    return _raw_links(p).join(keys, "key").where("source <> target").select("source", "target")


@query("html_title", f"WITH {PAGES_CTE} SELECT page_id, title FROM pg")
def html_title(spark, sf):
    return _pages(spark, sf).select("page_id", "title")


@query("html_link_graph", f"WITH {PAGES_CTE} SELECT source, target FROM edges")
def html_link_graph(spark, sf):
    return _graph(spark, sf)


_SEED = "seeds AS (SELECT page_id AS id, row_number() OVER (ORDER BY page_id) - 1 AS rank FROM (SELECT page_id FROM keyed WHERE contains(lower(title), 'the') ORDER BY page_id LIMIT 20))"


@query("graph_neighbour_boost", f"""WITH {PAGES_CTE}, {_SEED},
arcs AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
met AS (SELECT a, b, rank, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM arcs JOIN seeds ON id = a)
SELECT b AS target, round(sum(1.0 / (rank + 1)), 6) AS boost FROM met WHERE n <= 20 GROUP BY b""")
def graph_neighbour_boost(spark, sf):
    seeds = _pages(spark, sf).where(F.lower("title").contains("the")).orderBy("page_id").limit(20).select(F.col("page_id").alias("id"))
    seeds = seeds.withColumn("rank", F.row_number().over(Window.orderBy("id")) - 1)
    return R.neighbours(_graph(spark, sf), seeds).select("target", F.round("boost", 6).alias("boost"))


@query("wiki_title_score", f"""WITH {PAGES_CTE}, s AS (SELECT page_id, sum(CASE WHEN lower(title) = t THEN 12 WHEN contains(lower(title), t) THEN 5 ELSE 0 END + CASE WHEN contains(lower(url), t) THEN 2 ELSE 0 END) AS score
FROM pg JOIN pages USING (page_id), (SELECT unnest({_LIST}) AS t) GROUP BY page_id) SELECT page_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0""")
def wiki_title_score(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.lower("url").alias("url"), F.lower(F.regexp_extract("html", _TITLE, 1)).alias("title"))
    score = sum((F.when(F.col("title") == t, 12).when(F.col("title").contains(t), 5).otherwise(0) + F.when(F.col("url").contains(t), 2).otherwise(0) for t in TERMS), F.lit(0))
    return p.select("page_id", score.cast("long").alias("score")).where("score > 0")


# -- lint -----------------------------------------------------------------------------------

# Markdown pages made of the web pages, some without a heading, a field or any text.
_MARKDOWN_SQL = r"""
pg AS (SELECT page_id, length(html) AS n, contains(html, 'lang="en"') AS en, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS nav FROM pages),
made AS (SELECT 'wiki/topics/' || page_id || '/' || lower(regexp_extract(title, '^([\p{L}\p{N}]+)', 1)) || '.md' AS path,
  CASE WHEN n < 1200 THEN ' ' ELSE '---' || chr(10) || 'type: topic' || chr(10) || 'title: ' || title || chr(10) || 'created: 1' || chr(10) || 'updated: 1' || chr(10) || 'tags: []' || chr(10) || 'related: []' || chr(10) || 'sources: []' || chr(10)
    || CASE WHEN en THEN 'covers: []' || chr(10) || 'summary: s' || chr(10) ELSE '' END || '---' || chr(10)
    || CASE WHEN n > 3000 THEN '# ' || title || chr(10) ELSE 'text' || chr(10) END
    || CASE WHEN n > 2000 THEN '## Related' || chr(10) || array_to_string(list_transform(nav, lambda x: '- [[' || x || ']]'), chr(10)) || chr(10) ELSE '' END END AS content,
  n, en, title, nav, lower(regexp_extract(title, '^([\p{L}\p{N}]+)', 1)) AS base FROM pg)"""


def _markdown(spark, sf):
    html = F.col("html")
    title = F.regexp_extract(html, _TITLE, 1)
    nav = F.transform(F.regexp_extract_all(html, F.lit('<a href="/([^"]*)"'), F.lit(1)), lambda x: F.concat(F.lit("- [["), x, F.lit("]]")))
    n = F.length(html)
    front = F.concat(F.lit("---\ntype: topic\ntitle: "), title, F.lit("\ncreated: 1\nupdated: 1\ntags: []\nrelated: []\nsources: []\n"), F.when(html.contains('lang="en"'), F.lit("covers: []\nsummary: s\n")).otherwise(""), F.lit("---\n"))
    head = F.when(n > 3000, F.concat(F.lit("# "), title, F.lit("\n"))).otherwise("text\n")
    links = F.when(n > 2000, F.concat(F.lit("## Related\n"), F.array_join(nav, "\n"), F.lit("\n"))).otherwise("")
    path = F.concat(F.lit("wiki/topics/"), F.col("page_id").cast("string"), F.lit("/"), F.lower(F.regexp_extract(title, r"^([\p{L}\p{N}]+)", 1)), F.lit(".md"))
    return table(spark, sf, "pages").select(path.alias("path"), F.when(n < 1200, F.lit(" ")).otherwise(F.concat(front, head, links)).alias("content"))


_LINT = _MARKDOWN_SQL + """,
names AS (SELECT DISTINCT path, unnest([base, CASE WHEN n < 1200 OR trim(title) = '' THEN base ELSE lower(trim(title)) END]) AS name FROM made),
alias AS (SELECT name, max(path) AS path FROM names GROUP BY name HAVING count(*) = 1),
slugs AS (SELECT regexp_replace(regexp_replace(path, '^wiki/', ''), '[.]md$', '') AS slug, path FROM made),
links AS (SELECT DISTINCT path, lower(trim(regexp_replace(unnest(CASE WHEN n > 2000 THEN nav ELSE [] END), '(?i)[.]md$', ''))) AS link FROM made WHERE n >= 1200),
res AS (SELECT links.path, link, coalesce(slugs.path, alias.path) AS target FROM links LEFT JOIN slugs ON slug = link LEFT JOIN alias ON name = list_last(string_split(link, '/'))),
issues AS (
  SELECT path AS page, 'EMPTY_PAGE' AS code, 'error' AS severity, '' AS detail FROM made WHERE n < 1200
  UNION ALL SELECT path, 'MISSING_TITLE', 'warning', '' FROM made WHERE n <= 3000
  UNION ALL SELECT path, 'INCOMPLETE_FRONTMATTER', 'warning', CASE WHEN n < 1200 THEN 'type, title, created, updated, tags, related, sources, covers, summary' ELSE 'covers, summary' END FROM made WHERE n < 1200 OR NOT en
  UNION ALL SELECT path, 'BROKEN_LINK', 'warning', link FROM res WHERE target IS NULL
  UNION ALL SELECT path, 'NO_OUTLINKS', 'info', '' FROM made WHERE path NOT IN (SELECT path FROM links)
  UNION ALL SELECT path, 'ORPHAN_PAGE', 'info', '' FROM made WHERE path NOT IN (SELECT target FROM res WHERE target IS NOT NULL)
)"""


@query("link_resolution_lint", f"WITH {_LINT} SELECT page, code, severity, detail FROM issues")
def link_resolution_lint(spark, sf):
    return lint.findings(_markdown(spark, sf))


@query("lint_summary", f"WITH {_LINT} SELECT severity, code, count(*) AS n FROM issues GROUP BY 1, 2")
def lint_summary(spark, sf):
    return lint.findings(_markdown(spark, sf)).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query("inbound_links", f"WITH {PAGES_CTE} SELECT target AS page_id, count(*) AS n FROM edges GROUP BY target")
def inbound_links(spark, sf):
    return _graph(spark, sf).groupBy(F.col("target").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))


# -- the flagship: three channels over documents and web pages --------------------------------

_CORPUS_SQL = f"""
corpus AS (SELECT 'd' || doc_id AS id, source AS path, regexp_extract(text, '^([^\\n]*)', 1) AS title, text, false AS wiki, doc_id AS vec FROM documents
  UNION ALL SELECT 'p' || page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1), regexp_replace(html, '<[^>]*>', ' ', 'g'), true, NULL FROM pages),
tok AS (SELECT id, lower(title) AS title, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1) AS toks FROM corpus),
st AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM tok),
tf AS (SELECT id, len(toks) AS dl, t, title, len(list_filter(toks, lambda x: x = t)) AS tf FROM tok, (SELECT unnest({_LIST}) AS t)),
df AS (SELECT t, count(*) AS df FROM tf WHERE tf > 0 GROUP BY t),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) + CASE WHEN contains(title, t) THEN 2.0 ELSE 0.0 END) AS score FROM tf JOIN df USING (t), st WHERE tf > 0 GROUP BY id),
bmr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm),
{PAGES_CTE.strip()},
seeds AS (SELECT id, row_number() OVER (ORDER BY rank) - 1 AS rank FROM (SELECT id, rank FROM bmr WHERE starts_with(id, 'p') ORDER BY rank LIMIT 20)),
arcs AS (SELECT 'p' || source AS a, 'p' || target AS b FROM edges UNION SELECT 'p' || target, 'p' || source FROM edges),
near AS (SELECT b, rank, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM arcs JOIN seeds ON seeds.id = a),
boost AS (SELECT b AS id, sum(1.0 / (rank + 1)) AS boost FROM near WHERE n <= 20 GROUP BY b),
own AS (SELECT id, sum(CASE WHEN lower(title) = t THEN 12.0 WHEN contains(lower(title), t) THEN 5.0 ELSE 0.0 END + CASE WHEN contains(lower(path), t) THEN 2.0 ELSE 0.0 END) AS own FROM corpus, (SELECT unnest({_LIST}) AS t) WHERE wiki GROUP BY id),
ws AS (SELECT id, CAST(own AS DOUBLE) + coalesce(boost, 0.0) AS score FROM own LEFT JOIN boost USING (id)),
wsr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ws WHERE score > 0),
{COS_CTE.strip()},
emr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM corpus JOIN cs ON cs.doc_id = vec WHERE score > 0),
u AS (SELECT id, 'bm25' AS c, rank FROM bmr UNION ALL SELECT id, 'wiki', rank FROM wsr UNION ALL SELECT id, 'embedding', rank FROM emr),
f AS (SELECT id, coalesce(CAST(max(CASE WHEN c = 'bm25' THEN 1.0 / (60 + rank) END) AS DOUBLE), 0) + coalesce(CAST(max(CASE WHEN c = 'wiki' THEN 1.0 / (60 + rank) END) AS DOUBLE), 0) + coalesce(CAST(max(CASE WHEN c = 'embedding' THEN 1.0 / (60 + rank) END) AS DOUBLE), 0) AS rrf FROM u GROUP BY id),
q2 AS (SELECT f.id, round(rrf, 12) AS rrf, path, text, row_number() OVER (PARTITION BY path ORDER BY round(rrf, 12) DESC, f.id) AS place FROM f JOIN corpus USING (id)),
h AS (SELECT id, rrf, text, row_number() OVER (ORDER BY rrf DESC, id) AS rank FROM q2 WHERE place <= 2),
p AS (SELECT id, rrf, rank, text, greatest(coalesce(list_min(list_filter(list_transform({_LIST}, lambda t: strpos(lower(text), t)), lambda x: x > 0)), 1) - 300, 1) AS a FROM h WHERE rank <= 100),
s AS (SELECT id, rrf, rank, CASE WHEN a > 1 THEN '…' ELSE '' END || substring(text, a, 900) || CASE WHEN a + 899 < length(text) THEN '…' ELSE '' END AS snippet FROM p),
b AS (SELECT *, sum(length(snippet)) OVER (ORDER BY rank) AS used FROM s)"""


def _corpus(spark, sf):
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    a = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("path"), _title().alias("title"), "text", F.lit(False).alias("wiki"))
    text = F.regexp_replace("html", "<[^>]*>", " ")
    b = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("path"), F.regexp_extract("html", _TITLE, 1).alias("title"), text.alias("text"), F.lit(True).alias("wiki"))
    return a.unionByName(b)


def flagship(spark, sf, config: EngineConfig = EngineConfig(max_hits=100)):
    """Hits of three channels over documents and pages: whole rankings fused, then quota, limit and a budget of snippets."""
    corpus = _corpus(spark, sf)
    words = R.bm25(R.term_counts(corpus, "id", "text", TERMS, F.col("title")), "id", len(TERMS))
    lexical = stored(R.ranked(words, "id"), "lexical")
    page = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias(c)
    seeds = lexical.where(F.col("id").startswith("p")).orderBy("rank").limit(config.max_neighbours).withColumn("rank", F.row_number().over(Window.orderBy("rank")) - 1)
    boosts = R.neighbours(_graph(spark, sf).select(page("source"), page("target")), seeds, config.max_neighbours)
    wiki = R.wiki_scores(corpus.where("wiki"), "id", "title", "path", TERMS, boosts)
    vectors = table(spark, sf, "embeddings").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id")
    near = R.cosine(vectors.withColumn("id", F.concat(F.lit("d"), F.col("vec_id").cast("string"))), "id", "embedding", _query_vector(spark, sf))
    fused = R.fuse({"bm25": lexical, "wiki": R.ranked(wiki, "id"), "embedding": R.ranked(near, "id")}, "id", config.rrf_k)
    fused = fused.withColumn("rrf", F.round("rrf", 12))
    return R.context(fused, corpus, "id", "path", "text", TERMS, config.max_hits, config.hits_per_path, config.max_chars)


@query("retrieve_context", "WITH " + _CORPUS_SQL + " SELECT id, rank, round(rrf, 9) AS rrf, snippet FROM b WHERE used <= 60000")
def retrieve_context(spark, sf):
    return flagship(spark, sf).select("id", "rank", F.round("rrf", 9).alias("rrf"), "snippet")
