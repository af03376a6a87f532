"""Registered queries on planning, records and page search, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import planning as P
from ..operators import records as R
from ..session import table
from .retrieval import PAGES_CTE, _corpus, _graph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# -- requirements: candidates are the first three words of documents and the titles of pages ----

_SLUG = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160))), '[\\/]+', '-', 'g'), '[^\p{{L}}\p{{N}}._-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')"
_SLUGGED = "CASE WHEN " + _SLUG + " = '' THEN 'untitled' ELSE " + _SLUG + " END"
_slug = _SLUGGED.format
_REQUIRED = rf"""
cand AS (SELECT doc_id AS seq, regexp_extract(text, '^[^ \n]+ [^ \n]+') AS title, CASE lang WHEN 'en' THEN 'entity' WHEN 'de' THEN 'Plot Thread' WHEN 'fr' THEN 'nothing' ELSE 'concept' END AS kind, source AS collection, lang AS batch, n_chars > 3000 AS override FROM documents),
kinds AS (SELECT *, {_slug('title')} AS slug, CASE kind WHEN 'entity' THEN 'entity' WHEN 'Plot Thread' THEN 'plot-thread' WHEN 'concept' THEN 'concept' ELSE 'topic' END AS k FROM cand WHERE trim(coalesce(title, '')) <> ''),
req AS (SELECT 'page-' || substring(sha256(slug), 1, 20) AS requirement_id, slug, arg_min(title, seq) AS title, coalesce(arg_max(k, seq) FILTER (override), arg_min(k, seq)) AS page_kind,
  list_sort(list(DISTINCT collection)) AS cs, list_sort(list(DISTINCT batch)) AS bs, count(*) AS n_candidates FROM kinds GROUP BY slug),
required AS (SELECT *, 'wiki/' || CASE page_kind WHEN 'entity' THEN 'entities' WHEN 'plot-thread' THEN 'plot-threads' WHEN 'concept' THEN 'concepts' ELSE 'topics' END || '/' || slug || '.md' AS preferred_path FROM req)"""


def _required(spark, sf):
    docs = table(spark, sf, "documents")
    kind = F.when(F.col("lang") == "en", "entity").when(F.col("lang") == "de", "Plot Thread").when(F.col("lang") == "fr", "nothing").otherwise("concept")
    title = F.regexp_extract("text", r"^[^ \n]+ [^ \n]+", 0)
    return P.requirements(docs.select(F.col("doc_id").alias("seq"), title.alias("title"), kind.alias("kind"), F.col("source").alias("collection"), F.col("lang").alias("batch"), (F.col("n_chars") > 3000).alias("override")))


@query("page_requirements", f"WITH {_REQUIRED} SELECT requirement_id, title, page_kind, preferred_path, array_to_string(cs, ',') AS collections, array_to_string(bs, ',') AS batches, n_candidates FROM required")
def page_requirements(spark, sf):
    r = _required(spark, sf)
    return r.select("requirement_id", "title", "page_kind", "preferred_path", F.array_join("collections", ",").alias("collections"), F.array_join("batches", ",").alias("batches"), "n_candidates")


@query("requirement_shards", f"WITH {_REQUIRED}, n AS (SELECT requirement_id, preferred_path, row_number() OVER (ORDER BY preferred_path, requirement_id) AS place FROM required) SELECT *, (place - 1) // 6 + 1 AS shard FROM n")
def requirement_shards(spark, sf):
    return P.shards(_required(spark, sf), 6)


_EXISTING = rf"""
pg0 AS (SELECT page_id, lower(regexp_extract(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^([^ ]+ [^ ]+)', 1)) AS title, list_transform(regexp_extract_all(html, '<a href="/([^"]*)"', 1), lambda x: 'page-' || substring(sha256(lower(x)), 1, 20)) AS covers FROM pages),
pages1 AS (SELECT 'wiki/entities/' || CASE WHEN page_id < 100 THEN {_slug('title')} ELSE CAST(page_id AS VARCHAR) END || '.md' AS path, title, covers FROM pg0)"""


def _existing(spark, sf):
    p = table(spark, sf, "pages")
    title = F.lower(F.regexp_extract(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), r"^([^ ]+ [^ ]+)", 1))
    covers = F.transform(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)), lambda x: F.concat(F.lit("page-"), F.substring(F.sha2(F.lower(x), 256), 1, 20)))
    name = F.when(F.col("page_id") < 100, T.page_slug(title)).otherwise(F.col("page_id").cast("string"))
    return p.select(F.concat(F.lit("wiki/entities/"), name, F.lit(".md")).alias("path"), title.alias("title"), covers.alias("covers"))


@query("requirement_pages", f"""WITH {_REQUIRED}, {_EXISTING},
m AS (SELECT requirement_id, 0 AS k, path FROM required JOIN pages1 ON path = preferred_path
  UNION ALL SELECT requirement_id, 1, path FROM required JOIN (SELECT path, unnest(covers) AS c FROM pages1) ON c = requirement_id
  UNION ALL SELECT requirement_id, 2, path FROM required JOIN pages1 ON slug = {_slug('pages1.title')}),
b AS (SELECT requirement_id, min((k, path)) AS best FROM m GROUP BY 1)
SELECT requirement_id, coalesce(best[2], preferred_path) AS path, CASE best[1] WHEN 0 THEN 'path' WHEN 1 THEN 'covers' WHEN 2 THEN 'title' ELSE 'none' END AS met FROM required LEFT JOIN b USING (requirement_id)""")
def requirement_pages(spark, sf):
    return P.existing_pages(_required(spark, sf), _existing(spark, sf))


@query("requirement_coverage", f"""WITH {_REQUIRED}, {_EXISTING},
c AS (SELECT c AS requirement_id, count(DISTINCT path) AS n FROM (SELECT path, unnest(covers) AS c FROM pages1) GROUP BY 1),
j AS (SELECT requirement_id, coalesce(n, 0) AS n FROM required LEFT JOIN c USING (requirement_id))
SELECT requirement_id, CASE n WHEN 0 THEN 'missing' ELSE 'duplicate' END AS problem, n FROM j WHERE n <> 1""")
def requirement_coverage(spark, sf):
    return P.coverage(_required(spark, sf), _existing(spark, sf))


@query("provisional_owners", "SELECT source AS path, coalesce(min(lang) FILTER (lang = 'fr'), min(lang)) AS task FROM documents GROUP BY source")
def provisional_owners(spark, sf):
    return P.owners(table(spark, sf, "documents").select(F.col("source").alias("path"), F.col("lang").alias("task")), "fr")


# -- records ----------------------------------------------------------------------------------


@query("log_append", """WITH log AS (SELECT event_type AS task, min(event_id) AS entry FROM events WHERE event_id < 100 GROUP BY 1), new AS (SELECT DISTINCT event_type AS task FROM events)
SELECT task, entry FROM log UNION ALL SELECT task, CAST(-1 AS BIGINT) FROM new WHERE task NOT IN (SELECT task FROM log)
UNION ALL SELECT 'user-' || user_id, CAST(-1 AS BIGINT) FROM (SELECT DISTINCT user_id FROM events)""")
def log_append(spark, sf):
    e = table(spark, sf, "events")
    log = e.where("event_id < 100").groupBy(F.col("event_type").alias("task")).agg(F.min("event_id").alias("entry"))
    new = e.select(F.col("event_type").alias("task")).unionByName(e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("task")))
    return R.append_once(log, new.withColumn("entry", F.lit(-1).cast("long")), "task")


@query("graph_artefact", f"""WITH {PAGES_CTE}, e AS (SELECT source, target FROM edges), d AS (SELECT a, count(*) AS degree FROM (SELECT source AS a FROM e UNION ALL SELECT target FROM e) GROUP BY a)
SELECT 'node' AS kind, page_id AS a, CAST(NULL AS BIGINT) AS b, coalesce(degree, 0) AS degree FROM pages LEFT JOIN d ON a = page_id UNION ALL SELECT DISTINCT 'edge', source, target, CAST(NULL AS BIGINT) FROM e""")
def graph_artefact(spark, sf):
    return R.graph(table(spark, sf, "pages").select("page_id"), _graph(spark, sf))


@query("index_artefact", r"""WITH c AS (SELECT 'd' || doc_id AS id, source AS path, regexp_extract(text, '^([^\n]*)', 1) AS title, text FROM documents
  UNION ALL SELECT 'p' || page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1), regexp_replace(html, '<[^>]*>', ' ', 'g') FROM pages)
SELECT id, path, title, sha256(coalesce(title, '') || chr(10) || coalesce(text, '')) AS hash, CAST(length(coalesce(text, '')) AS INTEGER) AS length FROM c""")
def index_artefact(spark, sf):
    return R.index_rows(_corpus(spark, sf))


@query("corpus_union", """SELECT 'source' AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents
UNION ALL SELECT 'wiki', count(*), CAST(sum(length(regexp_replace(html, '<[^>]*>', ' ', 'g'))) AS BIGINT) FROM pages""")
def corpus_union(spark, sf):
    kind = F.when(F.col("wiki"), "wiki").otherwise("source")
    return _corpus(spark, sf).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("evidence_references", """WITH cat AS (SELECT conv_id AS batch, turn AS idx, text AS value FROM conversations), n AS (SELECT batch, max(idx) + 1 AS n FROM cat GROUP BY 1),
refs AS (SELECT doc_id AS ref, doc_id AS batch, CASE WHEN lang = 'fr' THEN -1 WHEN lang = 'es' THEN NULL WHEN n_chars > 2000 THEN 99 ELSE 1 END AS idx FROM documents)
SELECT ref, batch, CAST(idx AS BIGINT) AS idx, value, CASE WHEN idx IS NULL OR idx < 0 THEN 'must be a non-negative integer index' WHEN value IS NULL THEN 'index ' || idx || ' is out of range for length ' || coalesce(n, 0) END AS error
FROM refs LEFT JOIN cat USING (batch, idx) LEFT JOIN n USING (batch)""")
def evidence_references(spark, sf):
    catalog = table(spark, sf, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("idx"), F.col("text").alias("value"))
    idx = F.when(F.col("lang") == "fr", -1).when(F.col("lang") == "es", None).when(F.col("n_chars") > 2000, 99).otherwise(1).cast("long")
    return R.resolve_references(table(spark, sf, "documents").select(F.col("doc_id").alias("ref"), F.col("doc_id").alias("batch"), idx.alias("idx")), catalog)


_CLASSED = r"""cl AS (SELECT page_id, CASE WHEN length(html) > 4000 THEN 'confirmed' ELSE ' ' END AS status, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS nav FROM pages),
z AS (SELECT page_id, len(nav) AS n, status, unnest(range(1, least(len(nav), 100) + 1)) AS i, nav FROM cl),
c AS (SELECT page_id, n, i, nullif(trim(status), '') AS status, nullif(trim(nav[i]), '') AS key, 'N ' || nullif(trim(nav[i]), '') AS name, nullif(trim(nav[i + 1]), '') AS abe FROM z)"""


def _classified(spark, sf):
    nav = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))
    p = table(spark, sf, "pages").select("page_id", F.when(F.length("html") > 4000, "confirmed").otherwise(" ").alias("status"), nav.alias("domain"))
    none = F.array().cast("array<string>")
    p = p.select("page_id", "status", "domain", F.transform("domain", lambda x: F.concat(F.lit("N "), x)).alias("names"), F.slice("domain", 2, 1000).alias("abe"), none.alias("none"))
    return R.classifications(p, ["none", "none", "domain", "names", "abe", "none", "none", "none"], "status")


@query("page_classifications", f"WITH {_CLASSED} SELECT page_id, CAST(n AS BIGINT) AS n_classifications, status, CASE WHEN coalesce(key, abe) IS NOT NULL THEN concat_ws('/', key, abe) END AS path, key AS domain_key, name AS domain_name, abe AS abe_key FROM c")
def page_classifications(spark, sf):
    return _classified(spark, sf).select("page_id", "n_classifications", F.inline("classifications")).select("page_id", "n_classifications", "status", "path", "domain_key", "domain_name", "abe_key")


@query("domain_page_search", f"""WITH {_CLASSED} SELECT DISTINCT page_id FROM c WHERE status = 'confirmed' AND (lower(key) IN ('the', 'de') OR false) AND lower(coalesce(key, '')) = 'the'
UNION ALL SELECT DISTINCT -page_id - 1 FROM c WHERE lower(concat_ws('/', key, abe)) = 'la' OR starts_with(lower(concat_ws('/', key, abe)), 'la/')""")
def domain_page_search(spark, sf):
    p = _classified(spark, sf)
    by_name = R.search(p, {"status": " Confirmed ", "domain": "THE"}).select("page_id")
    by_path = R.search(p, {"classification_path_prefix": "La/"}).select((-F.col("page_id") - 1).alias("page_id"))
    return by_name.unionByName(by_path)


@query("clamped_limits", "SELECT p_partkey, CASE WHEN p_size > 40 THEN CAST(20 AS BIGINT) ELSE CAST(least(greatest(p_size * 5 - 20, 1), 100) AS BIGINT) END AS n FROM part")
def clamped_limits(spark, sf):
    given = F.when(F.col("p_size") > 40, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).otherwise((F.col("p_size") * 5 - 20).cast("string"))
    return table(spark, sf, "part").select("p_partkey", R.clamp(given, 1, 100, 20).alias("n"))


@query("unresolved_questions", """SELECT conv_id, turn, CASE WHEN role = 'user' AND trim(text) <> '' THEN trim(text) WHEN role = 'user' THEN 'none' ELSE text END AS question FROM conversations""")
def unresolved_questions(spark, sf):
    held = F.to_json(F.struct(F.lit(" ").alias("question"), F.col("text").alias("content"), F.lit("none").alias("message")))
    return table(spark, sf, "conversations").select("conv_id", "turn", R.first_text(F.when(F.col("role") == "user", held).otherwise(F.col("text"))).alias("question"))


@query("embedding_status", """SELECT lang, count(*) AS n, count(vec_id) AS indexed, count(*) - count(vec_id) AS missing, CASE WHEN count(vec_id) = 0 THEN 'empty' WHEN count(vec_id) < count(*) THEN 'partial' ELSE 'complete' END AS status
FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY lang""")
def embedding_status(spark, sf):
    met = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("own")), "doc_id", "left")
    n, own = F.count(F.lit(1)), F.count("own")
    return met.groupBy("lang").agg(n.alias("n"), own.alias("indexed"), (n - own).alias("missing"), F.when(own == 0, "empty").when(own < n, "partial").otherwise("complete").alias("status"))


@query("range_overlaps", """WITH r AS (SELECT l_orderkey AS g, l_linenumber AS k, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + 9 AS e FROM lineitem)
SELECT a.g AS l_orderkey, a.k AS a, b.k AS b FROM r a JOIN r b ON a.g = b.g AND (a.s < b.s OR (a.s = b.s AND a.k < b.k)) AND b.s < a.e""")
def range_overlaps(spark, sf):
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity").cast("long") + 9).alias("end"))
    return R.overlaps(r, "l_orderkey", "l_linenumber", 16)


@query("link_spellings", r"""WITH n AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS x FROM pages), v AS (SELECT page_id, x, ' Wiki/Topics/' || x || '.MD|Alias ' AS y FROM n)
SELECT page_id, x, lower(' wiki/topics/' || x || '.md|alias ') AS target, trim('Wiki/Topics/' || x || '.MD') AS slug, 'topics/' || x AS path FROM v""")
def link_spellings(spark, sf):
    n = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("x"))
    y = F.concat(F.lit(" Wiki/Topics/"), F.col("x"), F.lit(".MD|Alias "))
    page = F.concat(F.lit("./Wiki/Topics/"), F.col("x"), F.lit(".md?v=1#top"))
    return n.select("page_id", "x", T.wiki_target(y).alias("target"), T.related_slug(y).alias("slug"), T.related_path(page).alias("path"))
