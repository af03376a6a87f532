"""Registered queries on ingest, validation, planning, publishing and task state, and their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest, numbering
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _n(name="n"):
    return F.count(F.lit(1)).alias(name)


# -- sources --------------------------------------------------------------------------------


@query("content_hash_dedupe", "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY sha256(text)")
def content_hash_dedupe(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash")).groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), _n())


@query("media_type_identity", """WITH d AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 2 = 0 THEN 'text/markdown' ELSE 'text/plain' END AS mt FROM documents),
f AS (SELECT *, first_value(mt) OVER (PARTITION BY h ORDER BY doc_id) AS ft FROM d)
SELECT doc_id, 'source-' || substring(CASE WHEN mt = ft THEN h ELSE sha256(h || chr(0) || mt) END, 1, 24) AS source_id FROM f""")
def media_type_identity(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.when(F.col("doc_id") % 2 == 0, "text/markdown").otherwise("text/plain").alias("mt"))
    d = d.withColumn("ft", F.first("mt").over(Window.partitionBy("h").orderBy("doc_id")))
    return d.select("doc_id", ingest.storage_id(F.col("h"), F.col("mt"), F.col("ft")).alias("source_id"))


@query("media_routing", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/pdf' WHEN 3 THEN NULL ELSE 'text/plain' END AS media_type FROM pages""")
def media_routing(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, [".md", ".HTML", ".pdf", ".xls", ".txt"])), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", ingest.media_type(F.concat(F.lit("in/a.b/file"), ext)).alias("media_type"))


@query("size_guard", "SELECT doc_id, strlen(text) AS size_bytes FROM documents WHERE strlen(text) > 10000")
def size_guard(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size_bytes")).where("size_bytes > 10000")


@query("equivalent_task", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'F' THEN 1 ELSE 0 END DESC, o_orderdate DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE k = 1""")
def equivalent_task(spark, sf):
    prio = F.when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    # The best of a key by one aggregate: partial maxima per task, no sort of the whole key.
    best = F.max_by("o_orderkey", F.struct(prio, "o_orderdate", (-F.col("o_orderkey"))))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(best.alias("o_orderkey"))


@query("html_to_markdown")
def html_to_markdown(spark, sf):
    made = ingest.per_document(table(spark, sf, "pages"), "page_id", "html", lambda h: [(ingest.html_to_markdown(h),)], [("markdown", "string", pa.string())])
    return made.select("page_id", F.length("markdown").cast("long").alias("n_chars"), F.sha2("markdown", 256).alias("markdown_sha256"))


@query("html_text_strip", r"""SELECT page_id, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>[^<]*(?:</p>[^<]*)*</script>', '', 'g'), '<style[^>]*>[^<]*</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS BIGINT) AS n_chars FROM pages""")
def html_text_strip(spark, sf):
    c = F.col("html")
    for pattern, to in ((r"<script[^>]*>[^<]*(?:</p>[^<]*)*</script>", ""), (r"<style[^>]*>[^<]*</style>", ""), (r"<[^>]+>", " "), (r"[ \t\r\n]+", " ")):
        c = F.regexp_replace(c, pattern, to)
    return table(spark, sf, "pages").select("page_id", F.length(F.trim(c)).cast("long").alias("n_chars"))


@query("document_blocks")
def document_blocks(spark, sf):
    return ingest.document_blocks(table(spark, sf, "documents"), "doc_id", "text").groupBy("doc_id", "kind").agg(_n(), F.sum(F.length("text")).alias("n_chars"))


@query("document_chunks")
def document_chunks(spark, sf):
    made = ingest.document_chunks(table(spark, sf, "documents"), "doc_id", "text", 3000)
    return made.select("doc_id", "ordinal", "start_offset", "end_offset", "token_estimate", "content_hash")


@query("chunk_totals")
def chunk_totals(spark, sf):
    """Of every document with a chunk, whatever its length and blank lines; SQL cannot cut chunks."""
    made = ingest.document_chunks(table(spark, sf, "documents"), "doc_id", "text", 3000)
    return made.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars"))


@query("evidence_catalog")
def evidence_catalog(spark, sf):
    made = ingest.per_document(table(spark, sf, "documents"), "doc_id", "text", lambda t: [(q,) for q in ingest.evidence(t)], [("quote", "string", pa.string())])
    return made.select("doc_id", "ordinal", F.length("quote").cast("long").alias("n_chars"), F.sha2("quote", 256).alias("quote_sha256"))


@query("batch_pack", """WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
p AS (SELECT conv_id, turn, s, k, CAST(1 AS BIGINT) AS batch, s AS used FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.turn, t.s, t.k, CASE WHEN p.used + t.s > 600 THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.used + t.s > 600 THEN t.s ELSE p.used + t.s END FROM p JOIN t ON t.conv_id = p.conv_id AND t.k = p.k + 1)
SELECT conv_id, turn, s AS size, batch FROM p""")
def batch_pack(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return ingest.pack(rows, "conv_id", "turn", "size", 600)


@query("batch_statistics", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS char_count, CAST(sum(strlen(text)) AS BIGINT) AS payload_bytes, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS token_estimate FROM conversations GROUP BY conv_id")
def batch_statistics(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("char_count"), F.sum(F.octet_length("text")).alias("payload_bytes"), F.sum(T.token_estimate("text")).alias("token_estimate"))


@query("excel_dates", "SELECT p_partkey, CASE WHEN p_size + 40 = 60 THEN '1900-02-29' ELSE CAST(CAST(DATE '1899-12-31' + CAST(p_size + 40 - CASE WHEN p_size + 40 >= 60 THEN 1 ELSE 0 END AS INTEGER) AS DATE) AS VARCHAR) END AS day FROM part")
def excel_dates(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.excel_date(F.col("p_size") + 40).alias("day"))


@query("column_names", """WITH RECURSIVE c AS (SELECT p_partkey, p_partkey AS n, '' AS col FROM part
  UNION ALL SELECT p_partkey, (n - 1) // 26, chr(CAST(65 + (n - 1) % 26 AS INTEGER)) || col FROM c WHERE n > 0) SELECT p_partkey, col FROM c WHERE n <= 0""")
def column_names(spark, sf):
    """Of every key, with as many letters as it needs."""
    return table(spark, sf, "part").select("p_partkey", T.column_name(F.col("p_partkey")).alias("col"))


@query("overlap_range_join", """SELECT a.conv_id AS segment, b.vec_id AS merge_id FROM (SELECT conv_id, min(turn) + conv_id AS lo, max(turn) + conv_id AS hi FROM conversations GROUP BY conv_id) a
JOIN embeddings b ON b.vec_id <= a.hi AND b.vec_id + 3 >= a.lo""")
def overlap_range_join(spark, sf):
    """Ranges meet in buckets as wide as they are, so the join is an equi-join at any size."""
    width = 16
    a = table(spark, sf, "conversations").groupBy("conv_id").agg((F.min("turn") + F.col("conv_id")).alias("lo"), (F.max("turn") + F.col("conv_id")).alias("hi"))
    b = table(spark, sf, "embeddings").select(F.col("vec_id").alias("merge_id"), F.col("vec_id").alias("lo2"), (F.col("vec_id") + 3).alias("hi2"))
    spread = lambda df, lo, hi: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    met = spread(a, "lo", "hi").join(spread(b, "lo2", "hi2"), "bucket").where("lo2 <= hi AND hi2 >= lo")
    once = met.where(F.col("bucket") == F.floor(F.greatest("lo", "lo2") / width))
    return once.select(F.col("conv_id").alias("segment"), "merge_id")


# -- validation -----------------------------------------------------------------------------


@query("reference_integrity", "SELECT l.doc_id, l.quality FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id WHERE e.vec_id IS NULL")
def reference_integrity(spark, sf):
    return table(spark, sf, "labels").select("doc_id", "quality").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


#: So many short quotes are broadcast at most.
_SHORT_QUOTES = 10_000


@query("quote_in_chunk", r"""WITH b AS (SELECT item_id, regexp_replace(text, '[ \t\r\n]+', ' ', 'g') AS q FROM benchmark), d AS (SELECT doc_id, regexp_replace(text, '[ \t\r\n]+', ' ', 'g') AS t FROM documents)
SELECT item_id, doc_id FROM b JOIN d ON contains(t, q)""")
def quote_in_chunk(spark, sf):
    """A quote meets only texts that hold its second to sixth word: an equi-join on a hash, then the substring check.

    Quotes of fewer than seven words have no such key and meet every text.
    """
    flat = lambda c: F.regexp_replace(c, r"[ \t\r\n]+", " ")
    quotes = table(spark, sf, "benchmark").select("item_id", flat("text").alias("q"))
    words = F.split("q", " ")
    # The words inside a quote are whole words of a text; those at its ends need not be.
    short = quotes.where(F.size(words) < 7)
    quotes = quotes.where(F.size(words) >= 7).withColumn("key", F.xxhash64(F.array_join(F.slice(words, 2, 5), " ")))
    texts = table(spark, sf, "documents").select("doc_id", flat("text").alias("t")).withColumn("w", F.split("t", " "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(5)), " ")))
    places = texts.select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
    met = places.join(quotes.select("item_id", "key"), "key").select("item_id", "doc_id").distinct()
    held = F.col("t").contains(F.col("q"))
    long = met.join(quotes, "item_id").join(texts.select("doc_id", "t"), "doc_id").where(held).select("item_id", "doc_id")
    n_short = short.count()
    if n_short == 0:
        return long
    # Counted before they are broadcast; more of them meet the texts in a product of both.
    short = F.broadcast(short) if n_short <= _SHORT_QUOTES else short
    return long.unionByName(texts.select("doc_id", "t").join(short, held).select("item_id", "doc_id"))


@query("evidence_reuse", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 8")
def evidence_reuse(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(_n()).where("n > 8")


_STOP = "['" + "', '".join(T.STOP_WORDS) + "']"


@query("grounding_overlap", rf"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x))) AS a FROM conversations)
SELECT p.conv_id, p.turn, CAST(len(list_intersect(p.a, q.a)) AS BIGINT) AS shared, len(list_intersect(p.a, q.a)) >= 2 AND len(list_intersect(p.a, q.a)) >= 0.5 * len(p.a) AS supported
FROM t p JOIN t q ON p.conv_id = q.conv_id AND q.turn = p.turn + 1""")
def grounding_overlap(spark, sf):
    """How far each whole turn is supported by the next one."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", T.unique_tokens("text").alias("a"))
    met = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    shared = F.size(F.array_intersect("a", "b"))
    return met.select("conv_id", "turn", shared.cast("long").alias("shared"), ((shared >= 2) & (shared >= 0.5 * F.size("a"))).alias("supported"))


@query("confidence_coercion", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_size / 10.0 WHEN p_size % 2 = 0 THEN NULL ELSE 0.5 END AS confidence FROM part")
def confidence_coercion(spark, sf):
    said = F.when(F.col("p_size") < 10, F.concat(F.lit(" 0."), F.col("p_size").cast("string"))).when(F.col("p_size") == 10, "1.0").when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("%"))).otherwise("0.50 ")
    return table(spark, sf, "part").select("p_partkey", T.coerce_confidence(said).alias("confidence"))


@query("materialise_filter", "SELECT doc_id FROM labels WHERE toxic = 0 AND coalesce(CASE WHEN quality = 1 THEN 0.9 WHEN doc_id % 3 = 0 THEN NULL ELSE 0.3 END, 1.0) >= 0.5")
def materialise_filter(spark, sf):
    confidence = F.when(F.col("quality") == 1, 0.9).when(F.col("doc_id") % 3 == 0, F.lit(None).cast("double")).otherwise(0.3)
    return table(spark, sf, "labels").where((F.col("toxic") == 0) & (confidence.isNull() | (confidence >= 0.5))).select("doc_id")


@query("page_paths", r"SELECT p_partkey, 'wiki/concepts/' || regexp_replace(regexp_replace(lower(trim(p_name)), '[^\p{L}\p{N}._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') || '.md' AS path FROM part")
def page_paths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.page_path(F.lit(" Concept "), F.col("p_name")).alias("path"))


@query("path_validation", r"""SELECT page_id, CASE WHEN lang = 'en' THEN NOT regexp_matches(word, '[/\\]') AND word NOT IN ('', '.', '..') WHEN lang = 'de' THEN false WHEN lang = 'fr' THEN NOT regexp_matches(word, '[/\\]') AND word NOT IN ('', '.', '..') ELSE false END AS valid
FROM (SELECT page_id, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang, regexp_extract(html, '<a href="/([^"]*)"', 1) AS word FROM pages)""")
def path_validation(spark, sf):
    """Paths made of the pages' first links: valid ones in two languages, traversal and drive letters in the others."""
    lang, word = F.regexp_extract("html", 'lang="([a-z]*)"', 1), F.regexp_extract("html", '<a href="/([^"]*)"', 1)
    path = F.when(lang == "en", F.concat(F.lit("wiki/topics/"), word, F.lit("/page.MD"))).when(lang == "de", F.concat(F.lit("wiki/topics/../"), word, F.lit(".md")))
    path = path.when(lang == "fr", F.concat(F.lit("wiki/entities/"), word, F.lit("/x.md"))).otherwise(F.concat(F.lit("C:/wiki/topics/"), word, F.lit(".md")))
    return table(spark, sf, "pages").select("page_id", T.valid_page_path(path).alias("valid"))


# -- requirements, coverage, shards ---------------------------------------------------------


@query("requirement_rollup", """SELECT 'page-' || substring(sha256(lower(p_brand)), 1, 20) AS requirement_id, arg_min(p_name, p_partkey) AS title, count(*) AS n_refs, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS kinds FROM part GROUP BY lower(p_brand)""")
def requirement_rollup(spark, sf):
    p = table(spark, sf, "part").withColumn("slug", F.lower("p_brand"))
    return p.groupBy("slug").agg(F.min_by("p_name", "p_partkey").alias("title"), _n("n_refs"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("kinds")).select(F.concat(F.lit("page-"), F.substring(F.sha2("slug", 256), 1, 20)).alias("requirement_id"), "title", "n_refs", "kinds")


@query("relation_symmetry", """WITH e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 45)
SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b""")
def relation_symmetry(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    e = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(s, F.col("l_suppkey") == s["s_suppkey"]).where("a <> b").select("a", "b").distinct()
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


@query("relation_endpoints", """WITH u AS (SELECT s_nationkey AS k, min(s_suppkey) AS only FROM supplier GROUP BY s_nationkey HAVING count(*) = 1), n AS (SELECT n_nationkey, n_regionkey FROM nation)
SELECT c_custkey, coalesce(u.only, -n.n_regionkey) AS endpoint, CASE WHEN u.only IS NOT NULL THEN 'unique' ELSE 'slug' END AS found_by FROM customer LEFT JOIN u ON u.k = c_nationkey LEFT JOIN n ON n.n_nationkey = c_nationkey""")
def relation_endpoints(spark, sf):
    u = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("only"), _n()).where("n = 1").drop("n")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(u, "c_nationkey", "left").join(n, "c_nationkey", "left")
    return c.select("c_custkey", F.coalesce("only", -F.col("n_regionkey")).alias("endpoint"), F.when(F.col("only").isNotNull(), "unique").otherwise("slug").alias("found_by"))


@query("coverage_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def coverage_missing(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("coverage_duplicate", "SELECT l_orderkey, l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1")
def coverage_duplicate(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.countDistinct("l_suppkey").alias("n")).where("n > 1")


@query("shard_manifest", "WITH n AS (SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_name, p_partkey) - 1) // 6 + 1 AS VARCHAR) AS n FROM part) SELECT p_partkey, 'shard-' || lpad(n, CAST(greatest(length(n), 4) AS INTEGER), '0') AS shard FROM n")
def shard_manifest(spark, sf):
    """Over the whole table; a shard number of more than four digits keeps them all."""
    rows = numbering.running(table(spark, sf, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"])
    n = (F.floor((F.col("k") - 1) / 6) + 1).cast("string")
    return rows.select("p_partkey", F.concat(F.lit("shard-"), F.lpad(n, F.greatest(F.length(n), F.lit(4)), F.lit("0"))).alias("shard"))


@query("draft_context", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9500)")
def draft_context(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    p = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    s = table(spark, sf, "supplier").where("s_acctbal > 9500").select(F.col("s_suppkey").alias("l_suppkey"))
    return li.join(p, "l_partkey", "left_semi").select("l_orderkey").unionByName(li.join(s, "l_suppkey", "left_semi").select("l_orderkey")).distinct()


@query("classification_path", "SELECT n_nationkey, r_name || '/' || n_name || '/' || CAST(count(c_custkey) AS VARCHAR) AS path FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, r_name, n_name")
def classification_path(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(_n())
    tree = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(c, "n_nationkey", "left")
    return tree.select("n_nationkey", F.concat_ws("/", "r_name", "n_name", F.coalesce("n", F.lit(0)).cast("string")).alias("path"))


@query("page_search_exists", """SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 40 AND l_linestatus = 'F')""")
def page_search_exists(spark, sf):
    """One and the same nested element satisfies all conditions: a single lambda over the array."""
    own = F.collect_list(F.struct("l_returnflag", "l_quantity", "l_linestatus")).alias("own")
    nested = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(own)
    hit = F.exists("own", lambda c: (c["l_returnflag"] == "R") & (c["l_quantity"] > 40) & (c["l_linestatus"] == "F"))
    return nested.where(hit).select("o_orderkey")


@query("page_cursor", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS total FROM documents WHERE lang = 'fr') SELECT doc_id, k, total FROM r WHERE k > 20 AND k <= 40")
def page_cursor(spark, sf):
    d = table(spark, sf, "documents").where("lang = 'fr'").select("doc_id")
    page = d.orderBy("doc_id").limit(40)  # a cursor's page is a bounded top-k
    ranked = page.withColumn("k", F.row_number().over(Window.orderBy("doc_id")).cast("long")).where("k > 20")
    return ranked.crossJoin(F.broadcast(d.agg(_n("total"))))


@query("page_budget", "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS k, sum(n_chars) OVER (ORDER BY doc_id) AS used FROM documents) SELECT doc_id, k FROM r WHERE used <= 20000 OR k = 1")
def page_budget(spark, sf):
    """The budget runs over the whole table."""
    rows = numbering.running(table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"], sums={"used": F.col("n_chars")})
    return rows.where("used <= 20000 OR k = 1").select("doc_id", "k")


# -- pages and publishing -------------------------------------------------------------------


@query("index_by_kind", "SELECT lang, count(*) AS n, sha256(string_agg('- ' || CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS bullets_sha256 FROM documents GROUP BY lang")
def index_by_kind(spark, sf):
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda d: F.concat(F.lit("- "), d.cast("string"))), "\n")
    return table(spark, sf, "documents").groupBy("lang").agg(_n(), F.sha2(lines, 256).alias("bullets_sha256"))


@query("overview_topn", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) SELECT lang, doc_id, k FROM r WHERE k <= 20")
def overview_topn(spark, sf):
    k = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).cast("long")
    return table(spark, sf, "documents").select("lang", "doc_id", k.alias("k")).where("k <= 20")


@query("source_pages", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def source_pages(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(_n(), F.sum("n_chars").alias("n_chars"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("revision_hash", "SELECT lang, sha256(string_agg(CAST(doc_id AS VARCHAR) || chr(0) || sha256(text) || chr(0), '' ORDER BY doc_id)) AS revision FROM documents GROUP BY lang")
def revision_hash(spark, sf):
    item = F.struct("doc_id", F.sha2("text", 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["doc_id"].cast("string"), F.lit("\0"), x["h"], F.lit("\0"))), "")
    return table(spark, sf, "documents").groupBy("lang").agg(F.sha2(joined, 256).alias("revision"))


@query("snapshot_verify", "SELECT a.doc_id FROM documents a JOIN documents b ON a.doc_id = b.doc_id + 1 WHERE sha256(a.text) <> sha256(b.text)")
def snapshot_verify(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    manifest = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("h").alias("expected"))
    return d.join(manifest, "doc_id").where("h <> expected").select("doc_id")


@query("patch_conflicts", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND c_custkey IS NOT NULL THEN 'PAGE_EXISTS' WHEN o_orderkey % 3 <> 0 AND c_custkey IS NULL THEN 'PAGE_MISSING' WHEN o_orderkey % 3 = 1 AND c_nationkey <> 3 THEN 'HASH_MISMATCH' END AS error
FROM orders LEFT JOIN customer ON c_custkey = o_orderkey""")
def patch_conflicts(spark, sf):
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.lit(True).alias("there"), "c_nationkey")
    p = table(spark, sf, "orders").select("o_orderkey").join(pages, "o_orderkey", "left")
    op = F.col("o_orderkey") % 3
    error = F.when((op == 0) & F.col("there").isNotNull(), "PAGE_EXISTS").when((op != 0) & F.col("there").isNull(), "PAGE_MISSING").when((op == 1) & (F.col("c_nationkey") != 3), "HASH_MISMATCH")
    return p.select("o_orderkey", error.alias("error"))


@query("eviction_lru_budget", """WITH r AS (SELECT p_partkey, CAST(p_retailprice AS BIGINT) AS bytes, p_size AS age FROM part),
k AS (SELECT *, sum(CASE WHEN age > 45 THEN 0 ELSE bytes END) OVER (ORDER BY age, p_partkey) AS held FROM r)
SELECT p_partkey, age > 45 OR held > 20000 AS evicted FROM k""")
def eviction_lru_budget(spark, sf):
    """One budget over the whole table."""
    r = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(20,0)").cast("long").alias("bytes"), F.col("p_size").alias("age"))
    r = numbering.running(r, ["age", "p_partkey"], sums={"held": F.when(F.col("age") > 45, 0).otherwise(F.col("bytes"))})
    return r.select("p_partkey", ((F.col("age") > 45) | (F.col("held") > 20000)).alias("evicted"))


@query("section_ranges", "WITH h AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations) SELECT a.conv_id, a.turn, min(b.turn) AS ends FROM h a LEFT JOIN h b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.level <= a.level GROUP BY 1, 2")
def section_ranges(spark, sf):
    """The next heading of the same level or above, by one window per level instead of a self-join."""
    h = table(spark, sf, "conversations").withColumn("level", F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    ends = F.when(F.lit(False), F.lit(None).cast("long"))
    for level in (1, 2, 3):
        ends = ends.when(F.col("level") == level, F.min(F.when(F.col("level") <= level, F.col("turn"))).over(w))
    return h.select("conv_id", "turn", ends.alias("ends"))


@query("heading_path", "SELECT conv_id, turn, (SELECT max(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND b.role = 'user') AS under FROM conversations a")
def heading_path(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("under"))


# -- tasks, leases, idempotency -------------------------------------------------------------


@query("json_pointer_get", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_pointer_get(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("expired_leases", "SELECT user_id, max(ts) AS leased_at, max(ts) + INTERVAL 30 MINUTE < TIMESTAMP '2024-01-31 00:00:00' AS expired FROM events GROUP BY user_id")
def expired_leases(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp_ntz").alias("leased_at"))
    return e.select("user_id", F.col("leased_at").cast("timestamp").alias("leased_at"), (F.col("leased_at") + F.expr("INTERVAL 30 MINUTES") < F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("expired"))


_TYPES = "(SELECT min(event_type) FROM events)"


@query("interval_join_leases", f"""WITH l AS (SELECT event_id AS lease_id, user_id, ts FROM events WHERE event_type = {_TYPES}), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> {_TYPES})
SELECT c.event_id, count(l.lease_id) AS n_leases FROM c LEFT JOIN l ON l.user_id = c.user_id AND c.ts >= l.ts AND c.ts < l.ts + INTERVAL 30 MINUTE GROUP BY c.event_id""")
def interval_join_leases(spark, sf):
    """Commits fall into their lease's half-hour window: counts by a range frame, so no pair is ever formed."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    lease = e.crossJoin(F.broadcast(e.agg(F.min("event_type").alias("first")))).withColumn("lease", (F.col("event_type") == F.col("first")).cast("long"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-30 * 60 * 1_000_000 + 1, 0)
    return lease.withColumn("n_leases", F.sum("lease").over(w)).where("lease = 0").select("event_id", "n_leases")


@query("first_unleased", "WITH d AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), x AS (SELECT d.* FROM d ANTI JOIN (SELECT doc_id FROM labels) l ON l.doc_id = d.conv_id) SELECT conv_id, min(turn) AS turn FROM x GROUP BY conv_id")
def first_unleased(spark, sf):
    busy = table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"))
    return table(spark, sf, "conversations").where("role = 'user'").join(busy, "conv_id", "left_anti").groupBy("conv_id").agg(F.min("turn").alias("turn"))


@query("idempotency_first_wins", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def idempotency_first_wins(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("idempotency_conflicts", "SELECT user_id, event_type, count(DISTINCT props) AS n_requests FROM events GROUP BY 1, 2 HAVING count(DISTINCT props) > 1")
def idempotency_conflicts(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.countDistinct("props").alias("n_requests")).where("n_requests > 1")


@query("latest_record_sticky_flag", f"SELECT user_id, arg_max(event_type, event_id) AS last_type, bool_or(event_type = {_TYPES}) AS created FROM events GROUP BY user_id")
def latest_record_sticky_flag(spark, sf):
    e = table(spark, sf, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.min("event_type").alias("first"))))
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.bool_or(F.col("event_type") == F.col("first")).alias("created"))


@query("event_replay", "SELECT event_id FROM events WHERE user_id = (SELECT user_id FROM events WHERE event_id = 100) AND event_id > 100")
def event_replay(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    mark = e.where("event_id = 100").select("user_id")
    return e.where("event_id > 100").join(F.broadcast(mark), "user_id", "left_semi").select("event_id")


@query("count_or_timeout_windows", """WITH RECURSIVE t AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
p AS (SELECT user_id, event_id, us, k, CAST(1 AS BIGINT) AS win, us AS opened, CAST(1 AS BIGINT) AS n FROM t WHERE k = 1
 UNION ALL SELECT t.user_id, t.event_id, t.us, t.k, CASE WHEN p.n >= 4 OR t.us - p.opened >= 21600000000 THEN p.win + 1 ELSE p.win END, CASE WHEN p.n >= 4 OR t.us - p.opened >= 21600000000 THEN t.us ELSE p.opened END, CASE WHEN p.n >= 4 OR t.us - p.opened >= 21600000000 THEN 1 ELSE p.n + 1 END
 FROM p JOIN t ON t.user_id = p.user_id AND t.k = p.k + 1)
SELECT event_id, win FROM p""")
def count_or_timeout_windows(spark, sf):
    """A window closes with its fourth event or six hours after its first: a fold over each key's ordered events."""
    e = table(spark, sf, "events").select("user_id", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id").alias("e"))
    start = F.struct(F.lit(0).cast("long").alias("win"), F.lit(0).cast("long").alias("opened"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<event_id:bigint,win:bigint>>").alias("out"))

    def step(a, x):
        new = (a["win"] == 0) | (a["n"] >= 4) | (x["at"] - a["opened"] >= 21_600_000_000)
        win = a["win"] + new.cast("long")
        item = F.struct(x["event_id"].alias("event_id"), win.alias("win"))
        return F.struct(win.alias("win"), F.when(new, x["at"]).otherwise(a["opened"]).alias("opened"), F.when(new, F.lit(1).cast("long")).otherwise(a["n"] + 1).alias("n"), F.concat(a["out"], F.array(item)).alias("out"))

    made = e.groupBy("user_id").agg(F.aggregate(F.array_sort(F.collect_list("e")), start, step)["out"].alias("o"))
    return made.select(F.explode("o").alias("o")).select("o.event_id", "o.win")


@query("progress_counters", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS large, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders GROUP BY 1")
def progress_counters(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(_n(), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.countDistinct("o_custkey").alias("customers"))


@query("task_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def task_list(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "P")).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderstatus")


@query("pending_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def pending_difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("intersection", "SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings")
def intersection(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("finalize_audit", "SELECT count(*) AS n_docs, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality = 1) AS good FROM documents d LEFT JOIN labels l USING (doc_id)")
def finalize_audit(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    return d.agg(_n("n_docs"), F.count_if(F.col("there").isNull()).alias("unlabelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 1).alias("good"))
