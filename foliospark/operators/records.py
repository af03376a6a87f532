"""Records around a knowledge base: logs, graph and index artefacts, evidence references, page search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space

# What a page search may filter by.
FILTERS = ["domain_schema_id", "snapshot_hash", "layout", "status", "kind", "domain", "abe", "be", "classification_path", "classification_path_prefix", "page_kind"]
MAX_FILTER_CHARS = 500


def append_once(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The log with those new rows whose key it doesn't have yet; of new rows with one key, one."""
    return log.unionByName(new.dropDuplicates([key]).join(log.select(key).distinct(), key, "left_anti").select(log.columns))


def graph(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (page ids with their degree) and edges of a link graph as one table (kind, a, b, degree)."""
    ends = edges.select(F.col("source").alias("a")).unionByName(edges.select(F.col("target").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    nodes = pages.select(F.col("page_id").alias("a")).join(ends, "a", "left").select(F.lit("node").alias("kind"), "a", F.lit(None).cast("long").alias("b"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return nodes.unionByName(edges.distinct().select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.lit(None).cast("long").alias("degree")))


def index_rows(corpus: DataFrame) -> DataFrame:
    """What a lexical index keeps of each document (id, path, title, text): a hash of title and text, and the length."""
    return corpus.select("id", "path", "title", F.sha2(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), 256).alias("hash"), F.length(F.coalesce("text", F.lit(""))).alias("length"))


def resolve_references(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """References (ref, batch, idx) with what stands at that place of the batch's catalog (batch, idx, value), or an error.

    A null or negative index, and one beyond the catalog, is an error; batches without a catalog have length 0.
    """
    sizes = catalog.groupBy("batch").agg((F.max("idx") + 1).alias("n"))
    met = refs.join(catalog.select("batch", "idx", "value"), ["batch", "idx"], "left").join(sizes, "batch", "left")
    n = F.coalesce("n", F.lit(0)).cast("string")
    wrong = F.when(F.col("idx").isNull() | (F.col("idx") < 0), F.lit("must be a non-negative integer index")).when(
        F.col("value").isNull(), F.concat(F.lit("index "), F.col("idx").cast("string"), F.lit(" is out of range for length "), n)
    )
    return met.select("ref", "batch", "idx", "value", wrong.alias("error"))


def normalise_filters(filters: dict[str, str] | None) -> dict[str, str]:
    """Known keys with trimmed texts; anything else is an error."""
    out = {}
    for key, value in (filters or {}).items():
        if key not in FILTERS:
            raise ValueError(f"unknown filter: {key}")
        if not isinstance(value, str) or not value.strip() or len(value) > MAX_FILTER_CHARS:
            raise ValueError(f"filter {key} must be a text of 1 to {MAX_FILTER_CHARS} characters")
        out[key] = value.strip()
    return out


def classifications(pages: DataFrame, columns: list[str], status: str, cap: int = 100) -> DataFrame:
    """Parallel arrays of a page zipped into one array of structs, texts trimmed and cut, empty ones null.

    ``columns`` in order: kind, path, then key and name of domain, abe and be.  A missing
    path is made of the keys.  ``cap`` bounds the structs of a page, as ``n_classifications`` tells.
    """
    text = lambda c, n=500: F.when(trim_space(F.coalesce(c, F.lit(""))) != "", F.substring(trim_space(c), 1, n))
    n = F.greatest(*(F.coalesce(F.size(c), F.lit(0)) for c in columns))

    def one(i: Column) -> Column:
        kind, path, *names = (text(F.get(c, i)) for c in columns)
        joined = F.concat_ws("/", names[0], names[2], names[4])
        labels = ["domain_key", "domain_name", "abe_key", "abe_name", "be_key", "be_name"]
        return F.struct(kind.alias("kind"), text(F.col(status), 100).alias("status"), F.coalesce(path, F.when(joined != "", joined)).alias("path"), *(x.alias(label) for x, label in zip(names, labels, strict=True)))

    places = F.when(n > 0, F.sequence(F.lit(0), F.least(n, F.lit(cap)) - 1)).otherwise(F.array().cast("array<int>"))
    return pages.withColumn("n_classifications", n.cast("long")).withColumn("classifications", F.transform(places, one))


def search(pages: DataFrame, filters: dict[str, str], page_kind: str | None = None) -> DataFrame:
    """Pages one of whose classifications meets all filters, whatever the case; page-level filters come first."""
    wanted = normalise_filters(filters)
    same = lambda c, v: F.lower(trim_space(F.coalesce(c, F.lit("")))) == v.lower()
    for name in ("domain_schema_id", "snapshot_hash", "layout", "page_kind"):
        if name in wanted:
            pages = pages.where(same(F.col(name), wanted[name]))

    def meets(c: Column) -> Column:
        ok = F.lit(True)
        for name in ("status", "kind"):
            if name in wanted:
                ok = ok & same(c[name], wanted[name])
        for name in ("domain", "abe", "be"):
            if name in wanted:
                ok = ok & (same(c[f"{name}_key"], wanted[name]) | same(c[f"{name}_name"], wanted[name]))
        if "classification_path" in wanted:
            ok = ok & same(c["path"], wanted["classification_path"])
        if "classification_path_prefix" in wanted:
            prefix = wanted["classification_path_prefix"].rstrip("/")
            ok = ok & (same(c["path"], prefix) | F.lower(F.coalesce(c["path"], F.lit(""))).startswith(prefix.lower() + "/"))
        return ok

    return pages.where(F.exists("classifications", meets))


def clamp(value: Column, least: int, most: int, default: int) -> Column:
    """A whole number within bounds; anything else is the default."""
    number = value.cast("string").try_cast("double")
    return F.when(number.isNotNull() & (number == F.floor(number)), F.least(F.greatest(number.cast("long"), F.lit(least)), F.lit(most))).otherwise(F.lit(default)).cast("long")


def first_text(c: Column, fields: tuple[str, ...] = ("question", "reason", "content", "message", "text")) -> Column:
    """Of a JSON object the first field that holds a text, trimmed; a plain text stays."""
    found = [trim_space(F.get_json_object(c, f"$.{f}")) for f in fields]
    return F.coalesce(*(F.when(x != "", x) for x in found), c)


def overlaps(ranges: DataFrame, group: str, key: str, width: int) -> DataFrame:
    """(group, a, b): pairs of half-open ranges (start, end) of one group that overlap, the earlier one first.

    Ranges are dealt into buckets of ``width``, so a hot group spreads over its buckets;
    a pair is told in the bucket where the later range starts.
    """
    rows = ranges.where("start < end").select(group, key, "start", "end")
    dealt = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    a = dealt.select(group, "bucket", F.col(key).alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = rows.withColumn("bucket", F.floor(F.col("start") / width)).select(group, "bucket", F.col(key).alias("b"), F.col("start").alias("b_start"))
    first = (F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col("a") < F.col("b")))
    return a.join(b, [group, "bucket"]).where(first & (F.col("b_start") < F.col("a_end"))).select(group, "a", "b")
