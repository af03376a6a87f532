"""Page requirements from candidates, the pages that meet them, their shards, and who owns a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_kind, page_path, page_slug
from ..storage import stored
from .numbering import running


def requirement_id(title: str | Column) -> Column:
    return F.concat(F.lit("page-"), F.substring(F.sha2(page_slug(title), 256), 1, 20))


def requirements(candidates: DataFrame) -> DataFrame:
    """One row per slug of the titles of ``candidates`` (seq, title, kind, collection, batch, override).

    The first title by ``seq`` stays; the kind is that of the last candidate that
    overrides it, else of the first; unknown kinds are topics.  Collections and batches
    are sets, sorted.  Rows without a title are left out.  A hot slug is folded by
    partial aggregates, all of bounded size per distinct collection and batch.
    """
    rows = candidates.where("trim(coalesce(title, '')) <> ''").withColumn("kind", F.coalesce(page_kind("kind"), F.lit("topic")))
    overriding = F.max_by("kind", F.when(F.col("override"), F.col("seq")))
    made = rows.groupBy(requirement_id("title").alias("requirement_id")).agg(
        F.min_by("title", "seq").alias("title"),
        F.coalesce(overriding, F.min_by("kind", "seq")).alias("page_kind"),
        F.array_sort(F.collect_set("collection")).alias("collections"),
        F.array_sort(F.collect_set("batch")).alias("batches"),
        F.count(F.lit(1)).alias("n_candidates"),
    )
    return made.withColumn("preferred_path", page_path("page_kind", "title"))


def existing_pages(required: DataFrame, pages: DataFrame) -> DataFrame:
    """(requirement_id, path, met): the page (path, title, covers) that a requirement already has.

    By its path, else by a page that covers it, else by the slug of the title; of several
    pages the smallest path; without any, the preferred path and ``none``.
    """
    keys = [
        (required.select("requirement_id", F.col("preferred_path").alias("key")), pages.select("path", F.col("path").alias("key")), "path"),
        (required.select("requirement_id", F.col("requirement_id").alias("key")), pages.select("path", F.explode("covers").alias("key")), "covers"),
        (required.select("requirement_id", page_slug("title").alias("key")), pages.select("path", page_slug("title").alias("key")), "title"),
    ]
    met = None
    for k, (left, right, name) in enumerate(keys):
        part = left.join(right.groupBy("key").agg(F.min("path").alias("path")), "key").select("requirement_id", F.struct(F.lit(k).alias("k"), "path", F.lit(name).alias("met")).alias("by"))
        met = part if met is None else met.unionByName(part)
    best = met.groupBy("requirement_id").agg(F.min("by").alias("by"))
    joined = required.select("requirement_id", "preferred_path").join(best, "requirement_id", "left")
    return joined.select("requirement_id", F.coalesce("by.path", "preferred_path").alias("path"), F.coalesce("by.met", F.lit("none")).alias("met"))


def coverage(required: DataFrame, pages: DataFrame) -> DataFrame:
    """(requirement_id, problem, n): requirements that no page covers, and those that several do."""
    covers = pages.select("path", F.explode("covers").alias("requirement_id")).distinct().groupBy("requirement_id").agg(F.count(F.lit(1)).alias("n"))
    met = required.select("requirement_id").join(covers, "requirement_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return met.where("n <> 1").select("requirement_id", F.when(F.col("n") == 0, "missing").otherwise("duplicate").alias("problem"), "n")


def shards(required: DataFrame, pages_per_shard: int) -> DataFrame:
    """(requirement_id, preferred_path, place, shard): numbered by path over the whole table, without one task that holds it."""
    rows = stored(required.select("requirement_id", "preferred_path"), "requirements")
    return running(rows, ["preferred_path", "requirement_id"], "place").withColumn("shard", F.expr(f"(place - 1) div {pages_per_shard} + 1"))


def owners(claims: DataFrame, current: str) -> DataFrame:
    """(path, task): the current task owns what it claims, else the first task by name."""
    return claims.groupBy("path").agg(F.min(F.struct((F.col("task") != current).alias("other"), "task")).alias("o")).select("path", "o.task")
