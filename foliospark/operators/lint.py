"""Findings on wiki pages: six rules, links resolved by path or by an alias that one page alone has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space

# Fields that a page's frontmatter should have, and pages that gather others.
FIELDS = ["type", "title", "created", "updated", "tags", "related", "sources", "covers", "summary"]
AGGREGATES = ["wiki/index.md", "wiki/overview.md", "wiki/log.md"]


def link_key(c: Column) -> Column:
    """What two spellings of a link have in common."""
    out = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"(?i)^wiki/", "")
    return F.lower(trim_space(F.regexp_replace(out, r"(?i)\.md$", "")))


def _last(c: Column) -> Column:
    return F.element_at(F.split(c, "/", -1), -1)


def findings(pages: DataFrame) -> DataFrame:
    """(page, code, severity, detail) over pages (path, content).

    A null content is empty.  Links come from the related field and the Related section.
    Aliases are folded per task before they meet, so a name that very many pages share
    is one row; a name of several pages resolves to none.
    """
    text = F.coalesce("content", F.lit(""))
    front = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
    related = F.regexp_extract_all(F.regexp_extract(front, r"(?m)^related:(.*)$", 1), F.lit(r'"([^"]*)"'), F.lit(1))
    section = F.regexp_extract(body, r"(?s)(?:\A|\n)#{1,6} Related[^\n]*\n(.*?)(?=\n#|\z)", 1)
    linked = F.regexp_extract_all(section, F.lit(r"\[\[([^\]|]+)"), F.lit(1))
    base = F.regexp_replace(_last(F.col("path")), r"\.md$", "")
    own = F.regexp_extract(front, r"(?m)^title: *(.*)$", 1)
    p = pages.select(
        F.col("path").alias("page"),
        (trim_space(text) == "").alias("empty"),
        text.rlike(r"(?m)^#\s+").alias("headed"),
        F.array_except(F.array(*map(F.lit, FIELDS)), F.regexp_extract_all(front, F.lit(r"(?m)^([A-Za-z_][\w-]*):"), F.lit(1))).alias("missing"),
        F.array_distinct(F.transform(F.concat(related, linked), link_key)).alias("links"),
        link_key(F.col("path")).alias("slug"),
        F.array_distinct(F.transform(F.array(base, F.when(own == "", base).otherwise(own)), link_key)).alias("names"),
        F.col("path").isin(AGGREGATES).alias("gathers"),
    )
    exact = p.groupBy("slug").agg(F.max("page").alias("exact"))
    alias = p.select("page", F.explode("names").alias("name")).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("alias")).where("n = 1")
    raw = p.select("page", F.explode("links").alias("link")).withColumn("name", _last(F.col("link")))
    met = raw.join(exact, raw["link"] == exact["slug"], "left").join(alias.select("name", "alias"), "name", "left").select("page", "link", F.coalesce("exact", "alias").alias("target"))

    def row(df: DataFrame, code: str, severity: str, detail: Column) -> DataFrame:
        return df.select("page", F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail"))

    own_rules = [
        row(p.where("empty"), "EMPTY_PAGE", "error", F.lit("")),
        row(p.where("NOT headed"), "MISSING_TITLE", "warning", F.lit("")),
        row(p.where("NOT gathers AND size(missing) > 0"), "INCOMPLETE_FRONTMATTER", "warning", F.array_join("missing", ", ")),
        row(p.where("NOT gathers AND size(links) = 0"), "NO_OUTLINKS", "info", F.lit("")),
    ]
    out = row(met.where("target IS NULL"), "BROKEN_LINK", "warning", F.col("link"))
    for rows in own_rules:
        out = out.unionByName(rows)
    inbound = met.where("target IS NOT NULL").select(F.col("target").alias("page")).distinct()
    return out.unionByName(row(p.where("NOT gathers").join(inbound, "page", "left_anti"), "ORPHAN_PAGE", "info", F.lit("")))
