"""Validation of analyses as rules over candidate rows.

``candidates``: batch_id, collection, idx, local_id, confidence (as text), text, refs
(array of chunk_id and quote).  Every rule is an expression or a join; what breaks it
is a row (batch_id, code, path, message), never an exception, so a batch of any number
of analyses is one plan.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unique_tokens

MAX_REUSE = 8
COLLECTIONS = ["entities", "concepts", "claims", "relations", "contradictions", "candidatePages", "reviewItems"]
ERRORS = ["batch_id", "code", "path", "message"]


def grounding_text(c: Column) -> Column:
    """Comparable form of a quote: no emphasis marks, straight quotes, single spaces, lower case."""
    out = F.regexp_replace(c, r"[*_`~]+", "")
    out = F.translate(out, "“”‘’", "\"\"''")
    return F.lower(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")))


def supported(text: Column, evidence: Column) -> Column:
    """The quote holds the text or the text the quote (3 characters or more), or they share two terms and half of the text's."""
    a, b = grounding_text(text), grounding_text(evidence)
    terms = unique_tokens(text)
    shared = F.size(F.array_intersect(terms, unique_tokens(evidence)))
    inside = ((F.length(a) >= 3) & b.contains(a)) | ((F.length(b) >= 3) & a.contains(b))
    return inside | ((shared >= 2) & (shared >= 0.5 * F.size(terms)))


def _path() -> Column:
    return F.concat(F.col("collection"), F.lit("["), F.col("idx").cast("string"), F.lit("]"))


def _errors(rows: DataFrame, code: str, message: Column | str, path: Column | None = None) -> DataFrame:
    said = F.lit(message) if isinstance(message, str) else message
    return rows.select("batch_id", F.lit(code).alias("code"), (_path() if path is None else path).alias("path"), said.alias("message"))


def shape_errors(candidates: DataFrame) -> DataFrame:
    confidence = F.try_to_number(F.col("confidence"), F.lit("9.999999"))
    rows = [
        _errors(candidates.where(~F.col("collection").isin(COLLECTIONS)), "UNKNOWN_COLLECTION", "collection is not known"),
        _errors(candidates.where(F.col("confidence").isNotNull() & ~F.coalesce(confidence.between(0, 1), F.lit(False))), "CONFIDENCE", "confidence must be between 0 and 1"),
        _errors(candidates.where(F.coalesce(F.size("refs"), F.lit(0)) <= 0), "NO_SOURCE", "at least one source reference is needed"),
        _errors(candidates.where((F.col("collection") == "reviewItems") & (F.coalesce(F.trim("text"), F.lit("")) == "")), "EMPTY_CONTENT", "content must not be empty"),
    ]
    twice = candidates.where("local_id IS NOT NULL").groupBy("batch_id", "local_id").count().where("count > 1")
    rows.append(_errors(twice, "DUPLICATE_ID", F.concat(F.lit("duplicate local id: "), F.col("local_id")), F.col("local_id")))
    return reduce(DataFrame.unionByName, rows)


def reference_errors(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """References to chunks (batch_id, chunk_id, text) that are not there, and quotes that their chunk does not hold."""
    refs = candidates.select("batch_id", "collection", "idx", F.explode("refs").alias("r")).select("batch_id", "collection", "idx", "r.chunk_id", "r.quote")
    met = refs.join(chunks.select("batch_id", "chunk_id", F.col("text").alias("chunk")), ["batch_id", "chunk_id"], "left")
    missing = _errors(met.where("chunk IS NULL"), "UNKNOWN_CHUNK", "the chunk does not belong to this batch")
    quote = grounding_text(F.col("quote"))
    absent = met.where(F.col("chunk").isNotNull() & (F.coalesce(quote, F.lit("")) != "") & ~grounding_text(F.col("chunk")).contains(quote))
    return missing.unionByName(_errors(absent, "QUOTE_NOT_FOUND", "the quote is not in its chunk"))


def grounding_errors(candidates: DataFrame, max_reuse: int = MAX_REUSE) -> DataFrame:
    """Candidates whose quotes do not support them, and references used too often."""
    quotes = F.array_join(F.transform("refs", lambda r: F.coalesce(r["quote"], F.lit(""))), "\n")
    with_text = candidates.where((F.coalesce(F.size("refs"), F.lit(0)) > 0) & (F.coalesce(F.trim("text"), F.lit("")) != "")).withColumn("evidence", quotes)
    bare = _errors(with_text.where(F.trim("evidence") == ""), "NO_QUOTE", "a quote that supports the content is needed")
    weak = _errors(with_text.where((F.trim("evidence") != "") & ~supported(F.col("text"), F.col("evidence"))), "UNSUPPORTED", "the quote does not lexically support the content")
    used = candidates.select("batch_id", F.explode("refs").alias("r")).groupBy("batch_id", "r").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_reuse)
    reuse = _errors(used, "REUSED_SOURCE", F.concat(F.lit("one source reference is used by "), F.col("n").cast("string"), F.lit(" candidates")), F.col("r.chunk_id"))
    return bare.unionByName(weak).unionByName(reuse)


def validate(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """All errors; a batch without a row here is valid."""
    return shape_errors(candidates).unionByName(reference_errors(candidates, chunks)).unionByName(grounding_errors(candidates)).select(*ERRORS)


def _comparable(text: str, relaxed: bool) -> tuple[str, list[int], list[int]]:
    """Compatibility characters, single spaces and, if relaxed, straight quotes without emphasis; with the place of each character."""
    out: list[tuple[str, int, int]] = []
    gap: list[int] | None = None
    for at, char in enumerate(text):
        for c in unicodedata.normalize("NFKC", char):
            if c.isspace():
                gap = [gap[0] if gap else at, at + 1]
                continue
            if gap and out and out[-1][0] != " ":
                out.append((" ", *gap))
            gap = None
            if relaxed:
                if c in "*`":
                    continue
                c = '"' if c in "“”„‟" else "'" if c in "‘’‚‛" else c
            out.append((c, at, at + 1))
    return "".join(c for c, _, _ in out), [a for _, a, _ in out], [b for _, _, b in out]


def original_quote(source: str, quote: str) -> str | None:
    """The one place of a source that a quote names but for spaces, compatibility forms, quotation marks or emphasis; None if there is none or several."""
    for relaxed in (False, True):
        held, starts, ends = _comparable(source, relaxed)
        asked = _comparable(quote, relaxed)[0].strip()
        first = held.find(asked) if asked else -1
        if first >= 0 and held.find(asked, first + 1) < 0:
            return source[starts[first] : ends[first + len(asked) - 1]]
    return None
