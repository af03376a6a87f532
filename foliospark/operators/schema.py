"""Domain Schema directories: a flattened tree, disclosure by level, and resolution of classifications.

``files``: relative_path, raw.  The tree becomes one row per identified node, so that
resolving is a set of joins with a uniqueness guard instead of a walk per page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = "all_domains.json"
#: Fields that give a node an identity.
KEYS, NAMES = ("key", "id"), ("name", "title", "label")
MAX_DEPTH, MAX_HINTS = 40, 200


def canonical(c: str | Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), r"[^\p{L}\p{N}]+", "")


def nodes_of(raw: str) -> list[tuple[str, str, str]]:
    """(pointer, key, name) of nodes that stand in an array or have an identity, depth first."""
    out: list[tuple[str, str, str]] = []

    def walk(value: object, pointer: str, depth: int, listed: bool) -> None:
        if depth > MAX_DEPTH or len(out) >= MAX_HINTS:
            return
        if isinstance(value, dict):
            key = next((str(value[k]) for k in KEYS if value.get(k)), "")
            name = next((str(value[k]) for k in NAMES if value.get(k)), "")
            if listed or key or name:
                out.append((pointer, key, name))
            for k, v in value.items():
                walk(v, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}", depth + 1, False)
        elif isinstance(value, list):
            for k, v in enumerate(value):
                walk(v, f"{pointer}/{k}", depth + 1, True)

    walk(json.loads(raw), "", 0, False)
    return out


def flatten(files: DataFrame) -> DataFrame:
    """(relative_path, domain, pointer, key, name) for every identified node; files that are no JSON give none."""
    names = ["relative_path", "domain", "pointer", "key", "name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, path.split("/")[0] if "/" in path else "", *node) for node in nodes_of(raw or "")]
                except ValueError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.string()) for k in range(5)], names=names)

    return files.select("relative_path", "raw").mapInArrow(run, ", ".join(f"{n} string" for n in names))


def problems(files: DataFrame) -> DataFrame:
    """(relative_path, error): no root, a domain folder without its domain file, nesting, size."""
    folder = F.split("relative_path", "/")
    paths = files.select("relative_path", folder.alias("p"), F.octet_length("raw").alias("bytes"))
    domains = paths.where(F.size("p") == 2).select(F.col("p")[0].alias("d")).distinct()
    wanted = domains.select(F.concat("d", F.lit("/"), "d", F.lit("_domain.json")).alias("relative_path"))
    missing = wanted.join(files.select("relative_path"), "relative_path", "left_anti").select("relative_path", F.lit("domain file is missing").alias("error"))
    deep = paths.where(F.size("p") > 2).select("relative_path", F.lit("nested too deep").alias("error"))
    large = paths.where(F.col("bytes") > 5 << 20).select("relative_path", F.lit("too large").alias("error"))
    root = files.agg(F.count_if(F.col("relative_path") == ROOT).alias("n")).where("n = 0").select(F.lit(ROOT).alias("relative_path"), F.lit("root file is missing").alias("error"))
    return missing.unionByName(deep).unionByName(large).unionByName(root)


def disclose(files: DataFrame, level: str, domain: str = "", abe: str = "") -> DataFrame:
    """The one file of a level (domains, domain or abe): relative_path, raw, file_hash."""
    path = {"domains": ROOT, "domain": f"{domain}/{domain}_domain.json", "abe": f"{domain}/{abe}"}[level]
    if ".." in path or "\\" in path:
        raise ValueError("one path segment is needed")
    return files.where(F.col("relative_path") == path).select("relative_path", "raw", F.sha2("raw", 256).alias("file_hash"))


def snapshot(files: DataFrame) -> DataFrame:
    """One row: file_count, total_bytes, snapshot_hash over paths and hashes in order of path."""
    item = F.struct("relative_path", F.sha2("raw", 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["relative_path"], F.lit("\0"), x["h"])), "\0")
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("total_bytes"), F.sha2(joined, 256).alias("snapshot_hash"))


def resolve(classifications: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add pointer, relative_path and status to rows (id, domain, be).

    ``be`` is a pointer, a key or a name.  An exact pointer wins; else the canonical
    key or name must be unique within the domain.
    """
    rows = classifications.withColumns({"d": canonical("domain"), "b": canonical("be"), "p": F.regexp_replace("be", "^#", "")})
    own = nodes.select(canonical("domain").alias("d"), "relative_path", "pointer", canonical("key").alias("k"), canonical("name").alias("n"))
    exact = own.groupBy("d", F.col("pointer").alias("p")).agg(F.min("relative_path").alias("path1"), F.countDistinct("relative_path").alias("c1")).where("c1 = 1 AND p <> ''").drop("c1")
    spelt = own.select("d", "relative_path", "pointer", F.explode(F.array_distinct(F.array("k", "n"))).alias("b")).where("b <> ''")
    unique = spelt.groupBy("d", "b").agg(F.min(F.struct("relative_path", "pointer")).alias("at"), F.countDistinct("relative_path", "pointer").alias("c2")).where("c2 = 1").drop("c2")
    met = rows.join(exact, ["d", "p"], "left").join(unique, ["d", "b"], "left")
    return met.select(
        *classifications.columns,
        F.coalesce("path1", "at.relative_path").alias("relative_path"),
        F.when(F.col("path1").isNotNull(), F.col("p")).otherwise(F.col("at.pointer")).alias("pointer"),
        F.when(F.coalesce("path1", "at.relative_path").isNotNull(), "classified").otherwise("unresolved").alias("status"),
    )
