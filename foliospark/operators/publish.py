"""Versioned snapshots of pages: all of a patch set or nothing, readers see what the pointer names.

A version is a folder of Parquet; the pointer file is the only thing that changes.  A
lost executor or driver leaves at most an unreferenced folder.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _write(spark: SparkSession, path: str, text: str) -> None:
    """Write beside and rename over in one step: readers find the old file or the new one, never none."""
    fs, p = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark._sc._gateway.new_array(kinds, 1)
    over[0] = kinds.OVERWRITE
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(beside, p, over)


class _Lock:
    """One committer at a time: a file that only one can create."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.fs, self.path = _fs(spark, f"{root}/commit.lock")

    def __enter__(self) -> None:
        try:
            self.fs.create(self.path, False).close()
        except Py4JJavaError as e:
            raise RuntimeError(f"another commit is under way, or one left {self.path}") from e

    def __exit__(self, *_) -> None:
        self.fs.delete(self.path, False)


def pointer(spark: SparkSession, root: str) -> dict | None:
    fs, p = _fs(spark, f"{root}/current.json")
    if not fs.exists(p):
        return None
    return json.loads(spark.read.text(str(p), wholetext=True).first()[0])


def current(spark: SparkSession, root: str) -> DataFrame:
    """The published pages: path, content, file_hash."""
    at = pointer(spark, root)
    if at is None:
        return spark.createDataFrame([], "path string, content string, file_hash string")
    return spark.read.parquet(f"{root}/{at['version']}")


def conflicts(pages: DataFrame, patches: DataFrame) -> DataFrame:
    """(path, operation, error) of patches that cannot apply; unrelated changes are no conflict."""
    met = patches.join(pages.select("path", F.col("file_hash").alias("have")), "path", "left")
    twice = patches.groupBy("path").count().where("count > 1").select("path", F.lit(True).alias("twice"))
    met = met.join(twice, "path", "left")
    error = (
        F.when(F.col("twice"), "DUPLICATE_PATH")
        .when((F.col("operation") == "create") & F.col("have").isNotNull(), "PAGE_EXISTS")
        .when((F.col("operation") != "create") & F.col("have").isNull(), "PAGE_MISSING")
        .when((F.col("operation") != "create") & ~F.col("have").eqNullSafe(F.col("expected_hash")), "HASH_MISMATCH")
    )
    return met.select("path", "operation", error.alias("error")).where("error IS NOT NULL")


def commit(spark: SparkSession, root: str, patches: DataFrame) -> DataFrame:
    """Apply patches (path, operation, expected_hash, content) and publish; returns the conflicts, empty on success.

    ``remove`` drops a page.  Pages without a patch are carried over as they are.
    """
    before = pointer(spark, root)
    pages = current(spark, root)
    bad = conflicts(pages, patches)
    if not bad.isEmpty():
        return bad
    made = patches.where("operation <> 'remove'").select("path", "content", F.sha2("content", 256).alias("file_hash"))
    version = f"v-{uuid.uuid4().hex}"
    pages.join(patches.select("path"), "path", "left_anti").select("path", "content", "file_hash").unionByName(made).write.parquet(f"{root}/{version}")
    written = spark.read.parquet(f"{root}/{version}")
    n, revision = written.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "file_hash").cast("decimal(38,0)"))).first()
    with _Lock(spark, root):
        if pointer(spark, root) != before:
            raise RuntimeError("the published version changed meanwhile; read it and commit again")
        _write(spark, f"{root}/current.json", json.dumps({"version": version, "pages": n, "revision": str(revision)}))
    return bad
