"""What the operators of this package share: tables, batches and stored intermediates.

Intermediates go to Parquet below the folder named by ``spark.checkpoint.dir``,
which the driver and all executors share; an executor that is lost takes nothing
with it, and later phases never recompute earlier ones.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python hold about this many bytes, however long the texts are.
BATCH_BYTES = 4 << 20
#: Rows that the Parquet reader decodes at once; its default of 4096 very long texts would fill a heap.
READER_ROWS = 512
#: Texts are worked on in packs of about this many bytes; a longer text is a pack of its own.
PACK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def tune(spark: SparkSession) -> None:
    """Make a session ready: executors get this package's code, Arrow batches a bound in bytes.

    The bound on rows alone admits 10 000 very long texts in one batch.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="foliospark-code-")) / "foliospark_code.zip"
        with zipfile.ZipFile(to, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(to))
        _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set and all runs in this process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("foliospark.checkpoint.dir", "")
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("foliospark.checkpoint.dir", path)
    return path.rstrip("/")


def unused(columns: Iterable[str], name: str) -> str:
    """A column name that a table doesn't have, whatever the case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


#: Folders of stored frames, one list for each open scope.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, whatever was stored since: for work whose result is written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Tasks a core, and shuffle partitions a task, with which a frame is stored in few files.
TASKS_A_CORE, PARTITIONS_A_TASK = 4, 8


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in no more tasks than keep all cores busy, or than one for some shuffle partitions; no row moves.

    On a local folder Hadoop starts a process for each file that it creates, to set its
    permissions, and until that runs it shares the executor's memory and counts as as
    much again.  A frame that is stored from hundreds of nearly empty shuffle partitions
    would start hundreds.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, partitions // PARTITIONS_A_TASK))


def stored(df: DataFrame, label: str, keep: bool = False, few: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here. With ``keep`` it outlives a scope, with ``few`` see ``few_files``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    (few_files(df) if few else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the files of stored frames whose last use is over."""
    for df in frames:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, parent)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of phases that are over.

    The cleaner acts on garbage-collected references, and a large heap collects
    rarely; between phases the files of the last one would stay for nothing.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text; null is empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string").cast("binary")


def packs(blobs: Iterable[bytes], limit: int = PACK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into index ranges of about ``limit`` bytes."""
    start = size = at = 0
    for at, blob in enumerate(blobs):
        if size and size + len(blob) > limit:
            yield start, at
            start, size = at, 0
        size += len(blob) + 1
    if size:
        yield start, at + 1


def by_pack(
    work: Callable[[list[bytes]], dict[str, list]], schema: pa.Schema, limit: int = PACK_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from (id, text bytes) to (id, the columns that ``work`` makes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs = batch.column(0), batch.column(1).to_pylist()
            for a, b in packs(blobs, limit):
                made = work(blobs[a:b])
                columns = [ids.slice(a, b - a)] + [
                    made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], type=f.type)
                    for f in list(schema)[1:]
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run
