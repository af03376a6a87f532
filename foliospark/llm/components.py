"""Connected components of an edge table: folding by union-find, then alternating large and small stars.

Tasks of ``FOLD`` edges each, as many as the edges need, fold them to the least node of
their trees; what one task has folded alone is done.  Otherwise a large and a small star
join what the tasks found, and the next round folds fewer edges.  Nothing leaves the
executors; each round is stored, so lineage stays short and a lost executor costs one
round at most.  The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop_stored, stored

#: Edges that a task folds at once: some 50 MB in a Python worker.
FOLD = 200_000


def _forest(edges: list[tuple]) -> dict:
    """Union-find: the least node of its tree for every node that has a smaller one."""
    above: dict = {}

    def root(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above.setdefault(up, up)
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {x: r for x in list(above) if (r := root(x)) != x}


def _fold(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        schema = None

        def stars() -> pa.RecordBatch:
            made = _forest(held)
            return pa.RecordBatch.from_arrays([pa.array(list(x), type=schema.types[0]) for x in (made.keys(), made.values())], names=["a", "b"])

        for batch in batches:
            schema = batch.schema
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= limit:
                yield stars()
                held = []
        if held:
            yield stars()

    return run


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours on the least node of each neighbourhood; hubs are pre-aggregated by ``min``."""
    if small:
        arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        arcs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = arcs.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components", fold: int = FOLD) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node of its component.

    Rows with a null end, loops and repeated edges do no harm; no edges give no rows.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    kind = clean.schema["a"].dataType.simpleString()
    held = stored(clean, label, few=True)
    seen = None
    while True:
        tasks = max(1, -(-held.count() // fold))
        made = stored(held.coalesce(tasks).mapInArrow(_fold(fold), f"a {kind}, b {kind}"), label)
        drop_stored(held)
        held = made
        if tasks == 1:
            break
        made = stored(_star(_star(held, small=False), small=True), label, few=True)
        drop_stored(held)
        held = made
        now = tuple(held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = held.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
