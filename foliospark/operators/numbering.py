"""Row numbers and running sums over a whole table, without one task that holds it all.

Rows are dealt into ranges of the order by bounds drawn from a sample; a range's count
and sum are added to what the ranges before it have.  The bounds are literals, so every
pass over the input deals alike.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys per range.
_SAMPLED = 50


def _bounds(df: DataFrame, order: list[str], ranges: int) -> list[Column]:
    """Keys that part ``df`` into about ``ranges`` ranges, smallest first."""
    n = df.count()
    if n == 0 or ranges < 2:
        return []
    drawn = df.select(order) if n <= ranges * _SAMPLED else df.select(order).sample(ranges * _SAMPLED / n, seed=1)
    keys = drawn.distinct().orderBy(order).collect()
    cuts = sorted({k * len(keys) // ranges for k in range(1, ranges)} - {0})
    return [F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, keys[k], strict=True))) for k in cuts]


def running(df: DataFrame, order: list[str], number: str = "k", sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with the row number of ``order``, from 1, and running sums (null counts as nothing), both over all rows.

    Nulls come first.  Rows of one key stay in one range, so ``order`` should tell rows apart.
    """
    spark, sums = df.sparkSession, sums or {}
    bounds = _bounds(df, order, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*order)
    dealt = df.withColumns({f"__{c}": F.coalesce(v.cast("long"), F.lit(0)) for c, v in {**sums, number: F.lit(1)}.items()})
    dealt = dealt.withColumn("__range", sum(((b <= key).cast("int") for b in bounds), F.lit(0)))
    totals = dealt.groupBy("__range").agg(*(F.sum(f"__{c}").alias(c) for c in [*sums, number])).orderBy("__range").collect()
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = {}
    for c in [*sums, number]:
        starts = dict(zip([t["__range"] for t in totals], accumulate((t[c] for t in totals), initial=0)))
        before = F.create_map(*(F.lit(x).cast("long") for pair in starts.items() for x in pair)) if starts else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
        made[c] = F.sum(f"__{c}").over(w) + before[F.col("__range").cast("long")]
    return dealt.withColumns(made).drop("__range", *(f"__{c}" for c in [*sums, number]))
