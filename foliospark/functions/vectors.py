"""Vector and hash functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fnv1a(c: str | Column) -> Column:
    """32-bit FNV-1a over code points; equal to code units but for characters beyond U+FFFF."""
    chars = F.filter(F.split(_col(c), ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product, 0 where lengths differ; the cosine of unit vectors."""
    a, b = _col(a), _col(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def l2_norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(a: str | Column) -> Column:
    """The unit vector; a zero vector stays."""
    norm = l2_norm(a)
    return F.transform(_col(a), lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))
