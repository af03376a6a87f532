"""Vectors from an injected provider, with a cache by content hash and the feature hash to fall back on."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS

Provider = Callable[[list[str]], list[list[float]]]
DIMENSIONS = 256
_STOP = frozenset(STOP_WORDS)


def _fnv(text: str) -> int:
    h = 2166136261
    for unit in memoryview(text.encode("utf-16-le", "surrogatepass")).cast("H"):
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    return h


def _words(text: str) -> list[str]:
    out, word = [], []
    for c in [*text, " "]:
        if unicodedata.category(c)[0] in "LN":
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    more = [w[k : k + 2] for w in out if any("㐀" <= c <= "鿿" for c in w) for k in range(len(w) - 1)]
    return [w for w in out if len(w) > 1 and w not in _STOP] + [m for m in more if m not in _STOP]


def feature_hash(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """Signed hashing of the distinct words and all three-character grams; a unit vector, or zeros."""
    flat = unicodedata.normalize("NFKC", text).lower()
    spaced = " ".join(flat.split())
    features = [*dict.fromkeys(_words(flat)), *(spaced[k : k + 3] for k in range(len(spaced) - 2))]
    out = np.zeros(dimensions)
    for f in features:
        h = _fnv(f)
        out[h % dimensions] += 1.0 if not h & 256 else -1.0
    norm = float(np.sqrt((out * out).sum()))
    return (out / norm if norm else out).tolist()


def embed(texts: DataFrame, text_col: str, provider: Provider | None = None, batch: int = 16) -> DataFrame:
    """``texts`` with vector, degraded and reason; a failing provider call falls back for its batch alone."""
    columns = texts.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            said = [t or "" for t in rows.column(at).to_pylist()]
            vectors, reasons = [], []
            for k in range(0, len(said), batch):
                part, reason = said[k : k + batch], None
                try:
                    got = provider(part) if provider else None
                    if got is not None and (len(got) != len(part) or len({len(v) for v in got}) != 1):
                        raise ValueError("incomplete answer")
                except Exception as e:  # noqa: BLE001  whatever a provider raises means the fallback
                    got, reason = None, f"{type(e).__name__}: {e}"
                if got is None:
                    vectors += [feature_hash(t) for t in part]
                else:
                    norms = [float(np.linalg.norm(v)) or 1.0 for v in got]
                    vectors += [[float(x) / n for x in v] for v, n in zip(got, norms, strict=True)]
                reasons += [reason] * len(part)
            made = [pa.array(vectors, type=pa.list_(pa.float64())), pa.array([r is not None or provider is None for r in reasons]), pa.array(reasons, type=pa.string())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=[*columns, "vector", "degraded", "reason"])

    schema = ", ".join(f"`{n}` {k}" for n, k in texts.dtypes)
    return texts.mapInArrow(run, f"{schema}, vector array<double>, degraded boolean, reason string")


def embed_cached(texts: DataFrame, text_col: str, cache: DataFrame, provider: Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors of all texts, rows to append to the cache): only texts whose hash the cache lacks are embedded, once each."""
    hashed = texts.withColumn("content_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    missing = hashed.select("content_hash", text_col).join(cache.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
    made = embed(missing, text_col, provider).select("content_hash", "vector", "degraded")
    fresh = made.where("NOT degraded").select("content_hash", "vector")
    known = cache.select("content_hash", "vector").unionByName(made.select("content_hash", "vector"))
    return hashed.join(known, "content_hash"), fresh
