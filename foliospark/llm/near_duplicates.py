"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, components.

Shingles are five words, hashed to 64 bits.  Two permutations make every signature
coordinate: the first maps a shingle into [0, 2**32), the second is applied after a
circular shift by the coordinate's number.  ``BANDS`` bands of ``ROWS`` coordinates
miss a pair at similarity 0.85 with probability below 1e-6.

Texts with the same shingle set are one class before anything else, so copies cost
one row however many there are.  A bucket first links its members to one pivot: a row
per member, not a pair per two.  After the verified links have made components, only
buckets that still hold several components compare members across them, in blocks.
Every comparison is on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .components import components
from .runtime import drop_stored, free_shuffles, packs, stored, text_bytes, tune, unused

SHINGLE = 5
BANDS, ROWS = 24, 5
#: Percent of the union that the intersection must reach.
PERCENT = 85
#: Members of a bucket that all others are compared with first, each the least by another hash.
PIVOTS = 4
#: Members of a bucket that one block holds.
BLOCK = 48
#: Ids that may be broadcast: 16 bytes each in a hash table, some 16 MB.
BROADCAST_IDS = 300_000


def _permutation(first: int, second: int):
    """A fixed permutation of [0, 2**32): odd factors and shifts are each undone by another."""

    def permuted(x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint32(16))
        x *= np.uint32(first)
        x ^= x >> np.uint32(13)
        x *= np.uint32(second)
        x ^= x >> np.uint32(16)
        return x

    return permuted


#: The two permutations of the method: the first breaks up structure, the second is shifted for every coordinate.
_scatter = _permutation(0x85EBCA6B, 0xC2B2AE35)
_ranked = _permutation(0x2C1B3C6D, 0x297A2D39)


def shingle_sets(blobs: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text's begin (one more at the end)."""
    buf = np.frombuffer(b"\n".join(blobs).translate(hashing.FOLD_CASE), dtype=np.uint8)
    edges = np.cumsum([0] + [len(b) + 1 for b in blobs])
    starts, stops = hashing.word_bounds(buf)
    words = hashing.word_hashes(buf, starts, stops)
    first = np.searchsorted(starts, edges)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(blobs)), n_words)
    whole = hashing.shingles(words, k)
    inside = doc[: len(whole)] == doc[k - 1 : k - 1 + len(whole)]
    hashes, docs = [whole[inside]], [doc[: len(whole)][inside]]
    for n in range(1, k):
        few = np.flatnonzero(n_words == n)
        if len(few):
            grid = words[first[few][:, None] + np.arange(n)]
            hashes.append(np.array([hashing.shingles(row, n)[0] for row in grid], dtype=np.uint64))
            docs.append(few)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[fresh], d[fresh]
    return h, np.searchsorted(d, np.arange(len(blobs) + 1))


def signatures(h: np.ndarray, cuts: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys, one row per text with a shingle: 64-bit, with the band's number mixed in."""
    some = np.flatnonzero(np.diff(cuts))
    keys = np.zeros((len(some), bands), dtype=np.uint64)
    if not len(some):
        return keys
    placed = _scatter((h >> np.uint64(32)).astype(np.uint32))
    at = cuts[some]
    for band in range(bands):
        key = np.full(len(some), band + 1, dtype=np.uint64)
        for row in range(rows):
            least = np.minimum.reduceat(_ranked(placed + np.uint32(band * rows + row + 1)), at)
            key = hashing.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        keys[:, band] = key
    return keys


def _sign(blobs: list[bytes]) -> tuple[pa.Array, pa.Array, pa.Array]:
    h, cuts = shingle_sets(blobs)
    n = np.diff(cuts)
    some = n > 0
    keys = signatures(h, cuts)
    same = pa.array(_prints(h, cuts), type=pa.binary())
    offsets = np.concatenate([[0], np.cumsum(np.where(some, keys.shape[1], 0))])
    return pa.array(n, type=pa.int64()), same, pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))


def _sign_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column(1).to_pylist()
        for a, b in packs(blobs):
            keys = pa.array([hashlib.sha256(x).digest() for x in blobs[a:b]], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), keys, *_sign(blobs[a:b])], names=["id", "text_key", "n", "same", "bands"])


def _sets_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, text) to (same, its sorted shingle hashes as bytes), where the text has that set."""
    for batch in batches:
        asked, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in packs(blobs):
            h, cuts = shingle_sets(blobs[a:b])
            same = _prints(h, cuts)
            rows = [(s, h[cuts[k] : cuts[k + 1]].tobytes()) for k, s in enumerate(same) if s == asked[a + k]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.binary()) for k in (0, 1)], names=["same", "hashes"])


def _prints(h: np.ndarray, cuts: np.ndarray) -> list[bytes | None]:
    """A 128-bit print of each set, the same whatever the order; None for an empty set."""
    some = np.diff(cuts) > 0
    prints = np.zeros((len(some), 2), dtype=np.uint64)
    if some.any():
        for k in (0, 1):
            prints[some, k] = np.add.reduceat(hashing.mix(h + np.uint64(k * 0x51ED270B + 1)), cuts[:-1][some])
    return [p.tobytes() if s else None for p, s in zip(prints, some, strict=True)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            keep = [_similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)]
            mask = pa.array(keep, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _block_links(left: list[dict], right: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between members of two blocks with different roots.

    The right block's hashes are sorted once; each member of the left block looks its
    own up, and counting the owners of what it finds gives all its intersections.
    """
    theirs = [np.frombuffer(m["hashes"], np.uint64) for m in right]
    sizes = np.array([len(x) for x in theirs])
    owner = np.repeat(np.arange(len(right)), sizes)
    values = np.concatenate(theirs)
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    roots = np.array([m["root"] for m in right], dtype=object)
    found = []
    for m in left:
        own = np.frombuffer(m["hashes"], np.uint64)
        near = (100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own))) & (roots != m["root"])
        if not near.any():
            continue
        lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        count = hi - lo
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) - np.repeat(ends - count - lo, count)
        both = np.bincount(owner[at], minlength=len(right))
        near &= 100 * both >= percent * (sizes + len(own) - both)
        found += [(m["same"], right[k]["same"]) for k in np.flatnonzero(near)]
    return found


def _across(percent: int):
    """Rows of two blocks of one bucket to links between different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for k in range(batch.num_rows) for x in _block_links(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], type=pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def _edges(df: DataFrame, fn) -> DataFrame:
    return df.mapInArrow(fn, "a binary, b binary")


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links; a null id is never the
    smallest.  kept is whether that is the row's own id; rows of a component without
    any id are kept.  A text without words has no shingles, links with nothing and is
    its own component.  Rows that repeat an id are documents of their own.  Other
    columns are not read; an empty table gives no rows.
    """
    out = _classed(docs, id_col, text_col, percent)
    component = F.when(F.col("component").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one row of each class of near duplicates, all columns kept, whatever their names.

    The row with the smallest id stays; a null id is larger than any other.  Rows are
    told apart by id and text: of rows that repeat both, one stays; two texts under one
    id are judged each for itself.  Texts without words all stay.
    """
    columns = docs.columns
    classed = stored(_classed(docs, id_col, text_col, percent).where("n > 0").select("id", "text_key", F.coalesce("root", "same").alias("of")), "classed", few=True)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key"))
    best = classed.groupBy("of").agg(first.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("of", "best.id", "best.text_key")
    several = stored(classed.join(best.select("of", F.col("id").alias("best_id"), F.col("text_key").alias("best_key")), "of"), "several", few=True)
    beaten = ~(F.col("id").eqNullSafe(F.col("best_id")) & (F.col("text_key") == F.col("best_key")))
    losers = several.where(beaten).select("id", "text_key").distinct()
    repeats = stored(several.where(~beaten).groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeats", few=True)
    own = unused(columns, "text_key")
    keyed = docs.withColumn(own, F.unhex(F.sha2(text_bytes(docs[text_col]), 256)))
    met = lambda other: keyed[id_col].cast("long").eqNullSafe(other["id"]) & (keyed[own] == other["text_key"])
    kept = keyed.join(losers, met(losers), "left_anti")
    if not repeats.isEmpty():
        again = keyed.join(repeats, met(repeats), "left_semi").dropDuplicates([id_col, own])
        kept = kept.join(repeats, kept[id_col].cast("long").eqNullSafe(repeats["id"]) & (kept[own] == repeats["text_key"]), "left_anti").unionByName(again)
    return kept.drop(own)


def _classed(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Per input row: id, text_key, n, same (print of its set), root of its component and the component's least id (null: alone)."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_bytes(docs[text_col]).alias("text"))
    signed = stored(rows.mapInArrow(_sign_all, "id long, text_key binary, n long, same binary, bands array<long>"), "signed")

    # One row per shingle set; equal sets are folded within each task before they are shuffled.
    classes = stored(
        signed.where("same IS NOT NULL").groupBy("same").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands")),
        "classes",
        few=True,
    )
    banded = classes.select("same", "n", F.explode("bands").alias("key"))
    pivots = F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64("same", F.lit(k)).alias("by"), "same", "n")) for k in range(PIVOTS))))
    buckets = banded.groupBy("key").agg(pivots.alias("pivots"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = buckets.select("key", F.array_distinct(F.transform("pivots", lambda p: F.struct(p["same"].alias("same"), p["n"].alias("n")))).alias("pivots"))
    members = stored(banded.join(buckets, "key").select("key", "same", "n", "pivots"), "members", few=True)

    sets = _candidate_sets(rows, classes.select("same", "rep"), members)
    stars = members.select("same", "n", F.explode("pivots").alias("p")).select("same", "n", F.col("p.same").alias("pivot"), F.col("p.n").alias("pivot_n"))
    fits = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent
    stars = stars.where((F.col("same") != F.col("pivot")) & fits).select(F.least("same", "pivot").alias("a"), F.greatest("same", "pivot").alias("b")).distinct()
    left = sets.select(F.col("same").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("same").alias("b"), F.col("hashes").alias("y"))
    # Sets are large: they meet their pairs by a merge at every size of the corpus.
    links = stored(_edges(stars.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y"), _verify(percent)), "links", few=True)
    roots = stored(components(links), "roots", few=True)
    free_shuffles(spark)

    # Buckets that still hold several components; pairs with a pivot are verified already.
    pivot = F.exists("pivots", lambda p: p["same"] == F.col("same"))
    rooted = members.select("key", "same", pivot.alias("pivot")).join(roots.withColumnRenamed("node", "same"), "same", "left")
    rooted = stored(rooted.select("key", "same", "pivot", F.coalesce("root", "same").alias("root")), "rooted", few=True)
    parts = rooted.where("NOT pivot").groupBy("key", "root").agg(F.count(F.lit(1)).alias("own"))
    small = F.sum(F.when(F.col("own") < BLOCK, F.col("own")).otherwise(0))
    several = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), small.alias("small")).where("parts > 1")
    open_ = rooted.where("NOT pivot").join(several.select("key", "small"), "key").join(parts, ["key", "root"])
    more = _cross_links(open_, sets, percent)
    # The graph of components is small: its own components give every node its final root.
    name = lambda of: roots.select(F.col("node").alias(of), F.col("root").alias(f"{of}_root"))
    met = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    above = stored(components(met, "joined"), "above", few=True)
    rest = above.join(roots.select("node"), "node", "left_anti")
    final = stored(roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(rest), "final", few=True)

    named = classes.select("same", "rep", "copies").join(final.withColumnRenamed("node", "same"), "same", "left").select("same", "rep", "copies", "root")
    smallest = named.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("component"))
    owners = named.join(smallest, "root", "left").select("same", F.coalesce("component", "rep").alias("component"), "copies", "root")
    # Rows that are alone need no lookup; hot classes are joined by rows that Spark can split.
    shared = stored(owners.where("copies > 1 OR root IS NOT NULL").select("same", "component", "root"), "owners", few=True)
    drop_stored(classes, members, sets, links, roots, rooted, above, final)
    return signed.select("id", "text_key", "n", "same").join(shared, "same", "left")


def _candidate_sets(rows: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """Full sets of the classes that share a bucket with another: (same, hashes)."""
    wanted = stored(members.select("same").distinct().join(classes, "same").select("same", F.col("rep").alias("id")), "wanted", few=True)
    # A class whose rows all lack an id is looked up by the null id.
    n = wanted.count()
    side = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
    asked = rows.join(side, rows["id"].eqNullSafe(side["id"])).select("same", "text")
    return stored(asked.mapInArrow(_sets_all, "same binary, hashes binary").dropDuplicates(["same"]), "sets", few=True)


def _cross_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components in the same bucket, block against block."""
    salt = lambda n: F.pmod(F.xxhash64("same"), F.greatest(F.lit(1), F.ceil(n / BLOCK))).cast("string")
    # Blocks of a large component hold nothing else, so that no block meets another of the same component.
    large = F.concat(F.hex("root"), F.lit("/"), salt(F.col("own")))
    salted = open_.withColumn("block", F.when(F.col("own") >= BLOCK, large).otherwise(salt(F.col("small"))))
    blocks = (
        salted.join(sets, "same")
        .groupBy("key", "block")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.collect_list(F.struct("same", "root", "hashes")).alias("held"))
    )
    blocks = stored(blocks, "blocks", few=True)
    other = blocks.select("key", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("held").alias("theirs"))
    pairs = blocks.join(other, "key").where("block <= block2 AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
    return _edges(pairs.select("held", "theirs"), _across(percent)).distinct()
