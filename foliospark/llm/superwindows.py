"""Finding windows of symbols that occur more than once in a corpus, in bounded shards.

A window is ``window`` consecutive symbols of one document.  The least hash among its
``gram``-symbol grams is its anchor: equal windows have equal anchors.  A document falls
into runs of windows with the same anchor; a run's symbols are its segment, and every
window lies in exactly one segment.  Therefore all copies of a window meet in the shard
of their anchor, and shards can be worked on one by one, however large the corpus.

1. Texts are packed, and the packs stored, compressed.
2. Each pack tells the shards of its anchors which anchors it has, and whether one alone
   may hold a repeated window; a shard answers which of them stand more than once.
3. Packs send the segments of these anchors, equal ones (their bytes compared) once with
   the least id or how often they stand there; a shard decides, by suffix array or
   automaton, see the callers, which of their windows are to go.
4. Packs apply the answers.

Hashes only bring segments together: whether symbols are equal is read from the bytes.
Anchors with very many segments do not gather in one shard: these segments are cut into
single windows, which are spread by their own hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .runtime import PACK_BYTES, drop_stored, free_shuffles, packs, stored, text_bytes, tune

#: Bytes of packed text that one shard answers for.
SHARD_BYTES = 12 << 20
#: Segments of anchors that more packs than this have are cut into windows.
HOT_PACKS = 4096
#: Stands for a null id: larger than any other.
NO_ID = np.iinfo(np.int64).max


@dataclass
class Pack:
    """Some texts as one buffer of symbols."""

    ids: np.ndarray
    #: Start of each text in ``hashes``' units (bytes or words), and one more at the end.
    edges: np.ndarray
    #: Hash of every gram, by start.
    grams: np.ndarray
    data: bytes
    #: Prefix sums of the bytes, from which any range's hash is read.
    sums: np.ndarray | None = None
    #: Byte offsets of the start and end of every symbol; None where symbols are bytes.
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def byte_range(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (first, last) if self.starts is None else (self.starts[first], self.ends[last - 1])

    def content(self, first: int, last: int) -> bytes:
        """Bytes of the symbols ``first`` to ``last``, exclusive."""
        return self.data[first:last] if self.starts is None else self.data[self.starts[first] : self.ends[last - 1]]


@dataclass(frozen=True)
class Windows:
    """How texts become symbols, and the sizes of windows and grams."""

    window: int
    gram: int
    words: bool
    #: Whether two places in one text count as an occurrence elsewhere.
    same_text: bool

    def pack(self, ids: np.ndarray, lengths: np.ndarray, data: bytes) -> Pack:
        buf = np.frombuffer(data, dtype=np.uint8)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        if not self.words:
            sums = hashing.prefix_sums(buf)
            return Pack(ids, edges, hashing.grams(sums, self.gram), data, sums)
        starts, ends = hashing.word_bounds(buf)
        sums = hashing.prefix_sums(buf)
        words = hashing.ranges(sums, starts, ends)
        return Pack(ids, np.searchsorted(starts, edges), hashing.shingles(words, self.gram), data, sums, starts, ends)

    def runs(self, pack: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first window, past the last window, anchor) of every run."""
        least = hashing.sliding_min(pack.grams, self.window - self.gram + 1)
        n = len(least)
        text = np.repeat(np.arange(len(pack.ids)), np.diff(pack.edges))
        inside = text[:n] == text[self.window - 1 : self.window - 1 + n]
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (text[1:n] != text[: max(0, n - 1)])
        first = np.flatnonzero(new)
        stop = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False)) + 1
        return text[first], first, stop, least[first]


#: Texts travel compressed; what they hold is told by their sizes.
_ZSTD = "zstd"


def _press(data: bytes) -> bytes:
    return pa.compress(data, codec=_ZSTD, asbytes=True) if data else b""


def _unpress(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec=_ZSTD, asbytes=True) if size else b""


def _bytes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


#: Bytes of an anchor, beside its shard's number.
_ANCHOR = 5
#: What a shard answers for an anchor: its segments are asked for, whole or as single windows.
SHIP, SPLIT = 1, 2
#: What a pack says of an anchor: it has several segments with it; one of them may repeat a window.
_SEVERAL, _SELF = 1, 2


def _shards_of(values: np.ndarray, n: int) -> np.ndarray:
    return (values % np.uint64(n)).astype(np.int64)


def _pack_rows(windows: Windows, pack_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            blobs = batch.column(1).to_pylist()
            if windows.words:
                blobs = [b" ".join(b.split()) + b"\n" for b in blobs]
            for a, b in packs(blobs, pack_bytes):
                row = [[ids[a:b]], [list(map(len, blobs[a:b]))], [_press(b"".join(blobs[a:b]))]]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(row, (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()), strict=True)], names=["ids", "lengths", "data"])

    return run


def _read(windows: Windows, ids, lengths, data) -> Pack:
    own = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
    return windows.pack(own, np.array(lengths, dtype=np.int64), _unpress(data, sum(lengths)))


@dataclass
class Entries:
    """The distinct anchors of a pack, and the runs that have them."""

    text: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    #: Entry of each run.
    of: np.ndarray
    anchors: np.ndarray
    flags: np.ndarray
    shards: np.ndarray


def _entries(windows: Windows, pack: Pack, n_shards: int) -> Entries:
    text, first, stop, own = windows.runs(pack)
    anchors, of, count = np.unique(own, return_inverse=True, return_counts=True)
    flags = _SEVERAL * (count > 1)
    if windows.same_text and len(first):
        # A gram that comes again within a window's length is a sign of a repeated window.
        order = np.lexsort((np.arange(len(pack.grams)), pack.grams))
        values = pack.grams[order]
        close = np.zeros(len(order) + 1, dtype=np.int64)
        near = (values[1:] == values[:-1]) & (np.diff(order) <= windows.window)
        close[1 + order[1:][near]] = 1
        sums = np.cumsum(close)
        some = sums[np.minimum(stop + windows.window - windows.gram, len(order))] > sums[first]
        some |= stop - first > windows.window - windows.gram + 1
        flagged = np.zeros(len(anchors), dtype=bool)
        flagged[of[some]] = True
        flags = flags + _SELF * flagged
    return Entries(text, first, stop, of, anchors, flags, _shards_of(anchors, n_shards))


def _by_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The shards that are there, and the places of each."""
    order = np.argsort(shards, kind="stable")
    present, at = np.unique(shards[order], return_index=True)
    yield from zip(present.tolist(), np.split(order, at[1:]), strict=True) if len(present) else ()


def _entry_rows(windows: Windows, n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pack_id, ids, lengths, data = (batch.column(c)[k].as_py() for c in range(4))
                e = _entries(windows, _read(windows, ids, lengths, data), n_shards)
                short = e.anchors // np.uint64(n_shards)
                rows = [(s, pack_id, _bytes(short[at], _ANCHOR), len(at), _press(e.flags[at].astype(np.uint8).tobytes())) for s, at in _by_shard(e.shards)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=t) for c, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))], names=["shard", "pack", "anchors", "n", "flags"])

    return run


def _answer_entries(hot: int):
    """(pack, shard, answers), a byte for each anchor of the pack in that shard."""

    def run(table: pa.Table) -> pa.Table:
        packs_, data, sizes, flags = (table[c].to_pylist() for c in ("pack", "anchors", "n", "flags"))
        anchor = _numbers(b"".join(data), _ANCHOR)
        flag = np.frombuffer(b"".join(_unpress(x, n) for x, n in zip(flags, sizes, strict=True)), np.uint8)
        _, of, count = np.unique(anchor, return_inverse=True, return_counts=True)
        several = np.zeros(len(count), dtype=bool)
        several[of[(flag & _SEVERAL) > 0]] = True
        asked = (count > 1)[of] | several[of] | ((flag & _SELF) > 0)
        answer = np.where(asked, np.where(count[of] > hot, SPLIT, SHIP), 0).astype(np.uint8)
        shard = table["shard"][0].as_py()
        cuts = np.cumsum([0, *sizes])
        out = [(p, shard, int(b - a), _press(answer[a:b].tobytes())) for p, a, b in zip(packs_, cuts, cuts[1:], strict=False) if answer[a:b].any()]
        return pa.table([pa.array([r[c] for r in out], type=t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["pack", "shard", "size", "answers"])

    return run


_SEGMENT = [("shard", "int", pa.int32()), ("pack", "long", pa.int64()), ("n", "long", pa.int64()), ("meta", "binary", pa.binary()), ("size", "long", pa.int64()), ("data", "binary", pa.binary()), ("gone", "binary", pa.binary())]
#: What travels with a segment, column by column, which presses better: its anchor, and these numbers.
_META = ("id", "text", "start", "size", "weight")
_META_KIND = {"id": "<i8"}
_REPLY = "pack long, gone binary"


def _segment_rows(windows: Windows, n_shards: int):
    """Segments that were asked for; ``gone`` carries copies of what speaks: (text, first symbol, past the last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pack_id, ids, lengths, data, answers = (batch.column(c)[k].as_py() for c in range(5))
                yield _segments(windows, n_shards, pack_id, _read(windows, ids, lengths, data), answers or [])

    return run


def _segments(windows: Windows, n_shards: int, pack_id: int, pack: Pack, answers: list[dict]) -> pa.RecordBatch:
    e = _entries(windows, pack, n_shards)
    answer = np.zeros(len(e.anchors), dtype=np.uint8)
    held = {a["shard"]: a for a in answers}
    for s, at in _by_shard(e.shards):
        if s in held:
            answer[at] = np.frombuffer(_unpress(held[s]["answers"], held[s]["size"]), np.uint8)
    own = answer[e.of]
    whole, split = np.flatnonzero(own == SHIP), np.flatnonzero(own == SPLIT)
    n = (e.stop - e.first)[split]
    single = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - e.first[split], n)
    text = e.text[np.concatenate([whole, np.repeat(split, n)])]
    first = np.concatenate([e.first[whole], single])
    last = np.concatenate([e.stop[whole], single + 1]) + windows.window - 1
    a, b = pack.byte_range(first, last)
    content = hashing.ranges(pack.sums, a, b)
    anchors = np.concatenate([e.anchors[e.of[whole]], content[len(whole) :]])
    speaks, weight = _folded(windows, pack, text, a, b, content)
    start = first - pack.edges[text]
    short = anchors // np.uint64(n_shards)
    meta = {"id": pack.ids[text], "text": text, "start": start, "size": b - a, "weight": weight}
    rows = []
    speaker = np.flatnonzero(speaks)
    for s, at in _by_shard(_shards_of(anchors[speaker], n_shards)):
        at = speaker[at]
        data = b"".join(pack.data[x:y] for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True))
        told = b"".join([_bytes(short[at], _ANCHOR), *(meta[f][at].astype(_META_KIND.get(f, "<i4")).tobytes() for f in _META)])
        rows.append((s, pack_id, len(at), _press(told), len(data), _press(data), b""))
    j = np.flatnonzero(~speaks)
    if len(j):
        flat = np.stack([text[j], start[j], start[j] + (last - first)[j]], axis=1).astype("<i4")
        rows.append((pack_id % n_shards, pack_id, 0, b"", 0, b"", flat.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=t) for c, (_, _, t) in enumerate(_SEGMENT)], names=[n for n, _, _ in _SEGMENT])


def _folded(windows: Windows, pack: Pack, text: np.ndarray, a: np.ndarray, b: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which segments of a pack speak for all equal ones, and for how many; the others go, being copies of what speaks.

    Where only smaller ids count, all segments with the least id speak.
    """
    speaks, weight = np.ones(len(text), dtype=bool), np.ones(len(text), dtype=np.int64)
    if not len(text):
        return speaks, weight
    order = np.lexsort((pack.ids[text], content))
    heads = np.flatnonzero(_starts(content[order]))
    head = order[heads[np.cumsum(_starts(content[order])) - 1]]
    data, x, y = pack.data, a.tolist(), b.tolist()
    for k, h in zip(order.tolist(), head.tolist(), strict=True):
        if k != h and data[x[k] : y[k]] == data[x[h] : y[h]] and (windows.same_text or pack.ids[text[k]] > pack.ids[text[h]]):
            speaks[k] = False
            weight[h] = 2
    return speaks, weight


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


@dataclass(slots=True)
class Segment:
    """One content in a shard: where it stands (row of the shard's table and place in it), and its bytes."""

    row: int
    text: int
    start: int
    id: int
    weight: int
    content: bytes


#: From the segments of one anchor or more (all with that anchor) to the windows that go: (segment, first, past the last window).
Decide = Callable[[list[list[Segment]]], list[tuple[Segment, int, int]]]


#: Bytes of one segment's anchor and numbers.
_META_BYTES = _ANCHOR + sum(np.dtype(_META_KIND.get(f, "<i4")).itemsize for f in _META)


def _told(data: bytes, n: int) -> Iterator[tuple]:
    """Anchor and numbers of ``n`` segments."""
    columns, at = [_numbers(data[: n * _ANCHOR], _ANCHOR).tolist()], n * _ANCHOR
    for f in _META:
        columns.append(np.frombuffer(data, _META_KIND.get(f, "<i4"), n, at).tolist())
        at += n * np.dtype(_META_KIND.get(f, "<i4")).itemsize
    return zip(*columns, strict=True)


def _answer_segments(windows: Windows, decide: Decide):
    def run(table: pa.Table) -> pa.Table:
        packs_ = table["pack"].to_pylist()
        gone: list[list[bytes]] = [[x] for x in table["gone"].to_pylist()]
        by: dict[int, list[Segment]] = {}
        columns = [table[c].to_pylist() for c in ("n", "meta", "size", "data")]
        for row, (n, meta, size, data) in enumerate(zip(*columns, strict=True)):
            at, data = 0, _unpress(data, size)
            for anchor, own, text, start, length, weight in _told(_unpress(meta, n * _META_BYTES), n):
                by.setdefault(anchor, []).append(Segment(row, text, start, own, weight, data[at : at + length]))
                at += length
        for segment, a, b in decide(list(by.values())):
            found = np.array([segment.text, segment.start + a, segment.start + b + windows.window - 1], dtype="<i4")
            gone[segment.row].append(found.tobytes())
        rows = [(p, b"".join(g)) for p, g in zip(packs_, gone, strict=True) if any(g)]
        return pa.table([pa.array([r[0] for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=pa.binary())], names=["pack", "gone"])

    return run


def removed(pack: Pack, blobs: list[bytes] | None) -> np.ndarray:
    """For every symbol of a pack, whether it goes."""
    step = np.zeros(int(pack.edges[-1]) + 1, dtype=np.int64)
    flat = np.frombuffer(b"".join(blobs or []), "<i4").reshape(-1, 3).astype(np.int64)
    np.add.at(step, pack.edges[flat[:, 0]] + flat[:, 1], 1)
    np.add.at(step, pack.edges[flat[:, 0]] + flat[:, 2], -1)
    return np.cumsum(step[:-1]) > 0


def apply_windows(docs: DataFrame, id_col: str, text_col: str, windows: Windows, decide: Decide, report: Callable[[Pack, np.ndarray], list[list]], out: list[tuple[str, str, pa.DataType]], hot_packs: int = HOT_PACKS, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Run the four steps; ``report`` makes the columns ``out`` (after the id) from a pack and its marked symbols."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    packed = rows.mapInArrow(_pack_rows(windows, pack_bytes), "ids array<long>, lengths array<int>, data binary")
    packed = stored(packed.withColumn("pack", F.monotonically_increasing_id()), "packs").select("pack", "ids", "lengths", "data")
    total = packed.agg(F.sum(F.length("data"))).first()[0] or 0
    n_shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * total // SHARD_BYTES)  # texts are pressed to half or less

    entries = packed.mapInArrow(_entry_rows(windows, n_shards), "shard int, pack long, anchors binary, n long, flags binary")
    answers = stored(entries.groupBy("shard").applyInArrow(_answer_entries(hot_packs), "pack long, shard int, size long, answers binary"), "answers")
    free_shuffles(spark)

    lists = answers.groupBy("pack").agg(F.collect_list(F.struct("shard", "size", "answers")).alias("answers"))
    segments = packed.join(lists, "pack", "left").select("pack", "ids", "lengths", "data", "answers").mapInArrow(_segment_rows(windows, n_shards), ", ".join(f"{n} {k}" for n, k, _ in _SEGMENT))
    replies = stored(segments.groupBy("shard").applyInArrow(_answer_segments(windows, decide), _REPLY), "replies")
    free_shuffles(spark)
    drop_stored(answers)

    gone = replies.groupBy("pack").agg(F.collect_list("gone").alias("gone"))
    schema = pa.schema([("id", pa.int64()), *((n, t) for n, _, t in out)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lengths, data, blobs = (batch.column(c)[k].as_py() for c in range(4))
                pack = _read(windows, ids, lengths, data) if windows.words else Pack(np.zeros(len(ids)), np.concatenate([[0], np.cumsum(lengths)]), None, _unpress(data, sum(lengths)))
                columns = report(pack, removed(pack, blobs))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip([ids, *columns], schema.types, strict=True)], schema=schema)

    made = packed.join(gone, "pack", "left").select("ids", "lengths", "data", "gone").mapInArrow(finish, "id long, " + ", ".join(f"{n} {k}" for n, k, _ in out))
    return made.withColumnRenamed("id", id_col)
