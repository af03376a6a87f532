"""Suffix-array dedup over bytes, by interval expansion on a Burrows-Wheeler transform.

The corpus is cut into shards so that all copies of a window meet (``superwindows``).
The distinct segments of a shard are concatenated and their suffixes sorted; from the
transform, breadth-first backward extension of intervals finds the common prefixes of
neighbouring suffixes by increasing value, and stops at the window's length: what has
no smaller common prefix by then is one group of equal windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import PACK_BYTES
from .superwindows import HOT_PACKS, Pack, Segment, Windows, apply_windows

WINDOW = 50
GRAM = 20
#: Bytes of segments whose suffixes are sorted at once.
SORT_BYTES = 1 << 17


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` symbols (symbols below 512, 0 ends a segment)."""
    n = len(symbols)
    key = np.zeros(n, dtype=np.int64)
    span = 7
    for j in range(span):
        key = key << 9
        key[: max(0, n - j)] |= symbols[j:]
    order = np.argsort(key)  # suffixes that agree to the depth may stand in any order
    while True:
        new = np.ones(n, dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        if span >= depth or new.all():
            return order
        key = rank * (n + 1)
        key[: max(0, n - span)] += rank[span:]
        order = np.argsort(key)
        span *= 2


def short_prefixes(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, where below ``depth``; ``depth`` elsewhere.

    Intervals [lo, hi) of suffixes that share ``value`` symbols are extended backward by
    each symbol that precedes them.  Where an extended interval ends at a place not yet
    known, the prefix common to its two sides is ``value`` long, and the interval joins
    the next round; each place is found once.
    """
    n = len(symbols)
    common = np.full(n + 1, -1, dtype=np.int32)
    common[n] = 0
    transform = symbols[order - 1]  # the symbol before each suffix; the text is read as a ring
    before = np.argsort(transform.astype(np.uint16), kind="stable")
    step = np.empty(n, dtype=np.int32)  # from a suffix to the one that is a symbol longer
    step[before] = np.arange(n, dtype=np.int32)
    firsts = symbols[order].astype(np.int16)
    owner = np.empty(n, dtype=np.int32)
    lo, hi = np.array([0], dtype=np.int32), np.array([n], dtype=np.int32)
    value = 0
    while len(lo) and value < depth:
        size = hi - lo
        ends = np.cumsum(size, dtype=np.int32)
        of = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        to = step[np.arange(ends[-1], dtype=np.int32) - (ends - size - lo)[of]]
        if 8 * len(to) > n:  # in order of place by marking them, else by sorting them
            owner.fill(-1)
            owner[to] = of
            to = np.flatnonzero(owner >= 0).astype(np.int32)
            of = owner[to]
        else:
            by = np.argsort(to)
            to, of = to[by], of[by]
        symbol = firsts[to]
        cut = np.ones(len(to), dtype=bool)
        cut[1:] = (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1]) | (to[1:] != to[:-1] + 1)
        first = np.flatnonzero(cut)
        lo = to[first]
        hi = to[np.append(first[1:], len(to)) - 1] + 1
        fresh = common[hi] < 0
        fresh[hi == n] = value == 0
        common[hi[fresh]] = value
        common[n] = 0
        lo, hi = lo[fresh], hi[fresh]
        value += 1
    common[0] = 0
    common[common < 0] = depth
    return common[:n]


def _earlier(distinct: list[tuple[bytes, list[Segment]]], window: int) -> list[tuple[Segment, int, int]]:
    """Windows of the segments that also stand in one with a smaller id, by groups of equal windows.

    ``distinct``: contents, and the segments that have them.
    """
    sizes = np.array([len(c) for c, _ in distinct])
    joined = b"\0".join(c for c, _ in distinct) + b"\0"
    symbols = np.frombuffer(joined, dtype=np.uint8).astype(np.int64) + 1
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols[starts + sizes] = 0
    order = suffix_order(symbols, window)
    group = np.cumsum(short_prefixes(symbols, order, window) < window) - 1
    owner = np.repeat(np.arange(len(distinct)), sizes + 1)[order]
    offset = order - starts[owner]
    whole = offset + window <= sizes[owner]
    group, owner, offset = group[whole], owner[whole], offset[whole]
    ids = np.array([min(s.id for s in own) for _, own in distinct], dtype=np.int64)
    least = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids[owner])
    # A segment whose id is above its content's least one is late in every group that its windows are in.
    out = [(s, 0, len(c) - window + 1) for (c, own), i in zip(distinct, ids.tolist(), strict=True) if len(own) > 1 for s in own if s.id > i]
    late = ids[owner] > least[group]
    owner, offset = owner[late], offset[late]
    by = np.lexsort((offset, owner))
    owner, offset = owner[by], offset[by]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    for o, a, b in zip(owner[first].tolist(), offset[first].tolist(), offset[last[: len(first)]].tolist(), strict=True):
        out += [(s, a, b + 1) for s in distinct[o][1] if s.id == ids[o]]
    return out


def decide(window: int):
    def run(anchors: list[list[Segment]]) -> list[tuple[Segment, int, int]]:
        out: list[tuple[Segment, int, int]] = []
        held: list[tuple[bytes, list[Segment]]] = []
        size = 0
        for segments in anchors:
            if all(s.id == segments[0].id for s in segments):
                continue
            by: dict[bytes, list[Segment]] = {}
            for s in segments:
                by.setdefault(s.content, []).append(s)
            held += by.items()
            size += sum(map(len, by))
            if size >= SORT_BYTES:
                out += _earlier(held, window)
                held, size = [], 0
        if held:
            out += _earlier(held, window)
        return out

    return run


def _report(pack: Pack, gone: np.ndarray) -> list[list]:
    buf = np.frombuffer(pack.data, dtype=np.uint8)
    total = np.concatenate([[0], np.cumsum(gone)])
    opened = gone.copy()
    opened[1:] &= ~gone[:-1]
    spans, kept = [], []
    for a, b in zip(pack.edges, pack.edges[1:], strict=False):
        own = gone[a:b]
        if total[b] > total[a]:
            spans.append(int(opened[a:b].sum()) + int(own[0] and not opened[a]))
            kept.append(hashlib.sha256(buf[a:b][~own].tobytes()).hexdigest())
        else:
            spans.append(0)
            kept.append(hashlib.sha256(pack.data[a:b]).hexdigest())
    return [np.diff(pack.edges), np.diff(total[pack.edges]), spans, kept]


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot_packs: int = HOT_PACKS, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per input row: bytes covered by a window that also starts in a row with a smaller id are removed.

    Null texts are empty.  Rows that repeat an id are not smaller than each other; a
    null id is larger than any other.  Other columns are not read; an empty table gives no rows.
    """
    windows = Windows(window=window, gram=min(GRAM, window), words=False, same_text=False)
    out = [("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept_sha256", "string", pa.string())]
    return apply_windows(docs, id_col, text_col, windows, decide(window), _report, out, hot_packs, pack_bytes)
