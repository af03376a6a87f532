"""Substring dedup over words: suffix automata of reference shards, matching statistics.

The corpus is cut into shards so that all copies of a window meet (``superwindows``).
The distinct segments of a reference shard form a generalised suffix automaton, whose
states count their occurrences; streaming the segments through it gives matching
statistics, and the states of the length threshold tell which windows occur again.  An
automaton holds at most about ``SHARD_WORDS`` words, never the corpus.  The reference is
the corpus itself here: its automata, broadcast one by one, would each have to be met by
every document, which is quadratic; so each shard is sent what can match it instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import SuffixAutomaton
from .runtime import PACK_BYTES
from .superwindows import HOT_PACKS, Pack, Segment, Windows, apply_windows

WINDOW = 35
GRAM = 8
#: Words of one automaton: some 50 MB in a Python worker.
SHARD_WORDS = 100_000


def _again(reference: dict[bytes, list[Segment]], window: int) -> list[tuple[Segment, int, int]]:
    """Windows that occur twice or more among the contents of a reference shard."""
    ids: dict[bytes, int] = {}
    number = ids.setdefault
    numbered = [[number(w, len(ids)) for w in c.split(b" ")] for c in reference]
    automaton = SuffixAutomaton()
    for sequence, own in zip(numbered, reference.values(), strict=True):
        automaton.add(sequence, min(2, sum(s.weight for s in own)))
    automaton.finish()
    count, of_length = automaton.count, automaton.of_length
    out = []
    for sequence, own in zip(numbered, reference.values(), strict=True):
        states, lengths = automaton.walk(sequence)
        mask = [n >= window and count[of_length(v, window)] > 1 for v, n in zip(states[window - 1 :], lengths[window - 1 :], strict=True)]
        at = 0
        while at < len(mask):
            if not mask[at]:
                at += 1
                continue
            start = at
            while at < len(mask) and mask[at]:
                at += 1
            out += [(s, start, at) for s in own]
    return out


def decide(window: int):
    def run(anchors: list[list[Segment]]) -> list[tuple[Segment, int, int]]:
        out: list[tuple[Segment, int, int]] = []
        held: dict[bytes, list[Segment]] = {}
        size = 0
        for segments in anchors:
            for s in segments:
                if s.content not in held:
                    held[s.content] = []
                    size += s.content.count(b" ") + 1
                held[s.content].append(s)
            if size >= SHARD_WORDS:
                out += _again(held, window)
                held, size = {}, 0
        if held:
            out += _again(held, window)
        return out

    return run


def _report(pack: Pack, gone: np.ndarray) -> list[list]:
    n = np.diff(pack.edges)
    lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[pack.edges])
    kept = []
    for k, (a, b) in enumerate(zip(pack.edges, pack.edges[1:], strict=False)):
        if lost[k]:
            text = b" ".join(pack.data[pack.starts[j] : pack.ends[j]] for j in np.flatnonzero(~gone[a:b]) + a)
        else:
            text = pack.content(a, b) if b > a else b""
        kept.append(hashlib.sha256(text).hexdigest())
    return [n, lost, kept]


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot_packs: int = HOT_PACKS, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per input row: words in windows that start anywhere else are removed.

    Null texts have no words; rows that repeat an id are documents of their own, as
    are rows with a null id; other columns are not read; an empty table gives no rows.
    """
    windows = Windows(window=window, gram=min(GRAM, window), words=True, same_text=True)
    out = [("n_words", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("kept_sha256", "string", pa.string())]
    return apply_windows(docs, id_col, text_col, windows, decide(window), _report, out, hot_packs, pack_bytes)
