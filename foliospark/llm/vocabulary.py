"""Case-folded words of a pack of texts as vocabulary numbers."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np

from .hashing import FOLD_WORDS

#: A byte that no UTF-8 text holds and that counts as a word: it marks where a text ends.
_EDGE = b"\xff"


def folded_words(blob: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return blob.translate(FOLD_WORDS).split()


class Vocabulary:
    """Numbers 2.. for the words of some sequences; 0 is any other word, 1 the end of a text."""

    def __init__(self, sequences: Iterable[Iterable[bytes]]) -> None:
        self.ids: dict[bytes, int] = {_EDGE: 1}
        for sequence in sequences:
            for word in sequence:
                self.ids.setdefault(word, len(self.ids) + 1)

    def __len__(self) -> int:
        return len(self.ids) + 1

    def number(self, sequence: Iterable[bytes]) -> list[int]:
        return [self.ids[w] for w in sequence]

    def pack(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts, each text closed by a 1, and where the texts begin (one more at the end)."""
        words = b" \xff ".join([*blobs, b""]).translate(FOLD_WORDS).split()
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int32, count=len(words))
        return ids, np.concatenate([[0], np.flatnonzero(ids == 1) + 1])


def runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of true values of ``least`` or more, as (start, end)."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))
