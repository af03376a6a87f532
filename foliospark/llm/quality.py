"""Quality rules: repetition measured on a suffix array of each text's words.

The words of a pack of texts are sorted as suffixes in one go (prefix doubling,
with a text's own number mixed into its words, so no match leaves a text).  The
longest-common-prefix intervals then give the longest repeat at every word; their
union is the repeated part of a text.

Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .runtime import by_pack, packs, text_bytes, tune

SYMBOLS = b"#*$%&|<>"
#: Bytes that are no character of a word: white space, and all bytes of a character but its first.
_NOT_WORD_CHARS = bytes([0x20, *range(9, 14), *range(0x80, 0xC0)])


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. A text fails when it breaks any of them."""

    min_words: int = 50
    #: Percent of words in ``window``-word windows that occur twice or more.
    max_repeat_percent: int = 50
    window: int = 3
    #: Repeats of this many words or more count as repeated passages ...
    passage_words: int = 8
    #: ... which may cover this part of the text ...
    max_passage_cover: float = 0.3
    #: ... and the longest may be this part of the text, and this many words.
    max_longest_share: float = 0.25
    long_repeat_words: int = 40
    #: Symbols per word.
    max_symbols_per_word: float = 0.4
    #: Mean characters of a word.
    mean_word_chars: tuple[float, float] = (2.0, 14.0)


def longest_repeats(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every word, how many words from it on occur elsewhere in the same text.

    ``words``: hashes; ``doc``: the text of each word, ascending; ``ends``: for each
    word, the position after the last word of its text.
    """
    n = len(words)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    symbols = hashing.mix(words + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(symbols, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = symbols[order][1:] != symbols[order][:-1]
    group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    levels, span = [rank.copy()], 1
    shared = ~(fresh & np.append(fresh[1:], True))
    active = order[shared]  # grouped by rank, as far as it is known
    while len(active):
        following = np.minimum(active + span, n - 1)
        second = np.where(active + span < ends[active], rank[following] + 1, 0)
        first = rank[active]
        by = np.lexsort((second, first))
        active, first, second = active[by], first[by], second[by]
        new = np.ones(len(active), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(new)
        bucket = np.ones(len(active), dtype=bool)
        bucket[1:] = first[1:] != first[:-1]
        start = np.flatnonzero(bucket)[np.cumsum(bucket) - 1]
        rank[active] = first + at[np.cumsum(new) - 1] - start
        span *= 2
        levels.append(rank.copy())
        active = active[~(new & np.append(new[1:], True))]
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    some = levels[0][a] == levels[0][b]
    a, b = a[some], b[some]
    common = np.zeros(len(a), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        fits = (x + (1 << level) <= ends[a]) & (y + (1 << level) <= ends[b])
        same = fits & (levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)])
        common += same.astype(np.int64) << level
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(repeats: np.ndarray, least: int, doc: np.ndarray, n_docs: int, cut: bool = False) -> np.ndarray:
    """Words of each text inside a repeat of ``least`` words or more; ``cut``: the first ``least`` words of it."""
    starts = np.flatnonzero(repeats >= least)
    step = np.zeros(len(repeats) + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + (least if cut else repeats[starts]), -1)
    return np.bincount(doc[np.cumsum(step[:-1]) > 0], minlength=n_docs)


def measure(blobs: list[bytes], rules: QualityRules = QualityRules()) -> dict[str, np.ndarray]:
    """All figures and both verdicts for a pack of texts."""
    joined = b"\n".join(blobs)
    buf = np.frombuffer(joined, dtype=np.uint8)
    edges = np.cumsum([0] + [len(b) + 1 for b in blobs])
    starts, stops = hashing.word_bounds(buf)
    words = hashing.word_hashes(buf, starts, stops)
    first = np.searchsorted(starts, edges)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(blobs)), n_words)
    repeats = longest_repeats(words, doc, first[1:][doc])
    repeat_words = covered(repeats, rules.window, doc, len(blobs), cut=True)
    passage_words = covered(repeats, rules.passage_words, doc, len(blobs))
    longest = np.zeros(len(blobs), dtype=np.int64)
    np.maximum.at(longest, doc, repeats)
    chars = np.array([len(b.translate(None, _NOT_WORD_CHARS)) for b in blobs], dtype=np.int64)
    symbols = np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in blobs], dtype=np.int64)
    lines = [[x for x in b.split(b"\n") if x and not x.isspace()] for b in blobs]
    dup_lines = np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64)
    base_failed = (n_words < rules.min_words) | (100 * repeat_words > rules.max_repeat_percent * n_words)
    some = np.maximum(n_words, 1)
    mean = chars / some
    fine = (
        (passage_words <= rules.max_passage_cover * n_words)
        & ((longest < rules.long_repeat_words) | (longest <= rules.max_longest_share * n_words))
        & (symbols <= rules.max_symbols_per_word * n_words)
        & (mean >= rules.mean_word_chars[0])
        & (mean <= rules.mean_word_chars[1])
    )
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": base_failed,
        "kept": ~base_failed & fine,
        "passage_words": passage_words,
        "longest_repeat": longest,
    }


_FIGURES = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
    ("passage_words", pa.int64()),
    ("longest_repeat", pa.int64()),
]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row of figures and verdicts per input row; a narrow pass without a shuffle.

    A null text is empty and fails; a null id stays null; repeated rows give
    repeated rows; other columns are not read, whatever their names; an empty
    table gives an empty result.
    """
    tune(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), *_FIGURES])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    made = rows.mapInArrow(
        by_pack(lambda blobs: measure(blobs, rules), schema),
        "id long, " + ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'long'}" for n, t in _FIGURES),
    )
    return made.withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass the rules."""
    tune(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            text = batch.column(at).cast(pa.binary()).to_pylist()
            blobs = [b or b"" for b in text]
            keep = np.zeros(len(blobs), dtype=bool)
            for start, stop in packs(blobs):
                keep[start:stop] = measure(blobs[start:stop], rules)["kept"]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
