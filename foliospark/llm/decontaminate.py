"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items, lower-cased and cut into words, form one automaton that is broadcast.
Training texts stream through it; the longest match ending at each word gives every
occurrence of a window (``window`` consecutive item words, or a shorter item whole)
and the items that hold it.  Words that no item has lead back to the root, so only
runs of item words long enough for a window are walked word by word.

Item sets larger than ``SHARD_WORDS`` become several automata of at most that many
words (a longer item is one alone).  A row carries what it has been found to hold from
automaton to automaton, so that every one of them reads the unchanged text and nothing
is judged before the last; after ``LIVE`` automata the rows are stored and these
automata dropped, so what is live at once never grows with the items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .automaton import SuffixAutomaton
from .hashing import FOLD_WORDS, word_bounds
from .runtime import packs, stored, text_bytes, tune, unused
from .vocabulary import Vocabulary, folded_words, runs

WINDOW = 10
#: Words of items in one automaton: some 100 MB in a Python worker.
SHARD_WORDS = 200_000
#: Automata that are broadcast at the same time.
LIVE = 4
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass
class Index:
    """Automaton of some items, and which items hold the windows of its states."""

    vocabulary: Vocabulary
    automaton: SuffixAutomaton
    names: list[str]
    owners: dict[int, list[int]]
    short: dict[int, list[tuple[int, int]]]
    window: int
    least: int

    @classmethod
    def build(cls, items: list[tuple[str, list[bytes]]], window: int) -> Index:
        vocabulary = Vocabulary(words for _, words in items)
        sequences = [vocabulary.number(words) for _, words in items]
        automaton = SuffixAutomaton()
        short: dict[int, list[tuple[int, int]]] = {}
        for sequence in sequences:
            automaton.add(sequence)
        for k, sequence in enumerate(sequences):
            if len(sequence) < window:
                end = 0
                for symbol in sequence:
                    end = automaton.next[end][symbol]
                short.setdefault(end, []).append((len(sequence), k))
        owners = automaton.owners(sequences, window)
        least = min([window, *(len(s) for s in sequences)])
        return cls(vocabulary, automaton, [name for name, _ in items], owners, short, window, least)

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """Occurrences in a pack of words: (first word, past the last, items)."""
        found = []
        for start, end in runs(ids > 1, self.least):
            states, lengths = self.automaton.walk(ids[start:end].tolist())
            for at, (v, n) in enumerate(zip(states, lengths, strict=True), start + 1):
                if n >= self.window:
                    found.append((at - n, at, self.owners[self.automaton.of_length(v, self.window)]))
                if self.short:
                    while v > 0:
                        for size, k in self.short.get(v, ()):
                            if size <= n:
                                found.append((at - size, at, [k]))
                        v = self.automaton.link[v]
        return found


def shards(items: DataFrame, id_col: str, text_col: str, window: int, shard_words: int = SHARD_WORDS):
    """Indexes over all items that have words, each of a bounded number of words.

    Items come to the driver one partition at a time.  A null item id is the
    string ``null``; the text of a null item is empty.
    """
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("n"), text_bytes(text_col).alias("t"))
    for row in rows.distinct().toLocalIterator():
        words = folded_words(bytes(row["t"]))
        if held and size + len(words) > shard_words:
            yield Index.build(held, window)
            held, size = [], 0
        if words:
            held.append((row["n"], words))
            size += len(words)
    if held:
        yield Index.build(held, window)


def _spans(index: Index, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, list[int]]]]:
    found = index.hits(ids)
    step = np.zeros(len(ids) + 1, dtype=np.int64)
    for start, end, _ in found:
        step[start] += 1
        step[end] -= 1
    return np.cumsum(step[:-1]) > 0, found


#: What a text has been found to hold: hit spans as (start, end, start, ..) in words, and items.
_FOUND = pa.struct([("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
Hits = dict[int, tuple[list[tuple[int, int]], list[str]]]


def _united(index: Index | None, blobs: list[bytes], before: list[dict | None]) -> tuple[np.ndarray, Hits]:
    """Number of words of each text, and for those with hits their spans and items, earlier ones among them."""
    ids, edges = (index.vocabulary if index else Vocabulary([])).pack(blobs)
    hit, found = _spans(index, ids) if index else (np.zeros(len(ids), dtype=bool), [])
    names: dict[int, set[str]] = {}
    for start, _, own in found:
        names.setdefault(int(np.searchsorted(edges, start, "right")) - 1, set()).update(index.names[k] for k in own)
    for d, held in enumerate(before):
        if held and held["items"]:
            names.setdefault(d, set()).update(held["items"])
            for a, b in zip(held["spans"][::2], held["spans"][1::2], strict=True):
                hit[edges[d] + a : edges[d] + b] = True
    return np.diff(edges) - 1, {d: (runs(hit[edges[d] : edges[d + 1] - 1], 1), sorted(own)) for d, own in names.items()}


def _through(docs: DataFrame, text_col: str, indexes: Iterator[Index], finish: Callable, schema: StructType | str) -> DataFrame:
    """Send rows through all automata; ``finish`` makes the result from a batch, its texts, their numbers of words, and hits."""
    spark = docs.sparkSession
    names = docs.columns
    at = names.index(text_col)
    held = unused(names, "found")
    between = StructType([*docs.schema.fields, StructField(held, StructType([StructField("spans", ArrayType(IntegerType())), StructField("items", ArrayType(StringType()))]))])
    live: list = []
    ahead = next(indexes, None)
    first = True
    while True:
        shared = spark.sparkContext.broadcast(ahead)
        ahead = next(indexes, None)
        last = ahead is None

        def run(batches, shared=shared, first=first, last=last):
            for batch in batches:
                blobs = [b or b"" for b in batch.column(at).cast(pa.binary()).to_pylist()]
                before = [None] * len(blobs) if first else batch.column(len(names)).to_pylist()
                n_words, hits = np.zeros(len(blobs), dtype=np.int64), {}
                for a, b in packs(blobs):
                    n_words[a:b], own = _united(shared.value, blobs[a:b], before[a:b])
                    hits.update((a + d, hit) for d, hit in own.items())
                batch = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names)
                if last:
                    yield finish(batch, blobs, n_words, hits)
                else:
                    found = [{"spans": [x for span in hits[d][0] for x in span], "items": hits[d][1]} if d in hits else None for d in range(len(blobs))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, type=_FOUND)], names=[*names, held])

        docs = docs.mapInArrow(run, schema if last else between)
        live.append(shared)
        first = False
        if last:
            return docs
        if len(live) == LIVE:
            docs = stored(docs, "decontamination")
            for done in live:
                done.destroy()
            live = []


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Hit words and occurring items, one row per row of ``docs``; a narrow pass for up to ``LIVE`` automata.

    Null texts have no words; null ids stay null; repeated rows give repeated rows;
    repeated items count once per item id; no items, or empty tables, give no hits.
    Other columns are not read.  A very long text is a pack of its own: some 30 bytes a word.
    Columns: id, n_words, n_hit, n_items, items_sha256, contaminated.
    """
    spark = docs.sparkSession
    tune(spark)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_bytes(docs[text_col]).alias("text"))

    def finish(batch: pa.RecordBatch, blobs: list[bytes], n_words: np.ndarray, hits: Hits) -> pa.RecordBatch:
        n = len(blobs)
        n_hit, n_items, digests = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), [_EMPTY_SHA] * n
        for d, (spans, items) in hits.items():
            n_hit[d], n_items[d] = sum(b - a for a, b in spans), len(items)
            digests[d] = hashlib.sha256(",".join(items).encode()).hexdigest()
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, type=t) for x, t in zip((n_words, n_hit, n_items, digests, n_hit > 0), schema.types[1:], strict=True))], schema=schema)

    made = _through(rows, "text", shards(items, item_id, item_text, window, shard_words), finish, "id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return made.withColumnRenamed("id", id_col)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_cover: float = 0.5,
    max_span: int = 200,
    count_col: str | None = "n_chars",
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The rows of ``docs`` with every hit span cut out of the text, all columns kept.

    A text with more than ``max_cover`` of its words hit, or a hit span of more than
    ``max_span`` words, is dropped whole.  ``count_col``, where present, gets the new
    length.  Texts without hits are unchanged, nulls included; repeated rows fare alike;
    no items change nothing; column names are free.
    """
    tune(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    count_at = names.index(count_col) if count_col in names else None

    def finish(batch: pa.RecordBatch, blobs: list[bytes], n_words: np.ndarray, hits: Hits) -> pa.RecordBatch:
        if not hits:
            return batch
        new = {d: _cut(blobs[d], int(n_words[d]), spans, max_cover, max_span) for d, (spans, _) in hits.items()}
        keep = np.ones(len(blobs), dtype=bool)
        texts = batch.column(at).to_pylist()
        for d, text in new.items():
            keep[d] = text is not None
            texts[d] = text or ""
        batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))
        if count_at is not None:
            counts = batch.column(count_at).to_pylist()
            for d, text in new.items():
                counts[d] = len(text or "")
            batch = batch.set_column(count_at, batch.schema.field(count_at), pa.array(counts, type=batch.schema.field(count_at).type))
        return batch.filter(pa.array(keep))

    return _through(docs, text_col, shards(items, item_id, item_text, window, shard_words), finish, docs.schema)


def _cut(blob: bytes, n_words: int, spans: list[tuple[int, int]], max_cover: float, max_span: int) -> str | None:
    """The text without its hit spans, or None to drop it."""
    if sum(b - a for a, b in spans) > max_cover * n_words or max(b - a for a, b in spans) > max_span:
        return None
    starts, ends = word_bounds(np.frombuffer(blob.translate(FOLD_WORDS), dtype=np.uint8))
    out, last = [], 0
    for a, b in spans:
        out.append(blob[last : starts[a]])
        last = int(ends[b - 1])
    return b"".join([*out, blob[last:]]).decode("utf-8", "replace")
