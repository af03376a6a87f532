"""SentencePiece encoding and decoding by N-best search over the piece lattice.

Forward Viterbi gives the best score from the start to every place of a word; these
scores are exact heuristics for a backward A* search, which therefore leaves the
lattice's paths in order of score.  Edges into a place are looked up when the search
gets there, so that only the scores of a word are held.

No piece holds a space after another character, so a text's lattice falls apart into
words; its best segmentations are made of theirs.  Words are also cut between two
characters that stand together in no piece.  Segmentations of words are cached per
Python worker, in a cache of bounded size that holds no long words.

Scores: pieces of a unigram model carry log probabilities, used as they are.  Pieces
of a BPE model carry ranks; they become Zipf log probabilities, -ln(rank + 2).  The
lattice's best segmentation of a text is then another one than the model's own merges
make (they agree for hardly any text of more than a few words); it decodes to the same text.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import packs, text_bytes, tune

SPACE = "▁"
#: Words whose segmentations one worker keeps, and characters of the longest of them.
CACHE_WORDS, CACHE_CHARS = 250_000, 48
#: Stands for a text's own ``SPACE`` while it is encoded: no valid text holds it.
_LITERAL = "\udc81"
#: Extra cost of a character that no piece spells, per byte.
BYTE_COST = -20.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Pieces, scores and byte fallback of a model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        n = own.get_piece_size()
        self.path = path
        self.unknown = own.unk_id()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.spelt: list[bytes] = [b""] * n
        raw = {i: own.get_score(i) for i in range(n)}
        plain = [i for i in range(n) if not (own.is_control(i) or own.is_unknown(i) or own.is_unused(i) or own.is_byte(i))]
        ranks = bool(plain) and all(float(raw[i]).is_integer() for i in plain)
        for i in range(n):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelt[i] = bytes([int(piece[3:5], 16)])
        for i in plain:
            piece = own.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {i} holds a space after another character")
            self.ids[piece] = i
            self.scores[piece] = -math.log(min(-raw[i], n) + 2.0) if ranks else raw[i]
            self.spelt[i] = piece.replace(SPACE, " ").encode()
        #: Pieces by their characters: (children or None, (score, ids) or None) of every beginning.
        self.tree = self._tree()
        self.longest = max(map(len, self.ids), default=1)
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}

    # -- one word ---------------------------------------------------------------------------

    def _spelling(self, char: str) -> tuple[float, tuple[int, ...]]:
        """The edge of a character that is no piece: its bytes."""
        data = (SPACE if char == _LITERAL else char).encode("utf-8", "replace")
        return BYTE_COST * len(data), tuple(self.bytes[x] for x in data) if self.bytes else (self.unknown,)

    def _tree(self) -> dict[str, tuple[dict | None, tuple | None]]:
        held: dict[str, dict] = {}
        for piece, i in self.ids.items():
            at, node = held, None
            for c in piece:
                node = at.setdefault(c, {})
                at = node.setdefault("", {})
            node["edge"] = self.scores[piece], (i,)

        def closed(level: dict) -> dict[str, tuple[dict | None, tuple | None]]:
            return {c: (closed(n[""]) if n[""] else None, n.get("edge")) for c, n in level.items()}

        return closed(held)

    def forward(self, word: str, held: bool) -> tuple[list[float], list[list[tuple]] | None]:
        """Viterbi: the best score up to every place and, if ``held``, all edges into it as (score up to it by this edge, start, ids)."""
        n, root, floor = len(word), self.tree, -math.inf
        best = [0.0] + [floor] * n
        into: list[list[tuple]] | None = [[] for _ in range(n + 1)] if held else None
        for a in range(n):
            base = best[a]
            node = root.get(word[a])
            if node is None or node[1] is None:
                edge = self._spelling(word[a])
                value = base + edge[0]
                if value > best[a + 1]:
                    best[a + 1] = value
                if held:
                    into[a + 1].append((value, a, edge[1]))
            b = a
            while node is not None:
                b += 1
                level, edge = node
                if edge is not None:
                    value = base + edge[0]
                    if value > best[b]:
                        best[b] = value
                    if held:
                        into[b].append((value, a, edge[1]))
                if b == n or level is None:
                    break
                node = level.get(word[b])
        return best, into

    def edge(self, word: str, a: int, b: int) -> tuple[float, tuple[int, ...]] | None:
        """Score and ids of the edge between two places, if there is one."""
        i = self.ids.get(word[a:b])
        if i is not None:
            return self.scores[word[a:b]], (i,)
        return self._spelling(word[a]) if b == a + 1 else None

    def _into(self, word: str, place: int, best: list[float]) -> list[tuple]:
        """The edges into a place of a long word, of which no edges are held."""
        return [(best[a] + e[0], a, e[1]) for a in range(max(0, place - self.longest), place) if (e := self.edge(word, a, place)) is not None]

    def nbest_word(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations with their scores, best first.

        A* from the end: every step takes the path from the queue that loses least
        against the best segmentation and puts it back with each edge into its place in
        front.  The Viterbi scores are exact heuristics, so what a path loses is what its
        best completion loses, and one that leaves the queue at the start of the word is
        the next best.  Among equal losses the one nearest the start goes first.  An edge
        that begins another completion than the path's best is queued only if fewer than
        ``n`` - 1 of those so far lose as little: no more can still be asked for.
        """
        best, into = self.forward(word, len(word) <= CACHE_CHARS)
        push, pop = heapq.heappush, heapq.heappop
        found: list[tuple[float, list[int]]] = []
        heap: list[tuple[float, int, int, tuple | None]] = [(0.0, len(word), 0, None)]
        count, bound = 0, math.inf if n > 1 else -math.inf
        known: list[float] = []  # the smallest losses of other completions so far, largest first
        while heap and len(found) < n:
            lost, place, _, path = pop(heap)
            if not place:
                out: list[int] = []
                while path is not None:
                    ids, path = path
                    out.extend(ids)
                found.append((best[-1] - lost, out))
                continue
            top, other = best[place], False
            for value, a, ids in into[place] if into is not None else self._into(word, place, best):
                loss = lost + (top - value)
                if value == top and not other:
                    other = True  # the path's own best completion; equal ones after it are others
                elif loss < bound:
                    push(known, -loss)
                    if len(known) == n:
                        pop(known)
                    if len(known) == n - 1:
                        bound = -known[0]
                else:
                    continue
                count += 1
                push(heap, (loss, a, count, (ids, path)))
        return found

    def parts(self, word: str) -> list[str]:
        """A word cut where no piece can lie over the cut."""
        cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


_PACKED = [struct.Struct(f"<{k}i") for k in range(24)]


class _Cache(dict):
    """Solved words; a word not yet there is taken from the last generation or solved.  Long words are not kept."""

    def __init__(self, old: dict, solve) -> None:
        self.old, self.solve = old, solve

    def __missing__(self, word: str) -> tuple[bytes, float, float]:
        got = self.old.get(word) or self.solve(word)
        if len(word) <= CACHE_CHARS:
            self[word] = got
        return got


class Encoder:
    """Encodes and decodes whole texts; caches what its words become."""

    def __init__(self, path: str, n: int = 2, cache_words: int = CACHE_WORDS) -> None:
        self.path, self.n, self.cache_words = path, max(2, n), cache_words
        self.model: PieceModel | None = None
        self.cache = _Cache({}, self._solve)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "model": None, "cache": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.cache = _Cache({}, self._solve)

    def _model(self) -> PieceModel:
        if self.model is None:
            self.model = PieceModel(self.path)
        return self.model

    def _solve(self, word: str) -> tuple[bytes, float, float]:
        """Packed ids and score of the best segmentation, and how much the second is worse."""
        model = self._model()
        if len(word) <= CACHE_CHARS:
            for k in range(len(word) - 1, max(len(word) - 5, 0), -1):  # marks at a word's end, between which and it no piece lies
                if word[k - 1 : k + 1] not in model.pairs:
                    (ids, score, gap), (more, rest, other) = self.cache[word[:k]], self.cache[word[k:]]
                    return ids + more, score + rest, min(gap, other)
            ways = model.nbest_word(word, 2)
            own = ways[0][1]
            return _PACKED[len(own)].pack(*own) if len(own) < len(_PACKED) else struct.pack(f"<{len(own)}i", *own), ways[0][0], ways[0][0] - ways[1][0] if len(ways) > 1 else math.inf
        ids, total, gap = [], 0.0, math.inf
        for part in model.parts(word):
            ways = model.nbest_word(part, 2)
            ids.append(struct.pack(f"<{len(ways[0][1])}i", *ways[0][1]))
            total += ways[0][0]
            if len(ways) > 1:
                gap = min(gap, ways[0][0] - ways[1][0])
        return b"".join(ids), total, gap

    @staticmethod
    def words(text: str) -> list[str]:
        """Words of the lattice: each begins with the spaces before it; a space is put before a text that is not empty."""
        if not text:
            return []
        spaced = SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)
        return re.findall(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+", spaced)

    def encode_pack(self, texts: list[str]) -> list[tuple[bytes, float, float]]:
        """For each text the ids as little-endian 32-bit numbers, the score, and the gap to the second best (infinite if none)."""
        if len(self.cache) >= self.cache_words:  # the half used longest ago makes room
            self.cache.old = {}
            self.cache = _Cache(self.cache, self._solve)
        find, out = self.cache.__getitem__, []
        for text in texts:
            if text:
                got = list(map(find, self.words(text)))
                out.append((b"".join([g[0] for g in got]), sum([g[1] for g in got]), min([g[2] for g in got])))
            else:
                out.append((b"", 0.0, math.inf))
        return out

    def encode(self, text: str) -> tuple[bytes, float, float]:
        return self.encode_pack([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids: pieces spelt out, bytes joined, the space at the front dropped."""
        data = b"".join(map(self._model().spelt.__getitem__, ids))
        return (data[1:] if data.startswith(b" ") else data).decode("utf-8", "replace")

    def decode_pack(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts of many sequences at once, in UTF-8: their pieces laid end to end and cut where the sequences end."""
        spelt = pa.array(self._model().spelt, type=pa.large_binary()).take(pa.array(ids))
        _, ends, data = spelt.buffers()
        data = data.to_pybytes() if data else b""
        at = np.frombuffer(ends, dtype=np.int64)[offsets].tolist()
        return [data[a + 1 : b] if data[a : a + 1] == b" " and b > a else data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def nbest(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a whole text, best first.

        Words are taken in turn and the ``n`` best of their combinations are kept; a
        combination outside them cannot become one of the ``n`` best later on.
        """
        model = self._model()
        held: list[tuple[float, tuple | None]] = [(0.0, None)]
        for word in self.words(text):
            for part in model.parts(word):
                ways = model.nbest_word(part, n)
                held = heapq.nlargest(n, ((s + t, (ids, path)) for s, path in held for t, ids in ways), key=lambda x: x[0])
        out = []
        for score, path in held:
            back = []
            while path is not None:
                ids, path = path
                back.append(ids)
            out.append((score, [i for ids in reversed(back) for i in ids]))
        return out


@lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """The encoder of a Python worker: model and cache outlive its tasks."""
    return Encoder(path)


_SENT: set[tuple[str, str]] = set()


def _shipped(spark: SparkSession, model: str | None):
    """Send the model file to the executors; gives a function that finds it there."""
    path = model or default_model()
    if (spark.sparkContext.applicationId, path) not in _SENT:
        spark.sparkContext.addFile(path)
        _SENT.add((spark.sparkContext.applicationId, path))
    name = Path(path).name
    return lambda: SparkFiles.get(name)


_FIELDS = [("n_pieces", "long", pa.int64()), ("ids", "array<int>", pa.list_(pa.int32())), ("score", "double", pa.float64()), ("second_score", "double", pa.float64()), ("round_trip", "boolean", pa.bool_()), ("ids_sha256", "string", pa.string())]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = True) -> DataFrame:
    """Best segmentation of every whole text, the second best's score, and a decoding check; a narrow pass.

    All segmentations come from the A* search of their words, cached or not.  A null text
    is empty: no pieces, score 0, no second segmentation (null), round
    trip true.  Null ids stay null, repeated rows give repeated rows, other columns
    are not read, an empty table gives no rows.  ``ids_sha256`` is over the ids as
    little-endian 32-bit numbers.
    """
    tune(docs.sparkSession)
    find = _shipped(docs.sparkSession, model)
    fields = [f for f in _FIELDS if with_ids or f[0] != "ids"]
    schema = pa.schema([("id", pa.int64()), *((n, t) for n, _, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(find())
        gc.disable()  # very many small objects and no cycles among them
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            for a, b in packs(blobs):
                texts = [x.decode("utf-8", "replace") for x in blobs[a:b]]
                made = encoder.encode_pack(texts)
                arrays = [np.frombuffer(m[0], dtype="<i4") for m in made]
                offsets = np.cumsum([0, *map(len, arrays)])
                flat = np.concatenate(arrays)
                back = encoder.decode_pack(flat, offsets)
                columns = {
                    "n_pieces": pa.array(np.diff(offsets), type=pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat)),
                    "score": pa.array([m[1] for m in made]),
                    "second_score": pa.array([m[1] - m[2] if math.isfinite(m[2]) else None for m in made], type=pa.float64()),
                    "round_trip": pa.array([x.decode("utf-8", "replace") == t for x, t in zip(back, texts, strict=True)]),
                    "ids_sha256": pa.array([hashlib.sha256(m[0]).hexdigest() for m in made]),
                }
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(columns[n] for n, _, _ in fields)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{n} {k}" for n, k, _ in fields)).withColumnRenamed("id", id_col)


def segmentations(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """The ``n`` best segmentations of every whole text, or all if there are fewer: (id, rank from 1, score, ids).

    A null or empty text has one, without pieces.  Null ids stay null, repeated rows
    give repeated rows, other columns are not read, an empty table gives no rows.  Held
    at once: ``n`` paths of one text.
    """
    tune(docs.sparkSession)
    find = _shipped(docs.sparkSession, model)
    schema = pa.schema([("id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(find())
        for batch in batches:
            for own, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ways = encoder.nbest(blob.decode("utf-8", "replace"), n)
                rows = [[own] * len(ways), range(1, len(ways) + 1), [w[0] for w in ways], [w[1] for w in ways]]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(rows, schema.types, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, rank int, score double, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """Texts of sequences of ids: (id, text). A null sequence is a null text; ids outside the model are skipped."""
    tune(tokens.sparkSession)
    find = _shipped(tokens.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(find())
        for batch in batches:
            n = len(encoder._model().spelt)
            texts = [None if x is None else encoder.decode([i for i in x if i is not None and 0 <= i < n]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
