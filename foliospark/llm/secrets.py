"""Secret scan through a trigram inverted index.

Each rule's regex is parsed into a Boolean query over trigrams that any match must
hold (case folded).  A pack of texts gets posting lists, restricted to the trigrams
that some query names, so the index stays small whatever the texts; intersecting and
uniting postings gives the candidates of a rule, and only these meet its regex.  A
rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import FOLD_CASE
from .runtime import by_pack, text_bytes, tune

try:  # the parser behind re.compile moved between Python versions
    from re import _parser as sre_parse
except ImportError:
    import sre_parse  # type: ignore[no-redef]


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters or more; failing matches are dropped, not retried."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    compiled: re.Pattern = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self) -> None:
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII))


# The base rules, in their order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # the same spans as [0-9a-f]+ of 24 characters or more
)

#: Rules of published credential formats; they add spans to the base ones.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google_api", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
RULES = BASE_RULES + MORE_RULES

#: A query is ("all",), ("tri", code), ("and", queries) or ("or", queries); "all" has no mandatory trigram.
ALL = ("all",)
#: Alternatives of a sub-pattern are spelt out as exact strings up to this many.
_MAX_EXACT = 32


def _both(parts: list[tuple]) -> tuple:
    parts = [p for p in parts if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(parts: list[tuple]) -> tuple:
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _spelt(text: bytes) -> tuple:
    return _both([("tri", text[i] << 16 | text[i + 1] << 8 | text[i + 2]) for i in range(len(text) - 2)])


def _exact(strings: set[bytes]) -> tuple:
    return _either([_spelt(s) for s in sorted(strings)])


def _strings(node) -> set[bytes] | None:
    """All case-folded strings that a parsed pattern can match, or None if unknown or many."""
    out = {b""}
    for op, value in node:
        name = str(op)
        if name == "LITERAL" and value < 128:
            more = {bytes([value]).translate(FOLD_CASE)}
        elif name == "IN" and len(value) <= _MAX_EXACT and all(str(o) == "LITERAL" and v < 128 for o, v in value):
            more = {bytes([v]).translate(FOLD_CASE) for _, v in value}
        elif name == "SUBPATTERN":
            more = _strings(value[3])
        elif name == "BRANCH":
            each = [_strings(x) for x in value[1]]
            more = None if None in each else set().union(*each)
        elif name == "MAX_REPEAT" and value[1] == 1:
            more = _strings(value[2])
            more = more and more | ({b""} if value[0] == 0 else set())
        else:
            more = None
        if more is None or len(out) * len(more) > _MAX_EXACT:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(node) -> tuple:
    """Trigrams that every match of a parsed pattern holds."""
    parts: list[tuple] = []
    exact: set[bytes] = {b""}  # what the run of spelt-out nodes so far can match
    for item in node:
        own = _strings([item])
        if own is not None and len(exact) * len(own) <= _MAX_EXACT:
            exact = {a + b for a in exact for b in own}
            continue
        parts.append(_exact(exact))
        exact = {b""} if own is None else own
        if own is None:
            op, value = str(item[0]), item[1]
            if op == "SUBPATTERN":
                parts.append(_query(value[3]))
            elif op == "BRANCH":
                parts.append(_either([_query(x) for x in value[1]]))
            elif op == "MAX_REPEAT" and value[0] > 0:
                parts.append(_query(value[2]))
    return _both([*parts, _exact(exact)])


def trigram_query(pattern: str) -> tuple:
    """The Boolean trigram query of a regex."""
    return _query(sre_parse.parse(pattern, re.ASCII))


def _codes(query: tuple) -> set[int]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(_codes(q) for q in query[1])) if len(query) > 1 else set()


class TrigramIndex:
    """Posting lists of the texts of a pack, for the trigrams that some query names."""

    def __init__(self, blobs: list[bytes], wanted: np.ndarray, slots: np.ndarray) -> None:
        self.n = len(blobs)
        joined = b"\n\n\n".join(blobs).translate(FOLD_CASE)
        buf = np.frombuffer(joined, dtype=np.uint8)
        edges = np.cumsum([0] + [len(b) + 3 for b in blobs])
        openings = np.zeros(1 << 16, dtype=bool)  # small enough for the CPU's cache: most texts end here
        openings[wanted >> 8] = True
        near = np.flatnonzero(openings[buf[:-2].astype(np.uint16) << 8 | buf[1:-1]]) if len(buf) > 2 else np.zeros(0, dtype=np.int64)
        slot = slots[buf[near].astype(np.int64) << 16 | buf[near + 1].astype(np.int64) << 8 | buf[near + 2]]
        at, slot = near[slot > 0], slot[slot > 0]
        doc = np.searchsorted(edges, at, "right") - 1
        pairs = np.unique(slot.astype(np.int64) * (self.n + 1) + doc)
        which = pairs // (self.n + 1)
        cut = np.searchsorted(which, np.arange(1, len(wanted) + 2))
        self.postings = {int(c): pairs[cut[k] : cut[k + 1]] % (self.n + 1) for k, c in enumerate(wanted)}

    def search(self, query: tuple) -> np.ndarray:
        if query == ALL:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings[query[1]]
        join = (lambda a, b: np.intersect1d(a, b, True)) if query[0] == "and" else np.union1d
        return reduce(join, (self.search(q) for q in query[1]))


class Scanner:
    """Rules with their queries, ready for packs of texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE_RULES)) -> None:
        self.rules, self.n_base = rules, n_base
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = np.array(sorted(set().union(*map(_codes, self.queries))), dtype=np.int64)
        self._slots: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_slots": None}

    def find(self, blobs: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """By text: (start, place of the rule, end), in code points, sorted."""
        if self._slots is None:
            self._slots = np.zeros(1 << 24, dtype=np.uint16)
            self._slots[self.wanted] = np.arange(1, len(self.wanted) + 1)
        index = TrigramIndex(blobs, self.wanted, self._slots)
        found: dict[int, list[tuple[int, int, int]]] = {}
        texts: dict[int, str] = {}
        for k, (rule, query) in enumerate(zip(self.rules, self.queries, strict=True)):
            for d in index.search(query).tolist():
                text = texts.get(d)
                if text is None:
                    text = texts[d] = blobs[d].decode("utf-8", "replace")
                for m in rule.compiled.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.setdefault(d, []).append((m.start(), k, m.end()))
        for own in found.values():
            own.sort()
        return found

    def report(self, blobs: list[bytes]) -> dict[str, list]:
        found = self.find(blobs)
        n = len(blobs)
        nothing = hashlib.sha256(b"").hexdigest()
        out: dict[str, list] = {f"n_{r.kind}": [0] * n for r in self.rules[: self.n_base]} | {"base_sha256": [nothing] * n, "spans": [""] * n}
        for d, own in found.items():
            said = [(k, f"{self.rules[k].kind}:{a}:{b}") for a, k, b in own]
            base = [s for k, s in said if k < self.n_base]
            for k, _ in said:
                if k < self.n_base:
                    out[f"n_{self.rules[k].kind}"][d] += 1
            out["base_sha256"][d] = hashlib.sha256(",".join(base).encode()).hexdigest()
            out["spans"][d] = ",".join(s for _, s in said)
        return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE_RULES)) -> DataFrame:
    """Spans of every rule per input row; a narrow pass without a shuffle.

    Null texts are empty and have no spans; null ids stay null; repeated rows give
    repeated rows; spans of different rules may overlap and are all listed; other
    columns are not read; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    scanner = Scanner(rules, n_base)
    fields = [f"n_{r.kind}" for r in rules[:n_base]]
    schema = pa.schema([("id", pa.int64()), *((n, pa.int64()) for n in fields), ("base_sha256", pa.string()), ("spans", pa.string())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    ddl = "id long, " + "".join(f"{n} long, " for n in fields) + "base_sha256 string, spans string"
    return rows.mapInArrow(by_pack(scanner.report, schema), ddl).withColumnRenamed("id", id_col)
