"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the unique-token function leaves out.
STOP_WORDS = [
    "the", "is", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with",
    "this", "that", "these", "those", "be", "as", "by", "from", "it", "its",
    "的", "是", "了", "在", "有", "和", "与", "对", "从", "一个",
]

# Page kinds and their folders.
PAGE_KIND_DIRS = {
    "source": "sources",
    "entity": "entities",
    "concept": "concepts",
    "topic": "topics",
    "comparison": "comparisons",
    "query": "queries",
    "synthesis": "synthesis",
    "finding": "findings",
    "methodology": "methodology",
    "thesis": "thesis",
    "meeting": "meetings",
    "decision": "decisions",
    "project": "projects",
    "stakeholder": "stakeholders",
    "goal": "goals",
    "habit": "habits",
    "reflection": "reflections",
    "chapter": "chapters",
    "character": "characters",
    "theme": "themes",
    "plot-thread": "plot-threads",
    "journal": "journal",
}

_CJK = r"[\x{3400}-\x{9fff}]"
_WORD = r"[\p{L}\p{N}]+"
_LONG_WORD = r"[\p{L}\p{N}]{2,}+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: str | Column) -> Column:
    """Trim every Unicode space and the byte-order mark, not only U+0020."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def _with_bigrams(tokens: Column, keep) -> Column:
    """Tokens that ``keep`` accepts, each followed by the code-point pairs of those with ideographs."""

    def spread(token: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - 1, F.lit(1))), lambda i: F.substring(token, i, F.lit(2)))
        own = F.when(keep(token), F.array(token)).otherwise(F.array().cast("array<string>"))
        return F.when(token.rlike(_CJK) & (F.length(token) > 1), F.concat(own, pairs)).otherwise(own)

    return F.flatten(F.transform(tokens, spread))


def lexical_tokens(c: str | Column) -> Column:
    """Lower-cased runs of letters and digits longer than one, in order, repeats included; ideographs also as pairs."""
    text = F.lower(_col(c))
    spread = _with_bigrams(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda t: F.length(t) > 1)
    return F.when(text.rlike(_CJK), spread).otherwise(F.regexp_extract_all(text, F.lit(_LONG_WORD), F.lit(0)))


def unique_tokens(c: str | Column) -> Column:
    """The distinct lexical tokens without stop words, in order of first occurrence."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_except(lexical_tokens(c), stop)


def page_slug(c: str | Column) -> Column:
    """Path-safe form of a title."""
    out = F.lower(trim_space(c))
    for pattern, to in ((r"[\\/]+", "-"), (r"[^\p{L}\p{N}._-]+", "-"), (r"-{2,}", "-"), (r"^[-.]+|[-.]+$", "")):
        out = F.regexp_replace(out, pattern, to)
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit("untitled")).otherwise(out)


def page_kind(c: str | Column) -> Column:
    """A known page kind, or null."""
    kind = F.regexp_replace(F.lower(trim_space(c)), r"(?U)[\s_]+", "-")
    kind = F.when(kind == "comparison-page", F.lit("comparison")).otherwise(kind)
    return F.when(kind.isin(list(PAGE_KIND_DIRS)), kind)


def page_path(kind: str | Column, title: str | Column) -> Column:
    """The preferred path of a page."""
    folders = F.create_map(*(F.lit(x) for pair in PAGE_KIND_DIRS.items() for x in pair))
    folder = F.coalesce(F.try_element_at(folders, page_kind(kind)), F.lit(PAGE_KIND_DIRS["topic"]))
    return F.concat(F.lit("wiki/"), folder, F.lit("/"), page_slug(title), F.lit(".md"))


def valid_page_path(c: str | Column) -> Column:
    """Whether a path is a normalised one to a page in a known folder that the library doesn't keep itself."""
    path = _col(c)
    roots = "|".join(sorted(set(PAGE_KIND_DIRS.values())))
    inside = path.rlike(rf"\A(?:wiki)/(?:{roots})/(?:[^/\\\x00]+/)*[^/\\\x00]*(?i:\.md)\z")
    return F.coalesce(inside & ~path.rlike(r"(?:^|/)\.{0,2}(?:/|\z)") & ~path.isin(["wiki/index.md", "wiki/overview.md", "wiki/log.md"]), F.lit(False))


def link_target(c: str | Column) -> Column:
    """A link's target as lint compares it: no alias, no anchor, no extension, lower case."""
    out = F.regexp_replace(F.regexp_replace(_col(c), r"\|.*$", ""), r"#.*$", "")
    return F.lower(F.regexp_replace(trim_space(F.regexp_replace(out, r"\\", "/")), r"\.md$", ""))


def wiki_target(c: str | Column) -> Column:
    """A link as retrieval compares it: no leading folder, no extension, lower case; spaces and aliases stay."""
    out = F.regexp_replace(F.regexp_replace(_col(c), r"\\", "/"), r"(?i)^wiki/", "")
    return F.lower(F.regexp_replace(out, r"(?i)\.md$", ""))


def related_slug(c: str | Column) -> Column:
    """A related page as pages name it: brackets, folder and extension gone, then the alias; case stays."""
    out = _col(c)
    for pattern, to in ((r"\\", "/"), (r"^\[\[", ""), (r"\]\]$", ""), (r"(?i)^wiki/", ""), (r"(?i)\.md$", "")):
        out = F.regexp_replace(out, pattern, to)
    return trim_space(F.get(F.split(trim_space(out), r"\|", 2), F.lit(0)))


def related_path(c: str | Column) -> Column:
    """A relative path to a page in a known folder as its slug; anything else is empty."""
    out = trim_space(c)
    for pattern, to in ((r"^<|>$", ""), (r"^`|`$", ""), (r"\\", "/"), (r"[?#].*$", ""), (r"^/+", ""), (r"^\./", ""), (r"(?i)^wiki/(?=.)", "")):
        out = F.regexp_replace(out, pattern, to)
    parts = F.split(out, "/", -1)
    root, rest = F.lower(F.get(parts, F.lit(0))), F.slice(parts, 2, F.size(parts))
    fine = root.isin(sorted(set(PAGE_KIND_DIRS.values()))) & (F.size(rest) > 0) & ~F.exists(rest, lambda x: x.isin("", ".", "..")) & ~out.contains(" ") & ~out.rlike(r"(?i)^[a-z][a-z\d+.-]*:")
    return F.when(fine, related_slug(F.concat_ws("/", root, F.array_join(rest, "/")))).otherwise("")


def snippet(text: str | Column, terms: list[str], before: int = 300, width: int = 900) -> Column:
    """``width`` characters from ``before`` ahead of the earliest term, with ellipses where cut."""
    t = _col(text)
    hits = F.filter(F.array(*(F.instr(F.lower(t), term) for term in terms)), lambda x: x > 0)
    at = F.coalesce(F.array_min(hits), F.lit(1))
    start = F.greatest(at - before, F.lit(1))
    cut = F.substring(t, start, F.lit(width))
    return F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), cut, F.when(start + width - 1 < F.length(t), F.lit("…")).otherwise(F.lit("")))


def coerce_confidence(c: str | Column) -> Column:
    """Numbers between 0 and 1 given as text, else null."""
    return F.when(trim_space(c).rlike(r"^(?:0(?:\.\d+)?|1(?:\.0+)?)$"), F.try_to_number(trim_space(c), F.lit("9.999999")).cast("double"))


def token_estimate(c: str | Column) -> Column:
    """About four characters a token."""
    return F.ceil(F.length(_col(c)) / 4)


def excel_date(serial: Column) -> Column:
    """Date of a 1900-system serial; the day that never was stays its literal."""
    day = F.floor(serial).cast("int")
    real = F.date_add(F.lit("1899-12-31").cast("date"), day - F.when(day >= 60, 1).otherwise(0)).cast("string")
    return F.when(day == 60, F.lit("1900-02-29")).otherwise(real)


def column_name(number: Column) -> Column:
    """A1-style letters of a column number, to some 10**15; nothing for numbers under 1."""
    n = number.cast("long") - 1
    letters, first, power = [], 0, 1  # first: the least n with a letter in this place
    for _ in range(11):
        letter = F.char((F.floor((n - first) / power) % 26).cast("int") + 65)
        letters.append(F.when(n >= first, letter).when(n < first, ""))
        power *= 26
        first += power
    return F.concat(*reversed(letters))
