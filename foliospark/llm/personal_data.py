"""Personal data: base patterns, and bootstrapped contextual extraction.  DataFrame functions only.

A text is a row of items: words, or runs of number groups.  Items that hold a match of a
base pattern are seeds.  The words around a seed, digits told apart by their places only,
are lexical patterns: two words before it, one before and one after, one before, one
after.  A pattern competes once it has enough different seeds, most of one kind, and
its seeds are no accident among all its places in the corpus.  Patterns and what stands in them form a
graph: a pattern is trusted as far as what stands in it is known, an instance as far as
it stands in trusted patterns, over some rounds.  What is trusted enough becomes a seed:
all its places in the corpus induce further patterns, until nothing new is found.

Places come from cutting a text at its matches: the lengths of gaps and matches, summed
up in two levels, so that a text with very many matches takes no quadratic time.  All
expressions are linear in the text: possessive, and anchored where a match can begin.
A text of n megabytes takes some 20 n megabytes of a task's memory while it is cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stored, unused

# The kinds in their order, each with its pattern (no back-tracking variants
# of the plain ones) and what a text must hold to have a match.
KINDS: list[tuple[str, str, str]] = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", "[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
]
_SPACE = r"\x20\x09-\x0D"
#: A space within a run of short number groups; while texts are cut, ``_JOINT`` stands for it.
_RUN = rf"\x20(?=[0-9()-]{{1,9}}+(?![^{_SPACE},;:!?\"']))(?<=(?<![^{_SPACE}])\+?[0-9()-]{{1,9}}\x20)"
_JOINT = "\x00"
#: Items of a text: what stands between spaces, runs of number groups being whole.
_ITEM = rf"[^{_SPACE}]++"
#: Punctuation around an item that is not part of its value.
_MARKS = r"\"')\]>},.;:!?*|&$%#"
_OPEN, _CLOSE = r"^[\"'(\[<{*|#]*+", rf"(?<![{_MARKS}])[{_MARKS}]++$"
#: Different seeds of one kind that a pattern must have, share of its places that must hold one, trust that it needs, and trust that makes an identifier.
MIN_SEEDS, MIN_RATE, MIN_TRUST, ACCEPT = 3, 0.25, 0.7, 0.9
#: Up to so many patterns or values, the texts that hold a word of theirs are picked before texts are cut.
FEW = 64
#: Rounds of scoring between two extensions of the graph.
ROUNDS = 3
#: What an instance that is not known counts against a pattern.
UNKNOWN = 0.2
_BLOCK = 512


def _sums(steps: Column) -> Column:
    """Running sums of an array of ints, in blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))
    add = lambda values, start: F.aggregate(
        values,
        F.struct(F.array().cast("array<int>").alias("all"), start.cast("int").alias("sum")),
        lambda a, x: F.struct(F.concat(a["all"], F.array(a["sum"] + x)).alias("all"), (a["sum"] + x).alias("sum")),
    )["all"]
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    before = add(totals, F.lit(0))
    made = F.flatten(F.transform(blocks, lambda b, k: add(b, F.when(k == 0, F.lit(0)).otherwise(F.get(before, k - 1)))))
    return F.when(F.size(steps) > 0, made).otherwise(F.array().cast("array<int>"))


def _cut(text: str | Column, pattern: str, needs: str) -> tuple[Column, Column]:
    """Matches of a pattern, and the gaps around them (one more)."""
    text = F.col(text) if isinstance(text, str) else text
    some = text.contains(needs) if len(needs) == 1 else text.rlike(needs)
    nothing = F.array().cast("array<string>")
    return F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(nothing), F.when(some, F.split(text, pattern, -1)).otherwise(nothing)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is named once, so that nested expressions don't multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _swapped(text: Column, pattern: str, needs: str, swap) -> Column:
    """A text with every match of a pattern replaced by ``swap`` of it."""

    def one(t: Column) -> Column:
        matches, gaps = _cut(t, pattern, needs)
        both = lambda c: F.concat(F.get(c["gaps"], F.lit(0)), F.array_join(F.transform(c["matches"], lambda m, k: F.concat(swap(m), F.get(c["gaps"], k + 1))), ""))
        return _let(F.struct(matches.alias("matches"), gaps.alias("gaps")), lambda c: F.when(F.size(c["matches"]) > 0, both(c)).otherwise(t))

    return _let(text, one)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def weigh(k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        return F.when(k % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _hits(matches: Column, ends: Column) -> Column:
    """Structs of start, end and value of every match."""
    return F.transform(ends, lambda end, k: F.struct((end - F.length(F.get(matches, k))).alias("start"), end.alias("end"), F.get(matches, k).alias("value")))


def _step(gaps: Column):
    return lambda m, j: F.length(m) + F.length(F.get(gaps, j))


def _keeps(kind: str):
    return lambda h: _valid(kind, h["value"])


def _masking(kind: str):
    return lambda m: F.when(_valid(kind, m), F.lit(f"<{kind.upper()}>")).otherwise(m)


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, a key of the text, and base spans by kind."""
    df = docs.select(docs[id_col].cast("long").alias("id"), _text(docs, text_col).alias("text"))
    cuts: dict[str, Column] = {}
    for kind, pattern, needs in KINDS:
        cuts[f"m_{kind}"], cuts[f"g_{kind}"] = _cut("text", pattern, needs)
    df = df.select("id", F.sha2("text", 256).alias("key"), *(c.alias(n) for n, c in cuts.items()))
    df = df.withColumns({f"s_{k}": F.transform(F.col(f"m_{k}"), _step(F.col(f"g_{k}"))) for k, *_ in KINDS})
    df = df.withColumns({f"e_{k}": _sums(F.col(f"s_{k}")) for k, *_ in KINDS})
    df = df.select("id", "key", *(_hits(F.col(f"m_{k}"), F.col(f"e_{k}")).alias(k) for k, *_ in KINDS))
    return df.withColumns({k: F.filter(k, _keeps(k)) for k, *_ in KINDS})


# -- the pattern-instance graph ---------------------------------------------------------------


def _core(item: Column) -> Column:
    """An item without the punctuation around it."""
    return F.regexp_replace(F.regexp_replace(item, _OPEN, ""), _CLOSE, "")


def _kind(value: Column) -> Column:
    """The kind of an item that holds a base match, or null."""
    some = {
        "email": value.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]"),
        "ip": _valid("ip", F.regexp_extract(value, KINDS[1][1], 0)),
        "card": _valid("card", F.regexp_extract(value, KINDS[2][1], 0)),
        "phone": _valid("phone", F.regexp_extract(value, KINDS[3][1], 0)),
    }
    return F.coalesce(*(F.when(some[k], F.lit(k)) for k, *_ in KINDS))


def _joined(text: Column) -> Column:
    """A text, as long as before, whose runs of number groups hold no space."""
    return F.when(text.rlike("[0-9)] [0-9(-]"), F.regexp_replace(text, _RUN, _JOINT)).otherwise(text)


def _shaped(text: Column) -> Column:
    return F.translate(F.lower(text), "123456789", "000000000")


def _places(docs: DataFrame, text_col: str, value: bool = True, digits: bool = False) -> DataFrame:
    """(value, own, before, last, after) of every place of the corpus; with ``digits``, of those that hold a digit or an at sign.

    All but the value are lower case, their digits 0; neighbours are null where there is none.
    """
    text = _text(docs, text_col)
    df = docs.where(text.rlike("@|[0-9]{2}|[0-9][.][0-9]")) if digits else docs
    cut = lambda t: F.split(F.regexp_replace(t, rf"^[{_SPACE}]+|[{_SPACE}]+$", ""), rf"[{_SPACE}]+", -1)
    joined = _joined(text)
    shapes = cut(_shaped(joined))
    held = df.select(*([cut(joined).alias("items")] if value else []), shapes.alias("own"))
    none = F.array(F.lit(None).cast("string"))
    columns = [F.col("items").alias("value")] if value else []
    columns += [F.col("own"), F.concat(none, none, "own").alias("before"), F.concat(none, "own").alias("last"), F.slice("own", 2, F.size("own")).alias("after")]
    places = held.select(*columns).select(F.inline(F.arrays_zip(*(["value"] if value else []), "own", "before", "last", "after"))).where("own <> ''")
    if digits:
        places = places.where(F.col("own").contains("0") | F.col("own").contains("@"))
    return places.withColumn("value", F.translate("value", _JOINT, " ")) if value else places


def _exploded(places: DataFrame, *columns: str, plain: bool = False) -> DataFrame:
    """A row for every pattern that a place stands in; with ``plain``, of words that don't look like identifiers themselves."""
    word = lambda w: F.when(~(F.col(w).contains("@") | F.col(w).contains("00")), F.col(w)) if plain else F.col(w)
    join = lambda name, *words: F.concat(F.lit(name), *(F.concat(F.lit(" "), word(w)) for w in words))  # noqa: E731  null where a word is
    patterns = F.array(*(join(*side) for side in _SIDES))
    return places.select(F.explode(patterns).alias("pattern"), *columns).where("pattern IS NOT NULL")


_SIDES = (("LL", "before", "last"), ("LR", "last", "after"), ("L", "last"), ("R", "after"))


def _met(places: DataFrame, patterns: DataFrame, *columns: str) -> DataFrame:
    """(pattern, columns) for every place that one of some patterns stands at.

    They meet by a 64-bit hash of the words, so that no string is built for a place.
    """
    words = F.split("pattern", " ", -1)
    hashed = patterns.select("pattern", F.xxhash64(F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.get(words, F.lit(2))).alias("hash"))
    known = lambda names: reduce(Column.__and__, (F.col(n).isNotNull() for n in names))
    hashes = F.array(*(F.when(known(side[1:]), F.xxhash64(F.lit(side[0]), *side[1:])) for side in _SIDES))
    return places.select(F.explode(hashes).alias("hash"), *columns).join(hashed, "hash").select("pattern", *columns)


def _picked(docs: DataFrame, text: Column, words: DataFrame) -> DataFrame:
    """The rows whose text holds one of a few words; all rows where the words are many. Either way no row with a word is lost."""
    few = [r[0] for r in words.limit(FEW + 1).collect()]
    return docs.where(reduce(Column.__or__, (text.contains(w) for w in few))) if 0 < len(few) <= FEW else docs


def _scores(seeds: DataFrame, unknown: DataFrame, min_trust: float, rounds: int, accept: float) -> DataFrame:
    """(value, kind) of unknown instances that the patterns of ``seeds`` make identifiers."""
    names = [k for k, *_ in KINDS]
    scored = unknown.select("pattern", "value", F.lit(None).cast("string").alias("guess"), F.lit(0.0).alias("score"))
    for k in range(rounds):
        weights = scored.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.when(F.col("guess") == k, F.col("score")).otherwise(0.0)).alias(f"more_{k}") for k in names))
        joined = seeds.join(weights, "pattern")
        known = sum((F.col(f"more_{k}") for k in names), F.lit(0.0))
        whole = F.col("n_seeds") + known + UNKNOWN * (F.col("n") - known)
        best = F.array_max(F.array(*(F.struct(((F.col(f"seed_{k}") + F.col(f"more_{k}")) / whole).alias("trust"), F.lit(k).alias("kind")) for k in names)))
        trusted = joined.select("pattern", best.alias("b")).select("pattern", "b.kind", "b.trust").where(F.col("trust") >= min_trust)
        # Patterns that share the word before the place say the same thing: the best of them counts.
        words = F.split("pattern", " ", -1)
        side = F.when(F.get(words, F.lit(0)) == "R", F.col("pattern")).otherwise(F.get(words, F.when(F.get(words, F.lit(0)) == "LL", 2).otherwise(1)))
        votes = scored.join(trusted, "pattern").groupBy("value", "kind", side.alias("side")).agg(F.max("trust").alias("trust"))
        votes = votes.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.99)))))).alias("score"))
        found = stored(votes.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score"), "pii-found")
        if found.isEmpty() or k + 1 == rounds:
            break
        # Only what is trusted enough supports its patterns, or guesses would support each other.
        scored = scored.select("pattern", "value").join(found.where(F.col("score") >= accept), "value", "left").select("pattern", "value", F.col("kind").alias("guess"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return found.where(F.col("score") >= accept).select("value", "kind")


def identifiers(docs: DataFrame, text_col: str = "text", min_seeds: int = MIN_SEEDS, min_rate: float = MIN_RATE, min_trust: float = MIN_TRUST, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(value, kind) of what contexts make identifiers, over all texts of ``docs``.

    Every extension adds values, so the loop ends.  Hot patterns and values are folded
    by partial sums in every task; tables of patterns and values meet the places of the
    corpus by joins whose sides Spark measures before it broadcasts one.
    """
    names = [k for k, *_ in KINDS]
    value = F.col("value")
    nothing = docs.sparkSession.createDataFrame([], "pattern string, value string, kind string, n long")
    seen = _places(docs, text_col, digits=True).withColumn("kind", _kind(value)).where("kind IS NOT NULL").withColumn("value", _core(value))
    edges = stored(_exploded(seen, "value", "kind", plain=True).groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    counts, unknown = nothing.select("pattern", F.col("n").alias("places")), nothing.select("pattern", "value")
    asked, found = nothing.select("pattern"), nothing.select("value", "kind")
    while True:
        seeds = edges.groupBy("pattern").agg(
            F.count(F.lit(1)).alias("n_seeds"), F.sum("n").alias("held"), *(F.sum(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(f"seed_{k}") for k in names)
        )
        seeds = stored(seeds.where(F.greatest(*(f"seed_{k}" for k in names)) >= min_seeds), "pii-seeds")
        fresh = stored(seeds.select("pattern").join(counts, "pattern", "left_anti"), "pii-fresh")
        if not fresh.isEmpty():
            counts = counts.unionByName(stored(_met(_places(docs, text_col, value=False), fresh).groupBy("pattern").agg(F.count(F.lit(1)).alias("places")), "pii-counts"))
        pure = F.greatest(*(f"seed_{k}" for k in names)) >= min_trust * F.col("n_seeds")
        rated = stored(seeds.join(counts, "pattern").where(pure & (F.col("held") >= min_rate * F.col("places"))).drop("held", "places"), "pii-rated")
        fresh = stored(rated.select("pattern").join(asked, "pattern", "left_anti"), "pii-fresh")
        if not fresh.isEmpty():
            words = F.slice(F.split("pattern", " ", -1), 2, 2)
            some = _picked(docs, _shaped(_joined(_text(docs, text_col))), fresh.select(F.element_at(F.array_sort(words, lambda a, b: F.length(a) - F.length(b)), -1)))
            met = _met(_places(some, text_col), fresh, "value").where(_kind(value).isNull())
            unknown = unknown.unionByName(stored(met.select("pattern", _core(value).alias("value")).where("value <> ''").distinct(), "pii-unknown"))
            asked = asked.unionByName(fresh)
        more = stored(_scores(rated, unknown.join(found, "value", "left_anti"), min_trust, rounds, accept), "pii-more")
        if more.isEmpty():
            return found
        found = found.unionByName(more)
        again = _places(_picked(docs, _text(docs, text_col), more.select("value")), text_col).withColumn("value", _core(value)).join(more, "value")
        edges = edges.unionByName(stored(_exploded(again, "value", "kind", plain=True).groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n")), "pii-edges"))


def _held(docs: DataFrame, text_col: str, values: DataFrame) -> DataFrame:
    """(key of the text, the found values that are items of it with their kinds)."""
    items = docs.select(_text(docs, text_col).alias("text")).select(F.sha2("text", 256).alias("key"), F.array_distinct(F.split(_joined(F.col("text")), rf"[{_SPACE}]+", -1)).alias("items"))
    met = items.select("key", F.explode("items").alias("item")).select("key", _core(F.translate("item", _JOINT, " ")).alias("value")).join(values, "value")
    return stored(met.distinct().groupBy("key").agg(F.collect_list(F.struct("value", "kind")).alias("known")), "pii-held")


def _kind_of(value: Column, known: str | Column) -> Column:
    return F.get(F.filter(known, lambda v: v["value"] == value), F.lit(0))["kind"]


def _found(docs: DataFrame, text_col: str, held: DataFrame) -> DataFrame:
    """(key, spans of found values) of the texts that hold some."""
    df = docs.select(_text(docs, text_col).alias("text")).withColumn("key", F.sha2("text", 256)).dropDuplicates(["key"]).join(held, "key")
    df = df.withColumn("text", _joined(F.col("text")))
    matches, gaps = _cut("text", _ITEM, "[^ ]")
    df = df.select("key", "known", F.transform(matches, lambda m: F.translate(m, _JOINT, " ")).alias("m"), gaps.alias("g"))
    df = df.withColumn("e", _sums(F.transform("m", _step(F.col("g")))))

    def span(hit: Column) -> Column:
        start = hit["start"] + F.length(F.regexp_extract(hit["value"], _OPEN, 0))
        return F.struct(_kind_of(_core(hit["value"]), "known").alias("kind"), start.alias("start"), (start + F.length(_core(hit["value"]))).alias("end"))

    return df.select("key", F.filter(F.transform(_hits(F.col("m"), F.col("e")), span), lambda h: h["kind"].isNotNull()).alias("more"))


def _said(kind: Column | str, hit: Column) -> Column:
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, hit["start"].cast("string"), hit["end"].cast("string"))


def _saying(kind: str):
    return lambda h: _said(kind, h)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **tuning) -> DataFrame:
    """Base counts, their digest and all spans, one row per input row.

    Columns: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.  ``spans``
    has the base ones first and then those that contexts add, as ``found_<kind>``; a
    found span never overlaps a base one.  Null texts are empty; null ids stay null;
    repeated rows give repeated rows; other columns are not read; an empty table gives
    no rows.
    """
    names = [k for k, *_ in KINDS]
    located = stored(_located(docs, id_col, text_col), "pii-spans")
    values = stored(identifiers(docs, text_col, **tuning), "pii-values")
    base = F.concat(*(F.transform(k, _saying(k)) for k in names))
    found = F.array().cast("array<string>")
    if not values.isEmpty():
        located = located.join(_found(docs, text_col, _held(docs, text_col, values)), "key", "left")
        free = F.filter(F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda h: ~F.exists(F.concat(*names), lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])))
        order = F.array(*map(F.lit, names))
        free = F.array_sort(F.transform(free, lambda h: F.struct(F.array_position(order, h["kind"]).alias("order"), h["start"].alias("start"), h["end"].alias("end"), F.concat(F.lit("found_"), h["kind"]).alias("kind"))))
        found = F.transform(free, lambda h: _said(h["kind"], h))
    out = located.select("id", *(F.size(k).cast("long").alias(f"n_{k}") for k in names), base.alias("base"), found.alias("found"))
    return out.select(
        F.col("id").alias(id_col),
        *(f"n_{k}" for k in names),
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("base", "found"), ",").alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", **tuning) -> DataFrame:
    """The rows of ``docs`` with personal data replaced by ``<KIND>``, all columns kept, whatever their names.

    Kinds are replaced in their order, each in what the last one left; then the items
    whose value contexts found, as whole items only.  A null text stays null; repeated
    rows and an empty table stay what they are.  ``count_col``, where present, gets the
    new length of texts that changed.
    """
    columns = docs.columns
    new, key, known = (unused(columns, n) for n in ("new", "key", "known"))
    values = stored(identifiers(docs, text_col, **tuning), "pii-values")
    masked = _text(docs, text_col)
    for kind, pattern, needs in KINDS:
        masked = _swapped(masked, pattern, needs, _masking(kind))
    df = docs
    if not values.isEmpty():
        held = _held(docs, text_col, values).select(F.col("key").alias(key), F.col("known").alias(known))
        df = docs.withColumn(key, F.sha2(_text(docs, text_col), 256)).join(held, key, "left")

        def swap(item: Column) -> Column:
            item = F.translate(item, _JOINT, " ")
            mask = lambda kind: F.concat(F.regexp_extract(item, _OPEN, 0), F.lit("<FOUND_"), F.upper(kind), F.lit(">"), F.regexp_extract(F.regexp_replace(item, _OPEN, ""), _CLOSE, 0))
            return _let(_kind_of(_core(item), known), lambda kind: F.coalesce(mask(kind), item))

        masked = _let(masked, lambda t: F.when(F.col(known).isNotNull(), _swapped(_joined(t), _ITEM, "[^ ]", swap)).otherwise(t))
    df = df.withColumn(new, masked)
    text = docs[text_col]
    out = {text_col: F.when(text.isNotNull(), F.col(new)).otherwise(text)}
    if count_col in columns:
        out[count_col] = F.when(text.isNotNull() & (F.col(new) != text), F.length(new).cast(docs.schema[count_col].dataType)).otherwise(docs[count_col])
    return df.select(*((out[c] if c in out else docs[c]).alias(c) for c in columns))
