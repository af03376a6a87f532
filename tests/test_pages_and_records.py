"""Page tools, quotes, filters and commits."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import analysis, planning, publish, records
from foliospark.sources import pages


def test_tables_and_sections():
    assert pages.table_cells(r"| a \| b | c |  |") == ["a | b", "c", ""]
    text = "one two\nthree four\nfive six seven"
    assert pages.split_sections(text, 20) == ["one two\nthree four", "five six seven"]
    assert pages.split_sections("x" * 25, 10) == ["x" * 6] * 2 + ["x" * 6, "x" * 7] and pages.split_sections("  ", 5) == []


def test_related_references():
    text = "See [[Entities/A.md|x]] and [b](./topics/b.md#top) or `[[no]]`.\n\n## Related\n- wiki/Concepts/c.md\n- [[D]]\n- plain words\n- topics/../e.md\n\n## Next\n- topics/f.md\n"
    assert pages.related_references(text) == ["Entities/A", "D", "topics/b", "concepts/c"]


def test_overlaps_and_excerpts():
    text = "# T\n\n## A\nx\n### B\ny\n## C\nz\n"
    assert pages.overlapping_sections(text, ["a", "B", "c"]) == [("A", "B")] and pages.overlapping_sections(text, ["A"]) == []
    whole = pages.draft_excerpt(text + "## A\nagain\n## Related\n- q\n", 500)
    assert not whole["truncated"] and whole["editable"] == ["T", "B", "C"] and whole["protected"] == ["A", "A"]
    long = "## A\n" + "x" * 10 + "\n## B\n" + "y" * 300 + "\n## C\n" + "z" * 5
    cut = pages.draft_excerpt(long, 100)
    assert cut["truncated"] and cut["content"].startswith(long[:65]) and cut["content"].endswith(long[-35:])
    assert cut["editable"] == ["A", "C"] and cut["protected"] == ["B"]


def test_original_quote():
    source = "He said “the  *red*\nhouse” twice: red, red. ﬁne"
    assert analysis.original_quote(source, 'said "the red house"') == "said “the  *red*\nhouse”"
    assert analysis.original_quote(source, "red") is None and analysis.original_quote(source, "blue") is None
    assert analysis.original_quote(source, "fine") == "ﬁne" and analysis.original_quote(source, "") is None


def test_filters_and_clamps(spark):
    assert records.normalise_filters({"kind": " a "}) == {"kind": "a"} and records.normalise_filters(None) == {}
    for bad in ({"other": "x"}, {"kind": " "}, {"kind": "x" * 501}, {"kind": 3}):
        with pytest.raises(ValueError):
            records.normalise_filters(bad)
    rows = spark.createDataFrame([("5",), ("500",), ("-1",), ("2.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in rows.select(records.clamp(F.col("v"), 1, 100, 20)).collect()] == [5, 100, 1, 20, 20, 20]


def test_paths(spark):
    good = ["wiki/topics/a.md", "wiki/entities/x/y.MD"]
    bad = ["wiki/index.md", "wiki/topics/../a.md", "/wiki/topics/a.md", "wiki\\topics\\a.md", "C:/wiki/topics/a.md", "wiki/other/a.md", "wiki/topics//a.md", "wiki/topics/a.txt", "http://x/wiki/topics/a.md", None]
    rows = spark.createDataFrame([(p,) for p in good + bad], "p string")
    assert [r[0] for r in rows.select(T.valid_page_path("p")).collect()] == [True] * len(good) + [False] * len(bad)


def test_requirements_on_hard_rows(spark):
    rows = [(1, "A b", "entity", "c1", "x", False), (2, "a  B!", "meeting", "c2", "y", True), (3, None, "entity", "c", "z", True), (4, " ", "entity", "c", "z", True), (5, "Q", "odd", "c", "z", False)]
    made = {r.title: r for r in planning.requirements(spark.createDataFrame(rows, "seq long, title string, kind string, collection string, batch string, override boolean")).collect()}
    assert set(made) == {"A b", "Q"} and made["A b"].page_kind == "meeting" and made["A b"].collections == ["c1", "c2"] and made["Q"].preferred_path == "wiki/topics/q.md"
    none = spark.createDataFrame([], "seq long, title string, kind string, collection string, batch string, override boolean")
    assert planning.shards(planning.requirements(none), 6).count() == 0


def test_commit_meets_a_change_in_between(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    patch = lambda path: spark.createDataFrame([(path, "create", None, "text")], "path string, operation string, expected_hash string, content string")
    assert publish.commit(spark, root, patch("wiki/topics/a.md")).count() == 0
    assert publish.commit(spark, root, patch("wiki/topics/b.md")).count() == 0
    assert {r.path for r in publish.current(spark, root).collect()} == {"wiki/topics/a.md", "wiki/topics/b.md"}
    held, real = iter([None]), publish.pointer
    monkeypatch.setattr(publish, "pointer", lambda s, r: next(held, real(s, r)))
    with pytest.raises(RuntimeError):
        publish.commit(spark, root, patch("wiki/topics/c.md"))
    monkeypatch.undo()
    assert publish.commit(spark, root, patch("wiki/topics/d.md")).count() == 0
