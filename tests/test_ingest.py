import io
import zipfile

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import ingest
from foliospark.sources import office, pages


def test_html():
    out = ingest.html_to_markdown("<h1>A &amp; B</h1><script>x()</script><p>one<br>two</p><table><tr><th>Name</th><th>Type</th></tr><tr><td>a|b</td></tr></table>&copy;")
    assert "# A & B" in out and "x()" not in out and "one\ntwo" in out
    assert "| Name | Type |\n| --- | --- |\n| a\\|b |  |" in out and "&copy;" in out


def test_blocks_and_chunks():
    text = "# T\n\npara one\nmore\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\n# no heading\n```\n## U\nlast"
    kinds = [b[0] for b in ingest.blocks(text)]
    assert kinds == ["heading", "paragraph", "table", "code", "heading", "paragraph"]
    for _, body, a, b, _ in ingest.blocks(text):
        assert text[a:b] == body
    made = ingest.chunks(text, 500)
    assert [c[1] for c in made] == [["T"], ["T", "U"]]
    assert all(text[a:b] == piece for piece, _, a, b in made)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n。.;", max_size=400), st.integers(5, 60))
def test_pieces_join_again(text, limit):
    cuts = ingest.cut_text(text, limit)
    assert "".join(text[a:b] for a, b in cuts) == text
    assert all(b - a <= limit for a, b in cuts)


def test_long_paragraph_offsets():
    made = ingest.chunks("word " * 2500, 1000)
    starts = [c[2] for c in made]
    assert starts == sorted(set(starts)) and len(made) > 10


def test_evidence():
    got = ingest.evidence("```\ncode\n```\n| a |\n|---|\n---\n" + "x" * 590 + ". " + "y" * 300)
    assert "code" not in got and all(len(q) <= 600 for q in got) and got[-1].startswith("y")


def test_admit(spark):
    rows = [("a.md", b"same"), ("b.html", b"same"), ("c.md", b"same"), ("d.xls", b"x"), ("e.md", b"a\0b"), ("f.md", b""), ("g.txt", b"y" * 50)]
    got = {r.path: r for r in ingest.admit(spark.createDataFrame(rows, "path string, content binary"), 40).collect()}
    assert got["a.md"].source_id == got["c.md"].source_id != got["b.html"].source_id
    assert got["c.md"].duplicate and not got["b.html"].duplicate
    assert [got[p].error for p in ("a.md", "d.xls", "e.md", "f.md", "g.txt")] == [None, "legacy workbooks are not supported", "binary content", "empty", "too large"]


def test_text_functions(spark):
    df = spark.createDataFrame([("﻿  北京市 AI a I The End ",)], "t string")
    row = df.select(T.trim_space("t").alias("trim"), T.lexical_tokens("t").alias("lex"), T.unique_tokens("t").alias("uni"), T.page_slug(F.lit(" A/B: c--d. ")).alias("slug")).first()
    assert row.trim == "北京市 AI a I The End"
    assert row.lex == ["北京市", "北京", "京市", "ai", "the", "end"]
    assert row.uni == ["北京市", "北京", "京市", "ai", "end"]
    assert row.slug == "a-b-c-d"


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = _zip({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    xlsx = _zip(
        {
            "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" state="hidden" sheetId="2" r:id="r2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" TargetMode="External" Target="http://x/y.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {s}><si><t>Name</t></si></sst>",
            "xl/styles.xml": f'<styleSheet {s}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f'<worksheet {s}><cols><col min="3" max="3" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Day</t></is></c></row><row r="2"><c r="A2"><f>B2*2</f><v>84</v></c><c r="B2" s="1"><v>45292</v></c><c r="C2" t="b"><v>1</v></c></row><row r="3" hidden="1"><c r="A3"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="D1:E1"/></mergeCells></worksheet>',
        }
    )
    ((name, state, span, table, merges, formulas, rows, cols),) = office.xlsx_sheets(xlsx)
    assert (name, state, span, merges, rows, cols) == ("One", "visible", "A1:C3", ["D1:E1"], [3], ["C"])
    assert "2024-01-01" in table and "TRUE" in table and formulas == ["A2=B2*2 -> 84"]
    assert office.excel_day(60) == "1900-02-29" and office.excel_day(61) == "1900-03-01"
    files = spark.createDataFrame([("a.docx", docx), ("b.xlsx", b"broken"), ("c.pdf", b"%PDF-1.4\n<< /Length 9 >>\nstream\nBT (Hello) Tj ET\nendstream")], "path string, content binary")
    got = {r.path: r for r in office.read_office(files).collect()}
    assert got["a.docx"].markdown.startswith("# Title\n\ntext\n\n| wide |  |") and got["a.docx"].error is None
    assert got["b.xlsx"].markdown is None and "BadZipFile" in got["b.xlsx"].error
    assert got["c.pdf"].markdown == "# Page 1\n\nHello"


def test_page_tools():
    text = '---\ntitle: X\ntags: ["a","b"]\n---\n# X\n[[One|alias]] `[[no]]`\n```\n[[no]]\n```\n> [[no]]\n<!-- [[no]] -->\n## A\none\n### B\ntwo\n## C\nthree\n'
    fields, body = pages.frontmatter(text)
    assert fields == {"title": "X", "tags": ["a", "b"]} and body.startswith("# X")
    assert pages.wiki_links(text) == ["One"] and len(pages.mask(text)) == len(text)
    assert [s[0] for s in pages.sections(text)] == ["X", "A", "B", "C"]
    out = pages.edit_section(text, "replace", "A", "new")
    assert "## A\n\nnew\n\n## C" in out and "two" not in out
    assert "## D\n\nx" in pages.edit_section(text, "upsert", "D", "x")
    assert "## C" not in pages.edit_section(text, "remove", "C")


def test_batches_of_long_texts_are_bounded(spark):
    """Bounded by rows alone, 400 texts of 100 000 characters came as one Arrow batch and went back as one."""

    class Rows:
        sparkSession = spark
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    run = ingest.document_blocks(Rows(), "doc_id", "text")
    text = "line\n\n" * 16_667
    made = list(run(iter([pa.RecordBatch.from_pydict({"doc_id": [*range(40)], "text": [text] * 40})])))
    assert sum(b.num_rows for b in made) == 40 * 16_667 and max(b.num_rows for b in made) <= 10_000
    rows = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    docs = spark.range(0, 400, 1, 1).select(F.col("id"), F.repeat(F.lit("x"), 100_000).alias("text"))
    sizes = [r.n for r in docs.mapInArrow(rows, "n long").collect()]
    assert sum(sizes) == 400 and max(sizes) <= 45


def test_items_leave_python_in_packs(spark, monkeypatch):
    monkeypatch.setattr(ingest, "PACK_CHARS", 50)
    monkeypatch.setattr(ingest, "PACK_ROWS", 7)
    texts = ["a\n\n" * n for n in (0, 1, 6, 7, 8, 30)] + [None, "b" * 200, "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in ingest.document_blocks(docs, "doc_id", "text").collect()]
    assert sorted(got) == sorted((i, k, *b) for i, t in enumerate(texts) for k, b in enumerate(ingest.blocks(t or "")))
