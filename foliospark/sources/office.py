"""Readers for DOCX, XLSX and PDF, on ``binaryFile`` rows, with the standard library only.

Each file is one row; parsing runs in ``mapInArrow`` and a file that cannot be read
becomes an error, never a failed job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 10_000
MAX_EXPANDED = 150 << 20
MAX_CELLS = 250_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _open(content: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(content))
    entries = archive.infolist()
    if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_EXPANDED:
        raise ValueError("archive too large")
    return archive


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = archive.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("document types are not allowed")
    return ElementTree.fromstring(data)


def _cell(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().replace("|", r"\|")


def _grid(rows: list[list[str]]) -> str:
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join(_cell(c) for c in r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def docx_markdown(content: bytes) -> str:
    """Paragraphs, headings 1 to 6 and tables (grid spans widened, vertical merges left empty)."""
    body = _xml(_open(content), "word/document.xml").find(f"{_W}body")
    out: list[str] = []

    def text(node: ElementTree.Element) -> str:
        return "".join(n.text or "" if n.tag == f"{_W}t" else "\t" if n.tag == f"{_W}tab" else "\n" if n.tag == f"{_W}br" else "" for n in node.iter())

    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"[Hh]eading\s*([1-6])", style.get(f"{_W}val", "")) if style is not None else None
            said = text(node).strip()
            if said:
                out.append(f"{'#' * int(level[1])} {said}" if level else said)
        elif node.tag == f"{_W}tbl":
            rows = []
            for tr in node.findall(f"{_W}tr"):
                row: list[str] = []
                for tc in tr.findall(f"{_W}tc"):
                    span = tc.find(f"{_W}tcPr/{_W}gridSpan")
                    merge = tc.find(f"{_W}tcPr/{_W}vMerge")
                    goes_on = merge is not None and merge.get(f"{_W}val") != "restart"
                    row += ["" if goes_on else text(tc)] + [""] * (int(span.get(f"{_W}val", "1")) - 1 if span is not None else 0)
                rows.append(row)
            out.append(_grid(rows))
    return "\n\n".join(x for x in out if x)


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def excel_day(serial: float, epoch_1904: bool = False) -> str:
    """ISO date of a serial; 60 is the day that never was."""
    from datetime import date, timedelta

    day = int(serial)
    if epoch_1904:
        return (date(1904, 1, 1) + timedelta(day)).isoformat()
    if day == 60:
        return "1900-02-29"
    return (date(1899, 12, 31) + timedelta(day - (day > 60))).isoformat()


def _is_date(code: int, custom: dict[int, str]) -> bool:
    if code in custom:
        bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom[code])
        return bool(re.search(r"[ymdhs]", bare, re.I))
    return 14 <= code <= 22 or 27 <= code <= 36 or 45 <= code <= 47 or 50 <= code <= 58


def xlsx_sheets(content: bytes) -> list[tuple[str, str, str, str, list[str], list[str], list[int], list[str]]]:
    """(name, state, range, Markdown, merges, formulas, hidden rows, hidden columns) of every sheet with cells."""
    archive = _open(content)
    book = _xml(archive, "xl/workbook.xml")
    names = set(archive.namelist())
    links = {r.get("Id"): r for r in _xml(archive, "xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in names else {}
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _xml(archive, "xl/sharedStrings.xml").findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
    custom: dict[int, str] = {}
    styles: list[int] = []
    if "xl/styles.xml" in names:
        root = _xml(archive, "xl/styles.xml")
        custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_S}numFmt")}
        styles = [int(x.get("numFmtId", "0")) for x in root.findall(f"{_S}cellXfs/{_S}xf")]
    properties = book.find(f"{_S}workbookPr")
    epoch = properties is not None and properties.get("date1904") in ("1", "true")
    out = []
    cells_seen = 0
    for sheet in book.iter(f"{_S}sheet"):
        link = links.get(sheet.get(f"{_R}id"))
        if link is None or link.get("TargetMode") == "External":
            continue
        target = link.get("Target", "").lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        if not re.fullmatch(r"xl/worksheets/[^/]+\.xml", target):
            raise ValueError("sheet outside the workbook")
        root = _xml(archive, target)
        grid: dict[tuple[int, int], str] = {}
        formulas = []
        hidden_rows = [int(r.get("r", "0")) for r in root.iter(f"{_S}row") if r.get("hidden") in ("1", "true")]
        hidden_cols = [column_letters(k) for c in root.iter(f"{_S}col") if c.get("hidden") in ("1", "true") for k in range(int(c.get("min")), int(c.get("max")) + 1)]
        for c in root.iter(f"{_S}c"):
            cells_seen += 1
            if cells_seen > MAX_CELLS:
                raise ValueError("too many cells")
            m = re.fullmatch(r"([A-Z]{1,3})([0-9]+)", c.get("r", ""))
            if not m:
                continue
            kind, v = c.get("t", "n"), c.find(f"{_S}v")
            value = v.text or "" if v is not None else ""
            if kind == "s" and value:
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
            elif kind == "b":
                value = "TRUE" if value == "1" else "FALSE"
            elif kind == "n" and value and styles and _is_date(styles[int(c.get("s", "0"))], custom):
                value = excel_day(float(value), epoch)
            f = c.find(f"{_S}f")
            if f is not None and f.text:
                formulas.append(f"{m[0]}={f.text} -> {value}")
            grid[int(m[2]), column_number(m[1])] = value
        if not grid:
            continue
        rows, cols = [r for r, _ in grid], [c for _, c in grid]
        top, bottom, left, right = min(rows), max(rows), min(cols), max(cols)
        table = [[grid.get((r, c), "") for c in range(left, right + 1)] for r in range(top, bottom + 1)]
        merges = [m.get("ref", "") for m in root.iter(f"{_S}mergeCell")]
        span = f"{column_letters(left)}{top}:{column_letters(right)}{bottom}"
        out.append((sheet.get("name", ""), sheet.get("state", "visible"), span, _grid(table), merges, formulas, hidden_rows, hidden_cols))
    return out


def pdf_pages(content: bytes) -> list[str]:
    """Text shown by the simple operators of uncompressed or Flate content streams, page by page."""
    import zlib

    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    pages = []
    for head, raw in re.findall(rb"(<<[^>]*(?:>[^>]+)*?>>)\s*stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = zlib.decompress(raw) if b"FlateDecode" in head else raw
        said = [re.sub(rb"\\([()\\])", rb"\1", s).decode("latin-1") for s in re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|')", data)]
        if said:
            pages.append(" ".join(said))
    return pages


def _markdown(path: str, content: bytes) -> str:
    lower = path.lower()
    if lower.endswith(".docx"):
        return docx_markdown(content)
    if lower.endswith(".xlsx"):
        return "\n\n".join(f"# {name}\n\n{table}" for name, _, _, table, *_ in xlsx_sheets(content))
    if lower.endswith(".pdf"):
        return "\n\n".join(f"# Page {k}\n\n{text}" for k, text in enumerate(pdf_pages(content), 1))
    raise ValueError("unsupported type")


def read_office(files: DataFrame, parse: Callable[[str, bytes], str] = _markdown) -> DataFrame:
    """(path, markdown, error) of rows (path, content)."""
    schema = pa.schema([("path", pa.string()), ("markdown", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append((path, parse(path, content or b""), None))
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.string()) for k in range(3)], schema=schema)

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, "path string, markdown string, error string")
