"""From sources to blocks, chunks, batches and evidence.

Routing, guards, hashes and duplicates are Column expressions.  The sequential text
machines run per document in ``mapInArrow``: documents are independent, so partitions
need nothing from each other and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches

# Extensions and their media types.
MEDIA_TYPES = {
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".txt": "text/plain",
    ".html": "text/html",
    ".htm": "text/html",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pdf": "application/pdf",
}


def media_type(path: str | Column) -> Column:
    """Media type by extension; null where it is not supported."""
    c = F.col(path) if isinstance(path, str) else path
    types = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.try_element_at(types, F.lower(F.regexp_extract(c, r"(\.[^./\\]+)$", 1)))


def storage_id(content_hash: Column, own_type: Column, first_type: Column) -> Column:
    """Source id: the content hash, or with the type mixed in where the same bytes came with another type before."""
    mixed = F.sha2(F.concat(content_hash, F.lit("\0"), own_type), 256)
    return F.concat(F.lit("source-"), F.substring(F.when(own_type == first_type, content_hash).otherwise(mixed), 1, 24))


def admit(files: DataFrame, max_bytes: int) -> DataFrame:
    """Guard and identify files (path, content): adds media_type, error, content_hash, source_id, duplicate."""
    rows = files.withColumns({"media_type": media_type("path"), "size": F.length("content"), "content_hash": F.sha2("content", 256)})
    text = F.col("media_type").startswith("text/")
    error = (
        F.when(F.lower("path").endswith(".xls"), "legacy workbooks are not supported")
        .when(F.col("media_type").isNull(), "unsupported type")
        .when(F.col("size") > max_bytes, "too large")
        .when(F.col("size") == 0, "empty")
        .when(text & F.hex("content").rlike("^(..)*?00"), "binary content")
    )
    w = Window.partitionBy("content_hash").orderBy("path")
    return (
        rows.withColumn("error", error)
        .withColumn("first_type", F.first("media_type").over(w))
        .withColumn("source_id", storage_id(F.col("content_hash"), F.col("media_type"), F.col("first_type")))
        .withColumn("duplicate", F.row_number().over(Window.partitionBy("content_hash", "media_type").orderBy("path")) > 1)
        .drop("first_type")
    )


# -- HTML and Markdown ----------------------------------------------------------------------

_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def decode_entities(text: str) -> str:
    """Numeric and six named entities; other names stay."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] == "#":
            try:
                return chr(int(body[2:], 16) if body[1] in "xX" else int(body[1:]))
            except (ValueError, OverflowError):
                return m[0]
        return _ENTITIES.get(body.lower(), m[0])

    return re.sub(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z]+);", one, text)


def _inline(html: str) -> str:
    return re.sub(r"\s+", " ", decode_entities(re.sub(r"<[^>]+>", " ", html))).strip()


def _table(html: str) -> str:
    rows = [[_inline(c).replace("|", r"\|") for c in re.findall(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>", r)] for r in re.findall(r"(?is)<tr\b[^>]*>(.*?)</tr>", html)]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n\n" + "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n\n"


def html_to_markdown(html: str) -> str:
    """Headings, lists, paragraphs and tables of a page; comments, scripts and styles go."""
    out = re.sub(r"(?s)<!--.*?-->", "", html)
    out = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1\s*>", "", out)
    out = re.sub(r"(?is)<table\b[^>]*>(.*?)</table>", lambda m: _table(m[1]), out)
    out = re.sub(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>", lambda m: f"\n\n{'#' * int(m[1])} {_inline(m[2])}\n\n", out)
    out = re.sub(r"(?is)<li\b[^>]*>(.*?)</li\s*>", lambda m: f"\n- {_inline(m[1])}", out)
    out = re.sub(r"(?i)<(?:p|div|section|article|ul|ol|blockquote|pre|header|footer|nav|main)\b[^>]*>", "\n\n", out)
    out = re.sub(r"(?i)<br\s*/?>", "\n", out)
    out = decode_entities(re.sub(r"<[^>]+>", "", out))
    lines = [line.rstrip() for line in out.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


Block = tuple[str, str, int, int, int | None]
_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def blocks(text: str) -> list[Block]:
    """(kind, text, start, end, level) of a Markdown text, in order.

    Fences come before headings, headings before tables, tables before paragraphs;
    offsets are code points of the text.
    """
    found: list[Block] = []
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((line, at))
        at += len(line) + 1
    i = 0

    def close(kind: str, first: int, last: int, level: int | None = None) -> None:
        start, end = lines[first][1], lines[last][1] + len(lines[last][0])
        found.append((kind, text[start:end], start, end, level))

    while i < len(lines):
        line = lines[i][0]
        fence = re.match(r"^\s{0,3}(`{3,}|~{3,})", line)
        heading = re.match(r"^(#{1,6})\s+\S", line)
        j = i
        if fence:
            j = next((k for k in range(i + 1, len(lines)) if lines[k][0].strip().startswith(fence[1]) and not lines[k][0].strip().strip(fence[1][0])), len(lines) - 1)
            close("code", i, j)
        elif heading:
            close("heading", i, i, len(heading[1]))
        elif "|" in line and i + 1 < len(lines) and "|" in lines[i + 1][0] and _RULE.match(lines[i + 1][0]):
            j = i + 1
            while j + 1 < len(lines) and "|" in lines[j + 1][0] and lines[j + 1][0].strip():
                j += 1
            close("table", i, j)
        elif line.strip():
            while j + 1 < len(lines) and lines[j + 1][0].strip() and not re.match(r"^(#{1,6}\s+\S|\s{0,3}(`{3,}|~{3,}))", lines[j + 1][0]):
                j += 1
            close("paragraph", i, j)
        i = j + 1
    return found


def cut_text(text: str, limit: int, marks: tuple[str, ...] = ("\n\n", "\n", "。", ". ", "; "), least: float = 0.6) -> list[tuple[int, int]]:
    """Pieces of at most ``limit`` characters, as offsets; a cut falls before the last mark beyond ``least`` of the limit."""
    out, start = [], 0
    while len(text) - start > limit:
        window = text[start : start + limit]
        at = max(window.rfind(m) for m in marks)
        cut = at if at >= int(limit * least) else limit
        out.append((start, start + cut))
        start += cut
    if start < len(text) or not out:
        out.append((start, len(text)))
    return out


def chunks(text: str, limit: int) -> list[tuple[str, list[str], int, int]]:
    """(text, heading path, start, end): neighbouring blocks up to ``limit`` characters; a heading opens a chunk."""
    out: list[tuple[str, list[str], int, int]] = []
    path: list[tuple[int, str]] = []
    held: tuple[int, int] | None = None

    def emit() -> None:
        nonlocal held
        if held is None:
            return
        start, end = held
        for a, b in cut_text(text[start:end], limit):
            piece = text[start + a : start + b]
            if piece.strip():
                out.append((piece, [t for _, t in path], start + a, start + b))
        held = None

    for kind, body, start, end, level in blocks(text):
        if kind == "heading":
            emit()
            path = [(n, t) for n, t in path if n < level] + [(level, body.lstrip("#").strip())]
            held = (start, end)
        elif held and end - held[0] > limit:
            emit()
            held = (start, end)
        else:
            held = (held[0] if held else start, end)
    emit()
    return out


def evidence(text: str, limit: int = 600) -> list[str]:
    """Quotes of at most ``limit`` characters; a cut falls after the last boundary, fences and table rules are left out."""
    out = []
    for kind, body, *_ in blocks(text):
        if kind == "code":
            continue
        for line in body.split("\n"):
            line = line.strip()
            if _RULE.match(line) or not re.search(r"[^\W_]", line):
                continue
            while len(line) > limit:
                at = max(line.rfind(m, int(limit * 0.6), limit) for m in "。！？.!?;,")
                cut = at + 1 if at > 0 else limit
                out.append(line[:cut].strip())
                line = line[cut:].strip()
            if line:
                out.append(line)
    return out


#: Items go back from Python in packs of about this many characters of text, and of no more rows.
PACK_CHARS, PACK_ROWS = 1 << 20, 10_000


def per_document(docs: DataFrame, id_col: str, text_col: str, work: Callable[[str], list[tuple]], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """Run a text machine on every text: (id, ordinal, fields), one row per item it makes.

    A worker holds an Arrow batch, one text with its items and the pack that they fill.
    """
    schema = pa.schema([(id_col, pa.int64()), ("ordinal", pa.int64()), *((n, t) for n, _, t in fields)])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=f.type) for c, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for batch in batches:
            for i, value in zip(batch.column(0), batch.column(1), strict=True):
                i, text = i.as_py(), value.as_py() or ""
                for k, item in enumerate(work(text)):
                    rows.append((i, k, *item))
                    if len(rows) >= PACK_ROWS:
                        yield packed(rows)
                        rows, chars = [], 0
                chars += len(text)
                if rows and chars >= PACK_CHARS:
                    yield packed(rows)
                    rows, chars = [], 0
        if rows:
            yield packed(rows)

    bound_batches(docs.sparkSession)
    ddl = f"`{id_col}` long, ordinal long, " + ", ".join(f"{n} {k}" for n, k, _ in fields)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ddl)


def document_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    fields = [("kind", "string", pa.string()), ("text", "string", pa.string()), ("start_offset", "long", pa.int64()), ("end_offset", "long", pa.int64()), ("level", "int", pa.int32())]
    return per_document(docs, id_col, text_col, blocks, fields)


def document_chunks(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    fields = [("text", "string", pa.string()), ("heading_path", "array<string>", pa.list_(pa.string())), ("start_offset", "long", pa.int64()), ("end_offset", "long", pa.int64())]
    made = per_document(docs, id_col, text_col, lambda t: chunks(t, limit), fields)
    return made.withColumns({"token_estimate": F.ceil(F.length("text") / 4), "content_hash": F.sha2("text", 256)})


def pack(rows: DataFrame, group_col: str, order_col: str, size_col: str, limit: int) -> DataFrame:
    """Greedy batches in order: (group, order, size, batch from 1); a row alone may pass the limit.

    The fold is one aggregate over a group's ordered sizes, so a group meets in one
    row; groups are tasks, bounded by what one task may hold.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(size_col).alias("s"))))
    start = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<o:bigint,s:bigint,b:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a["batch"] == 0) | (a["used"] + x["s"] > limit)
        batch = a["batch"] + new.cast("long")
        item = F.struct(x["o"].cast("long").alias("o"), x["s"].cast("long").alias("s"), batch.alias("b"))
        return F.struct(batch.alias("batch"), (F.when(new, 0).otherwise(a["used"]) + x["s"]).cast("long").alias("used"), F.concat(a["out"], F.array(item)).alias("out"))

    packed = rows.groupBy(group_col).agg(F.aggregate(ordered, start, step)["out"].alias("p"))
    return packed.select(group_col, F.explode("p").alias("p")).select(group_col, F.col("p.o").alias(order_col), F.col("p.s").alias(size_col), F.col("p.b").alias("batch"))
