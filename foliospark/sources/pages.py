"""Wiki pages: frontmatter, masked contexts, links, sections and their edits."""

from __future__ import annotations

import json
import re

from ..functions.text import PAGE_KIND_DIRS

_FENCE = re.compile(r"^(\s{0,3})(`{3,}|~{3,})")


def frontmatter(text: str) -> tuple[dict[str, object], str]:
    """Fields (scalars and JSON arrays) and the body of a page."""
    m = re.match(r"(?s)\A---\n(.*?)\n---\n?", text)
    if not m:
        return {}, text
    fields: dict[str, object] = {}
    for line in m[1].split("\n"):
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[A-Za-z_][\w-]*", name.strip()):
            continue
        value = value.strip()
        try:
            fields[name.strip()] = json.loads(value) if value[:1] in '["' else value
        except ValueError:
            fields[name.strip()] = value
    return fields, text[m.end() :]


def mask(text: str) -> str:
    """The text with frontmatter, comments, code, quotes and inline code blanked; offsets stay."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    out = re.sub(r"(?s)\A---\n.*?\n---(?=\n|\Z)", blank, text)
    out = re.sub(r"(?s)<!--.*?-->", blank, out)
    out = re.sub(r"(?is)<(pre|code)\b.*?</\1\s*>", blank, out)
    lines, fence = [], None
    for line in out.split("\n"):
        m = _FENCE.match(line)
        if fence:
            lines.append(" " * len(line))
            if m and m[2][0] == fence[0] and len(m[2]) >= len(fence) and not line[m.end() :].strip():
                fence = None
        elif m:
            fence = m[2]
            lines.append(" " * len(line))
        elif re.match(r"^(?: {4}|\t| {0,3}>)", line):
            lines.append(" " * len(line))
        else:
            lines.append(line)
    return re.sub(r"(`+)(?!`)[^\n]*?(?<!`)\1(?!`)", blank, "\n".join(lines))


def wiki_links(text: str) -> list[str]:
    return [m.strip() for m in re.findall(r"\[\[([^\]|]+)", mask(text))]


def sections(text: str) -> list[tuple[str, int, int, int]]:
    """(heading, level, start, end): a section ends where one of its level or above begins."""
    heads = [(m[2].strip(), len(m[1]), m.start()) for m in re.finditer(r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*$", mask(text))]
    out = []
    for k, (name, level, start) in enumerate(heads):
        end = next((s for _, n, s in heads[k + 1 :] if n <= level), len(text))
        out.append((name, level, start, end))
    return out


def edit_section(text: str, operation: str, heading: str, content: str = "", level: int = 2) -> str:
    """Upsert, replace, append to or remove one section; an ambiguous or missing heading is an error."""
    found = [s for s in sections(text) if s[0] == heading]
    if len(found) > 1:
        raise ValueError(f"heading is not unique: {heading}")
    if not found:
        if operation == "upsert":
            return f"{text.rstrip()}\n\n{'#' * level} {heading}\n\n{content.strip()}\n"
        raise ValueError(f"no such heading: {heading}")
    _, own, start, end = found[0]
    line_end = text.find("\n", start)
    line_end = len(text) if line_end < 0 else line_end
    if operation == "remove":
        return (text[:start].rstrip() + "\n\n" + text[end:].lstrip("\n")).rstrip() + "\n"
    if operation == "append":
        body = text[line_end:end].strip("\n") + ("\n\n" if text[line_end:end].strip() else "") + content.strip()
    elif operation in ("upsert", "replace"):
        body = content.strip()
    else:
        raise ValueError(f"unknown operation: {operation}")
    return text[:line_end] + "\n\n" + body + "\n" + ("\n" + text[end:] if end < len(text) else "")


def table_cells(row: str) -> list[str]:
    """Cells of a Markdown table row, trimmed; an escaped pipe belongs to its cell."""
    inner = row.strip()[1:-1]
    return [cell.strip().replace("\\|", "|") for cell in re.split(r"(?<!\\)\|", inner)]


def split_sections(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at the last line break before it, or after 60 % where there is none later."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = max(text.rfind("\n", at, at + limit + 1), at + limit * 6 // 10)
        out.append(text[at:cut].strip())
        at = cut
        while at < len(text) and text[at].isspace():
            at += 1
    out.append(text[at:].strip())
    return [piece for piece in out if piece]


#: Folders of pages that links may name by a plain path.
_FOLDERS = frozenset(PAGE_KIND_DIRS.values())
_RELATED = re.compile(r"(?im)^#{2,6}\s+(?:related(?:\s+pages?)?|相关页面|关联页面)\s*$")


def _slug(link: str) -> str:
    link = re.sub(r"^\[\[|\]\]$", "", link.replace("\\", "/"))
    link = re.sub(r"(?i)\.md$", "", re.sub(r"(?i)^wiki/", "", link)).strip()
    return link.split("|")[0].strip()


def _page_path(link: str) -> str | None:
    """The slug of a relative path into a known folder, or None."""
    link = link.strip().strip("<>").strip("`").replace("\\", "/")
    link = re.sub(r"[?#].*", "", link).lstrip("/").removeprefix("./")
    if " " in link or re.match(r"(?i)[a-z][a-z\d+.-]*:", link):
        return None
    first, *rest = re.sub(r"(?i)^wiki/", "", link).split("/")
    if first.lower() not in _FOLDERS or not rest or any(part in ("", ".", "..") for part in rest):
        return None
    return _slug("/".join([first.lower(), *rest]))


def related_references(text: str) -> list[str]:
    """Pages that a text refers to, first occurrence first: wiki links, Markdown links to pages, and plain paths listed under Related."""
    shown = mask(text.replace("\r\n", "\n").replace("\r", "\n"))
    found = [_slug(m) for m in re.findall(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", shown)]
    found += [_page_path(m) for m in re.findall(r"\[[^\]]*\]\(\s*<?([^\s)>]+)>?(?:\s+[\"'][^\"']*[\"'])?\s*\)", shown)]
    if head := _RELATED.search(shown):
        body = re.split(r"(?m)^#{1,6}\s+", shown[head.end() :], maxsplit=1)[0]
        items = re.findall(r"(?m)^\s*[-*+]\s+(.+?)\s*$", body)
        found += [_page_path(item) for item in items if not re.match(r"\[\[|\[[^\]]*\]\(", item)]
    return list(dict.fromkeys(f for f in found if f))


def overlapping_sections(text: str, headings: list[str]) -> list[tuple[str, str]]:
    """(outer, inner) of the asked sections that lie within each other."""
    asked = {h.strip().lower() for h in headings}
    held = [s for s in sections(text) if s[0].lower() in asked]
    return [(a[0], b[0]) for k, a in enumerate(held) for b in held[k + 1 :] if b[2] < a[3]] if len(asked) > 1 else []


def draft_excerpt(text: str, limit: int, owned: frozenset[str] = frozenset({"related", "sources", "domain schema"})) -> dict[str, object]:
    """The first 65 % and the last 35 % of ``limit`` characters of a page, and which sections may be edited.

    A section may be edited if it is shown whole and its heading is unique; sections
    that the library itself keeps (``owned``) are neither editable nor protected.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    own = [s for s in sections(text) if s[0].lower() not in owned]
    names = [s[0].lower() for s in own]
    head = limit * 65 // 100
    tail = max(1, limit - head)
    cut = len(text) > limit
    whole = lambda s: not cut or s[3] <= head or s[2] >= len(text) - tail
    editable = [s[0] for s in own if names.count(s[0].lower()) == 1 and whole(s)]
    shown = text if not cut else f"{text[:head]}\n\n<!-- the middle of this page is left out -->\n\n{text[-tail:]}"
    return {"content": shown, "truncated": cut, "chars": len(text), "editable": editable, "protected": [s[0] for s in own if s[0] not in editable]}
