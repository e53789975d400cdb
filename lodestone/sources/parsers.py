"""Parsers of single files: Markdown, DOCX, PDF and plain text.  Each yields segment rows of one file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

# What Markdown headings, fences and pipe tables look like, and which style names are headings.
HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
FENCE = re.compile(r"```(\w*)\n([\s\S]*?)```")
PIPE_TABLE = re.compile(r"^\|.+\|[ \t]*\n^\|[-: ]+\|[-: |]*\n(?:^\|.+\|[ \t]*\n?)*", re.M)
HEADING_STYLES = ("heading", "标题")
#: Shares of a page's height that running heads and feet take.
HEAD, FOOT = 0.08, 0.92

Segment = dict
Parsed = tuple[dict, list[Segment]]


def _row(content: str, kind: str = "text", **more) -> Segment:
    return {"content": content, "content_type": kind, "page_num": 0, "section_title": None, "heading_level": 0, "table_markdown": None, "metadata": {}} | more


def parse_markdown(data: bytes, dedupe_blocks: bool = False) -> Parsed:
    """Code, then tables, then sections.

    Fences and tables are taken out first, so nothing in them is a heading, and stand
    again in the text of their section (unless ``dedupe_blocks``), code without its
    fence.  Text before the first heading is dropped where there is one.  A section
    keeps its heading line but for the last, which is dropped if nothing else is in it.
    """
    held: dict[str, str] = {}
    code: list[Segment] = []
    tables: list[Segment] = []

    def take_code(m: re.Match) -> str:
        key = f"\x00c{len(code)}\x00"
        held[key] = "" if dedupe_blocks else m[2]
        code.append(_row(m[2], "code", metadata={"language": m[1] or "plaintext"}))
        return key

    def take_table(m: re.Match) -> str:
        key = f"\x00t{len(tables)}\x00"
        held[key] = "" if dedupe_blocks else m[0]
        tables.append(_row(m[0].strip(), "table", table_markdown=m[0].strip()))
        return key

    text = PIPE_TABLE.sub(take_table, FENCE.sub(take_code, data.decode("utf-8", "replace").replace("\x00", "")))
    restore = lambda s: re.sub("\x00[ct]\\d+\x00", lambda m: held[m[0]], s)
    heads = list(HEADING.finditer(text))
    if not heads:
        whole = restore(text.strip())
        return {}, code + tables + ([_row(whole)] if whole.strip() else [])
    sections = []
    for k, h in enumerate(heads):
        last = k == len(heads) - 1
        body = text[h.end() if last else h.start() : len(text) if last else heads[k + 1].start()].strip()
        body = restore(body)
        if body.strip():
            sections.append(_row(body, section_title=h[2].strip(), heading_level=len(h[1])))
    return {}, code + tables + sections


def markdown_table(rows: list[list[str]]) -> str:
    """First row as head, then a rule; shorter rows are padded."""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def style_level(name: str | None) -> int:
    """Heading level by the style's name: its number, 1 without one, 0 for other styles."""
    low = (name or "").lower()
    if not low.startswith(HEADING_STYLES):
        return 0
    digits = re.sub(r"\D", "", low)
    return int(digits) if digits else 1


def parse_docx(data: bytes) -> Parsed:
    """Paragraphs and tables in the body's order; what follows a heading has its title and level."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        names = z.namelist()
        styles = {}
        if "word/styles.xml" in names:
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{w}style"):
                n = s.find(f"{w}name")
                styles[s.get(f"{w}styleId")] = n.get(f"{w}val") if n is not None else None
        meta = {}
        if "docProps/core.xml" in names:
            author = ElementTree.fromstring(z.read("docProps/core.xml")).find("{http://purl.org/dc/elements/1.1/}creator")
            if author is not None and author.text:
                meta["author"] = author.text
    said = lambda p: "".join(t.text or "" for t in p.iter(f"{w}t"))
    title, level, out = None, 0, []
    for e in body if body is not None else ():
        if e.tag == f"{w}p":
            text = said(e).strip()
            if not text:
                continue
            style = e.find(f"{w}pPr/{w}pStyle")
            ref = style.get(f"{w}val") if style is not None else None
            found = style_level(styles.get(ref) or ref)
            if found:
                title, level = text, found
            out.append(_row(text, section_title=title, heading_level=level))
        elif e.tag == f"{w}tbl":
            rows = [[" ".join(t for p in c.iter(f"{w}p") if (t := said(p).strip())) for c in r.findall(f"{w}tc")] for r in e.findall(f"{w}tr")]
            rows = [r for r in rows if r]
            if rows:
                md = markdown_table(rows)
                out.append(_row(md, "table", section_title=title, heading_level=level, table_markdown=md))
    return meta, out


def keep_glyph(y: float, height: float) -> bool:
    """Whether a glyph at ``y`` from the top lies outside running heads and feet."""
    return HEAD * height <= y <= FOOT * height


def pdf_blocks(page_num: int, text: str) -> list[Segment]:
    """Blocks of a page's text, parted by blank lines; tables and headings recognised."""
    out = []
    for block in (b.strip() for b in re.split(r"\n{2,}", text)):
        if not block:
            continue
        grid = [re.split(r"[ \t]{2,}", line.strip()) for line in block.split("\n")]
        head = re.match(r"(#{1,4}) (.*)", block.split("\n")[0].strip())
        title = head[2].strip() if head else None
        if sum(len(r) >= 3 for r in grid) >= 2:
            md = "".join("| " + "".join(f"{c.strip()} | " for c in r) + "\n" + ("|" + " --- |" * len(r) + "\n" if k == 0 else "") for k, r in enumerate(grid))
            out.append(_row(block, "table", page_num=page_num, section_title=title, heading_level=len(head[1]) if head else 0, table_markdown=md))
        else:
            out.append(_row(block, page_num=page_num, section_title=title, heading_level=len(head[1]) if head else 0))
    return out


def parse_pdf(data: bytes) -> Parsed:
    """Pages through the optional library ``pypdf``; a page that fails becomes a segment that says so."""
    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(data))
    meta = {"pages": str(len(reader.pages))}
    if reader.metadata and reader.metadata.author:
        meta["author"] = reader.metadata.author
    if reader.metadata and reader.metadata.creation_date:
        meta["created_at"] = reader.metadata.creation_date.isoformat()
    out: list[Segment] = []
    for k, page in enumerate(reader.pages, 1):
        try:
            height = float(page.mediabox.height)
            parts: list[str] = []

            def visit(text, cm, tm, font, size, parts=parts, height=height):
                if keep_glyph(height - tm[5], height):
                    parts.append(text)

            page.extract_text(visitor_text=visit)
            out += pdf_blocks(k, "".join(parts))
        except Exception as e:  # noqa: BLE001 - one bad page must not lose the others
            out.append(_row(f"page {k} could not be read: {e}", page_num=k))
    return meta, out


def parse_text(data: bytes) -> Parsed:
    text = data.decode("utf-8", "replace").strip()
    return {}, [_row(text)] if text else []


PARSERS: dict[str, Callable[[bytes], Parsed]] = {"MARKDOWN": parse_markdown, "DOCX": parse_docx, "PDF": parse_pdf, "PLAIN_TEXT": parse_text}


def parse_file(kind: str, data: bytes | None, parsers: dict[str, Callable[[bytes], Parsed]] | None = None) -> Iterator[dict]:
    """Segments of one file, or one row with ``error``; nothing is raised."""
    parser = (PARSERS if parsers is None else parsers).get(kind)
    if data is None:
        yield {"error": "no content"}
    elif parser is None:
        yield {"error": f"no parser for {kind}"}
    else:
        try:
            meta, segments = parser(bytes(data))
        except Exception as e:  # noqa: BLE001 - permissive: the row carries the error
            yield {"error": f"{type(e).__name__}: {e}"}
            return
        for k, s in enumerate(segments):
            yield s | {"seg_idx": k, "metadata": s["metadata"] | meta, "error": None}
