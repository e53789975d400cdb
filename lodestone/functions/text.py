"""Cleaning and measuring text: Column to Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that trimming removes (U+0000 to U+0020), and the patterns of the cleaner.
BLANKS = "".join(map(chr, range(0x21)))
HEADER_FOOTER = r"(?mi)^(\d+\s*[-–]\s*\d+|第\s*\d+\s*页|Page\s+\d+\s+of\s+\d+|©|Copyright|版权所有).*$"
TOC_START = r"(?mi)^\s*目[录録]|^\s*CONTENTS|^\s*Table\s+of\s+Contents"
TOC_LINE = r"^\s*([第\d一二三四五六七八九十百千]+[章节篇部]|\d{1,2}\.\d{1,2}\.?\d{0,2}|•)\s.*\.{2,}\s*\d+\s*$"
CONTROL = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}]"
CJK = r"[\x{4E00}-\x{9FFF}]"

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def _lines(c: Column) -> Column:
    """Lines without trailing empty ones (one empty line for an empty text)."""
    return F.split(F.regexp_replace(c, r"\n+\z", ""), "\n")


def _joined(lines: Column) -> Column:
    """Each line ended by a line feed."""
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def remove_headers_footers(c: Column | str) -> Column:
    """Blank out lines that begin like page numbers, copyright notices and running heads; their line feeds stay."""
    return F.regexp_replace(text_or_empty(c), HEADER_FOOTER, "")


def _bind(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, not once for each element that ``then`` looks at."""
    return F.element_at(F.transform(F.array(value), then), 1)


def remove_toc(c: Column | str) -> Column:
    """Cut the first table of contents: its title and the blank or dotted lines after it.

    With ``start`` the first title and ``stop`` the first other line behind it, what
    stays is every line before the one and from the other on.  A line is judged
    once, so the cost is linear in the text.
    """

    def cut(t: Column) -> Column:
        marks = F.transform(t, lambda x: F.struct(x.alias("line"), x.rlike(TOC_START).alias("title"), ((trimmed(x) != "") & ~x.rlike(TOC_LINE)).alias("other")))
        return _bind(marks, lambda m: _bind(F.array_position(F.transform(m, lambda x: x["title"]), True), lambda start: kept(m, start)))

    def kept(m: Column, start: Column) -> Column:
        stop = F.array_position(F.transform(m, lambda x, i: ((i + 1) > start) & x["other"]), True)
        lines = F.transform(m, lambda x: x["line"])
        behind = _bind(F.when(stop > 0, stop).otherwise(F.size(m) + 1), lambda last: F.concat(F.slice(lines, F.lit(1), (start - 1).cast("int")), F.slice(lines, last.cast("int"), F.size(lines))))
        return F.when(start > 0, behind).otherwise(lines)

    return F.when(_col(c).isNull(), "").otherwise(_joined(_bind(_lines(text_or_empty(c)), cut)))


def remove_duplicate_lines(c: Column | str) -> Column:
    """Keep the first of lines that are equal after trimming, anywhere in the text; blank lines all stay.

    The lines' places are sorted by key, so that equal lines are neighbours, and what is kept is sorted
    back: n log n in the lines of a text.
    """

    def firsts(z: Column) -> Column:
        by_key = F.array_sort(F.transform(z, lambda x, i: F.struct(x["key"].alias("key"), i.alias("i"))))
        return _bind(by_key, lambda o: _bind(kept(o), lambda places: F.transform(places, lambda i: F.get(z, i)["line"])))

    def kept(o: Column) -> Column:
        first = F.filter(o, lambda x, j: (x["key"] == "") | (j == 0) | (x["key"] != F.element_at(o, F.greatest(j, F.lit(1)))["key"]))
        return F.array_sort(F.transform(first, lambda x: x["i"]))

    keyed = F.transform(_lines(text_or_empty(c)), lambda x: F.struct(x.alias("line"), trimmed(x).alias("key")))
    return F.when(_col(c).isNull(), "").otherwise(_joined(_bind(keyed, firsts)))


def normalize(c: Column | str) -> Column:
    """Narrow full-width forms, drop control characters, and shorten runs of line feeds and of spaces."""
    narrow = F.translate(text_or_empty(c), _WIDE, _NARROW)
    plain = F.regexp_replace(narrow, CONTROL, "")
    return trimmed(F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def clean(c: Column | str) -> Column:
    """Headers, contents, repeated lines, white space, in this order; null becomes empty."""
    return normalize(remove_duplicate_lines(remove_toc(remove_headers_footers(c))))


def remove_duplicate_lines_long(df: DataFrame, text_col: str, key_col: str) -> DataFrame:
    """``remove_duplicate_lines`` for very long texts: lines as rows, n log n instead of n squared.

    ``key_col`` must identify a row.  Returns ``(key, text)``.
    """
    lines = df.select(key_col, F.posexplode(_lines(text_or_empty(text_col))).alias("i", "line")).withColumn("t", trimmed("line"))
    first = lines.groupBy(key_col, "t").agg(F.min("i").alias("first"))
    kept = lines.join(first, [key_col, "t"]).where("t = '' OR i = first")
    return kept.groupBy(key_col).agg(_joined(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"])).alias(text_col))


def clean_segments(segments: DataFrame, preserve_code: bool = False) -> DataFrame:
    """Clean every segment's content and drop those that become blank.

    By default tables and code are cleaned like prose; ``preserve_code`` spares them.
    """
    cleaned = clean("content")
    if preserve_code:
        cleaned = F.when(F.col("content_type").isin("code", "table"), F.col("content")).otherwise(cleaned)
    return segments.withColumn("content", cleaned).where(F.col("content").rlike(r"\S"))


def file_type(name: Column | str) -> Column:
    """Document type by what follows the last dot; a name that is only an extension is unknown."""
    ext = F.lower(F.regexp_extract(text_or_empty(name), r"(?s)^.+\.([^.]*)$", 1))
    kinds = {"pdf": "PDF", "docx": "DOCX", "pptx": "PPTX", "md": "MARKDOWN", "markdown": "MARKDOWN", "txt": "PLAIN_TEXT", "html": "HTML", "htm": "HTML", "png": "IMAGE", "jpg": "IMAGE", "jpeg": "IMAGE", "gif": "IMAGE", "bmp": "IMAGE", "tiff": "IMAGE"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), ext), F.lit("UNKNOWN"))


def estimate_tokens(c: Column | str) -> Column:
    """floor(CJK characters / 1.5) + words + floor(characters / 10); CJK characters do not end a word."""
    t = text_or_empty(c)
    cjk = F.length(t) - F.length(F.regexp_replace(t, CJK, ""))
    w = F.size(F.regexp_extract_all(F.regexp_replace(t, CJK, ""), F.lit(r"\p{L}+"), F.lit(0)))
    return (F.floor(cjk / 1.5) + w + F.floor(F.length(t) / 10)).cast("long")


def overlap_ratio(a: Column | str, b: Column | str, least_step: int = 1) -> Column:
    """Share of the shorter text whose sampled windows occur in the longer.

    Windows are a hundredth of the shorter text, but ``least_step`` characters at
    least: 1 compares single characters of short texts, 8 avoids false duplicates.
    """
    x, y = text_or_empty(a), text_or_empty(b)

    def sides(t: Column) -> Column:
        first = t["m"] <= t["n"]
        return F.struct(F.when(first, t["x"]).otherwise(t["y"]).alias("short"), F.when(first, t["y"]).otherwise(t["x"]).alias("long"), F.least(t["m"], t["n"]).alias("n"))

    def ratio(t: Column) -> Column:
        n = t["n"]
        return _bind(F.least(n, F.greatest(F.lit(least_step), F.floor(n / 100).cast("int"))), lambda step: share(t, n, step))

    def share(t: Column, n: Column, step: Column) -> Column:
        hits = F.aggregate(F.sequence(F.lit(0), n - step, step), F.lit(0), lambda m, i: m + F.when(F.contains(t["long"], F.substring(t["short"], i + 1, step)), step).otherwise(0))
        covered = n if least_step == 1 else F.floor(n / step) * step
        return F.when(n == 0, 0.0).otherwise(hits / covered)

    # Texts and lengths are bound, so that they are not worked out again for each window.
    return _bind(F.struct(x.alias("x"), y.alias("y"), F.length(x).alias("m"), F.length(y).alias("n")), lambda t: _bind(sides(t), ratio))


def terms(c: Column | str) -> Column:
    """Search terms: lower-cased runs of letters and digits, every Han character a term of its own."""
    spaced = F.regexp_replace(F.lower(text_or_empty(c)), r"(\p{IsHan})", " $1 ")
    return F.regexp_extract_all(spaced, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fingerprint(c: Column | str) -> Column:
    """MD5 of the bytes or UTF-8 text; null gives the empty string."""
    return F.coalesce(F.md5(_col(c)), F.lit(""))
