"""Rows of text into segments, by Columns alone: lines, page blocks, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed


def _segments(rows: DataFrame, idx: Column, content: Column, kind: Column, page: Column, title: Column, level: Column, table: Column | None = None) -> DataFrame:
    out = rows.select(F.col("doc_id").cast("string").alias("doc_id"), idx.cast("int").alias("seg_idx"), content.alias("content"), kind.alias("content_type"), page.cast("int").alias("page_num"), title.cast("string").alias("section_title"), level.cast("int").alias("heading_level"), (table if table is not None else F.lit(None)).cast("string").alias("table_markdown"))
    return out.withColumn("seg_id", F.sha2(F.concat_ws("|", "doc_id", F.col("seg_idx").cast("string"), "content"), 256)).withColumn("metadata", F.create_map().cast("map<string,string>"))


def line_segments(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One text segment for each line that is not blank."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("i", "line")).where(F.col("line").rlike(r"\S"))
    return _segments(rows, F.col("i"), F.col("line"), F.lit("text"), F.lit(0), F.lit(None), F.lit(0))


def is_table(block: Column) -> Column:
    """Two lines or more that have three columns or more, columns parted by runs of blanks."""
    lines = F.split(F.regexp_replace(block, r"\n+\z", ""), "\n")
    columns = lambda x: F.size(F.split(trimmed(x), r"[ \t]{2,}"))
    return F.size(F.filter(lines, lambda x: columns(x) >= 3)) >= 2


def table_markdown(block: Column) -> Column:
    """The block as a Markdown table: first row, rule, other rows."""
    lines = F.split(F.regexp_replace(block, r"\n+\z", ""), "\n")

    def row(x: Column, i: Column) -> Column:
        cells = F.split(trimmed(x), r"[ \t]{2,}")
        body = F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.concat(trimmed(c), F.lit(" | "))), ""), F.lit("\n"))
        rule = F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.lit(" --- |")), ""), F.lit("\n"))
        return F.when(i == 0, F.concat(body, rule)).otherwise(body)

    return F.array_join(F.transform(lines, row), "")


def heading_level(block: Column) -> Column:
    """1 to 4 by the number signs before the first line's title, else 0."""
    return F.length(F.regexp_extract(trimmed(F.split(block, "\n")[0]), r"^(#{1,4}) ", 1))


def page_segments(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """``(doc_id, page_num, text)`` into blocks parted by blank lines; tables and headings recognised."""
    rows = pages.select("doc_id", "page_num", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n{2,}")).alias("i", "raw")).withColumn("block", trimmed("raw")).where(F.col("block") != "")
    from pyspark.sql import Window

    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "i")) - 1)
    table, level = is_table(F.col("block")), heading_level(F.col("block"))
    title = F.when(level > 0, trimmed(F.regexp_replace(trimmed(F.split("block", "\n")[0]), r"^#+", "")))
    return _segments(rows, F.col("idx"), F.col("block"), F.when(table, "table").otherwise("text"), F.col("page_num"), title, level, F.when(table, table_markdown(F.col("block"))))


def html_segments(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings, paragraphs and list items of HTML in their order; a heading titles what follows it."""
    from pyspark.sql import Window

    bare = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style|nav|footer)\b.*?</\1>|<!--.*?-->", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?(?=</?(?:h[1-6]|p|li|ul|ol|div|article|body)\b)"), F.lit(0))
    rows = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("i", "raw"))
    rows = rows.withColumn("tag", F.lower(F.regexp_extract("raw", r"(?is)^<([a-z]+[1-6]?)", 1)))
    plain = F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    rows = rows.withColumn("content", trimmed(plain)).where(F.col("content") != "")
    w = Window.partitionBy("doc_id").orderBy("i")
    level = F.regexp_extract("tag", r"^h([1-6])$", 1).try_cast("int")
    title = F.last(F.when(level.isNotNull(), F.col("content")), ignorenulls=True).over(w)
    above = F.coalesce(F.last(level, ignorenulls=True).over(w), F.lit(0))
    rows = rows.withColumn("title", title).withColumn("lvl", above)
    return _segments(rows, F.col("i"), F.col("content"), F.lit("text"), F.lit(0), F.col("title"), F.col("lvl"))
