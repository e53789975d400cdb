"""Segments into chunks: fixed, hierarchical and semantic strategies, validation, adaptive overlap.

One fold over a document's ordered segments does the greedy packing of all three.  It
is an ``aggregate`` inside the JVM; a document's segments meet in one row, as the
packing needs them in order, and documents are dealt by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.vectors import cut_cosine

ALONE = ("table", "code")
_CHUNK = "struct<content:string,content_type:string,segment_ids:array<string>,pages:array<int>,section_title:string,heading_level:int>"


def _ordered(segments: DataFrame, *keys: str) -> DataFrame:
    fields = F.struct("seg_idx", "seg_id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("content_type", F.lit("text")).alias("content_type"), F.coalesce("page_num", F.lit(0)).alias("page_num"), "section_title", F.coalesce("heading_level", F.lit(0)).alias("heading_level"))
    return segments.groupBy(*keys).agg(F.array_sort(F.collect_list(fields)).alias("segs"))


def _chunk(content: Column, kind: Column, ids: Column, pages: Column, title: Column, level: Column) -> Column:
    return F.struct(content.alias("content"), kind.alias("content_type"), ids.alias("segment_ids"), pages.alias("pages"), title.alias("section_title"), level.alias("heading_level")).cast(_CHUNK)


def pack(segs: Column, size: int, overlap: int, separator: str) -> Column:
    """Greedy packing: an array of chunks.

    A text segment that would overfill a non-empty buffer flushes it first; the next
    buffer then begins with the last ``overlap`` characters (segment ids and pages
    go on).  Tables and code flush and stand alone.  A flushed chunk takes title and
    level of the segment that flushed it, the last chunk those of the last segment.
    Lengths count contents without separators.
    """
    none_i, none_s = F.array().cast("array<int>"), F.array().cast("array<string>")
    state = lambda buf, n, ids, pages, kind, out: F.struct(buf.alias("buf"), n.cast("int").alias("n"), ids.alias("ids"), pages.alias("pages"), kind.cast("string").alias("kind"), out.alias("out"))
    start = state(F.lit(""), F.lit(0), none_s, none_i, F.lit(None), F.array().cast(f"array<{_CHUNK}>"))
    flushed = lambda a, s: F.array_append(a["out"], _chunk(a["buf"], F.coalesce(a["kind"], F.lit("text")), a["ids"], a["pages"], s["section_title"], s["heading_level"]))

    def step(a: Column, s: Column) -> Column:
        closed = F.when(a["buf"] != "", flushed(a, s)).otherwise(a["out"])
        single = F.array_append(closed, _chunk(s["content"], s["content_type"], F.array(s["seg_id"]), F.array(s["page_num"]), s["section_title"], s["heading_level"]))
        # What was not flushed (an empty buffer) keeps its ids, as nothing carried them away.
        alone = state(F.lit(""), F.lit(0), F.when(a["buf"] != "", none_s).otherwise(a["ids"]), F.when(a["buf"] != "", none_i).otherwise(a["pages"]), F.when(a["buf"] == "", a["kind"]), single)
        tail = F.right(a["buf"], F.lit(overlap)) if overlap else F.lit("")
        over = (a["n"] + F.length(s["content"]) > size) & (a["buf"] != "")
        if overlap:
            fresh = tail == ""
        else:
            fresh = F.lit(True)
        keep_ids = bool(overlap) or separator == ""
        begun = state(
            F.concat(tail, s["content"]), F.length(tail) + F.length(s["content"]),
            F.array_append(a["ids"], s["seg_id"]) if keep_ids else F.array(s["seg_id"]),
            F.array_append(a["pages"], s["page_num"]) if keep_ids else F.array(s["page_num"]),
            F.when(fresh, s["content_type"]).otherwise(a["kind"]), flushed(a, s))
        more = state(
            F.when(a["buf"] == "", s["content"]).otherwise(F.concat(a["buf"], F.lit(separator), s["content"])), a["n"] + F.length(s["content"]),
            F.array_append(a["ids"], s["seg_id"]), F.array_append(a["pages"], s["page_num"]),
            F.when(a["buf"] == "", s["content_type"]).otherwise(a["kind"]), a["out"])
        return F.when(s["content_type"].isin(*ALONE), alone).when(over, begun).otherwise(more)

    last = F.element_at(segs, -1)
    return F.aggregate(segs, start, step, lambda a: F.when(a["buf"] != "", flushed(a, last)).otherwise(a["out"]))


def _finish(chunks: DataFrame, strategy: str) -> DataFrame:
    """Columns of the chunk table; ids follow from document, strategy, place and content."""
    page = F.floor(F.aggregate("c.pages", F.lit(0), lambda s, p: s + p) / F.greatest(F.size("c.pages"), F.lit(1))).cast("int")
    key = F.concat_ws("|", F.col("doc_id"), F.lit(strategy), F.col("chunk_index").cast("string"), F.col("c.content"))
    return chunks.select(F.sha2(key, 256).alias("chunk_id"), "doc_id", "chunk_index", F.col("c.content").alias("content"), F.col("c.content_type").alias("content_type"), F.col("c.segment_ids").alias("segment_ids"), page.alias("page_num"), F.col("c.section_title").alias("section_title"), F.col("c.heading_level").alias("heading_level"))


def fixed(segments: DataFrame, config: ChunkConfig) -> DataFrame:
    packed = _ordered(segments, "doc_id").select("doc_id", F.posexplode(pack(F.col("segs"), config.chunk_size, config.overlap, "")).alias("chunk_index", "c"))
    return _finish(packed, "fixed")


NO_SECTION = "_no_section_"


def with_sections(segments: DataFrame) -> DataFrame:
    """Blank titles take the one before; before any title the section has a name of its own."""
    w = Window.partitionBy("doc_id").orderBy("seg_idx")
    title = F.when(F.col("section_title").rlike(r"\S"), F.col("section_title"))
    return segments.withColumn("section", F.coalesce(F.last(title, ignorenulls=True).over(w), F.lit(NO_SECTION)))


def hierarchical(segments: DataFrame, config: ChunkConfig) -> DataFrame:
    """A section that fits is one chunk, whatever it holds; others are packed without overlap.

    Sections of one title in a document are one section, in order of first appearance.
    """
    grouped = _ordered(with_sections(segments), "doc_id", "section")
    segs = F.col("segs")
    total = F.aggregate(segs, F.lit(0), lambda n, s: n + F.length(s["content"]))
    special = F.filter(segs, lambda s: s["content_type"].isin(*ALONE))
    title = F.when(F.col("section") == NO_SECTION, F.lit(None).cast("string")).otherwise(F.col("section"))
    level = segs[0]["heading_level"]
    whole = _chunk(F.array_join(F.transform(segs, lambda s: s["content"]), "\n"), F.when(F.size(special) > 0, F.element_at(special, -1)["content_type"]).otherwise("text"), F.transform(segs, lambda s: s["seg_id"]), F.transform(segs, lambda s: s["page_num"]), title, level)
    parts = F.transform(pack(segs, config.chunk_size, 0, "\n"), lambda c: _chunk(c["content"], c["content_type"], c["segment_ids"], c["pages"], title, level))
    made = grouped.select("doc_id", segs[0]["seg_idx"].alias("first"), F.when(total <= config.chunk_size, F.array(whole)).otherwise(parts).alias("parts"))
    whole_doc = made.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "parts"))), lambda s: s["parts"])).alias("cs"))
    return _finish(whole_doc.select("doc_id", F.posexplode("cs").alias("chunk_index", "c")), "hierarchical")


def semantic_groups(segments: DataFrame, config: ChunkConfig) -> DataFrame:
    """``(doc_id, group_index, group_text, c)``: packed groups whose text is to be embedded."""
    packed = _ordered(segments, "doc_id").select("doc_id", F.posexplode(pack(F.col("segs"), config.chunk_size, 0, "\n")).alias("group_index", "c"))
    return packed.withColumn("group_text", F.replace(F.col("c.content"), F.lit("\n"), F.lit(" ")))


def semantic_islands(vectors: DataFrame, threshold: float = 0.7, doc_col: str = "doc_id", order_col: str = "group_index", vector_col: str = "vector") -> DataFrame:
    """Add ``sim`` to the previous group and ``island``, which rises where that is below ``threshold``."""
    w = Window.partitionBy(doc_col).orderBy(order_col)
    sim = cut_cosine(F.lag(vector_col).over(w), F.col(vector_col))
    return vectors.withColumn("sim", sim).withColumn("island", F.sum((F.col("sim") < threshold).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def semantic(segments: DataFrame, config: ChunkConfig, embed: Callable[[DataFrame], DataFrame] | None = None, threshold: float = 0.7) -> DataFrame:
    """Merge neighbouring groups whose embeddings are close; merged chunks have no size limit.

    ``embed`` adds a column ``vector`` computed from ``group_text``.  Without it the
    fixed strategy is used.
    """
    if embed is None:
        return fixed(segments, config)
    islands = semantic_islands(embed(semantic_groups(segments, config)), threshold)
    merged = islands.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("group_index", "c"))).alias("g"))
    cs = F.transform("g", lambda s: s["c"])
    titled = F.filter(cs, lambda c: c["section_title"].isNotNull())
    special = F.filter(cs, lambda c: c["content_type"].isin(*ALONE))
    last = F.try_element_at(titled, F.lit(-1))
    one = _chunk(F.array_join(F.transform(cs, lambda c: c["content"]), "\n"), F.coalesce(F.try_element_at(special, F.lit(-1))["content_type"], F.lit("text")), F.flatten(F.transform(cs, lambda c: c["segment_ids"])), F.flatten(F.transform(cs, lambda c: c["pages"])), last["section_title"], last["heading_level"])
    return _finish(merged.select("doc_id", F.col("island").cast("int").alias("chunk_index"), one.alias("c")), "semantic")


STRATEGIES: dict[str, Callable[[DataFrame, ChunkConfig], DataFrame]] = {"fixed": fixed, "hierarchical": hierarchical, "semantic": semantic}


def valid(chunks: DataFrame, min_chunk: int = 50) -> DataFrame:
    """Drop null, blank and short chunks; places are not renumbered."""
    return chunks.where(F.col("content").rlike(r"\S") & (F.length("content") >= min_chunk))


def chunk(segments: DataFrame, config: ChunkConfig | None, **options) -> DataFrame:
    """Chunk by the configured strategy, then validate."""
    if config is None or not config.strategy:
        raise ValueError("a chunking strategy must be named")
    if config.strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {config.strategy!r}; known are {sorted(STRATEGIES)}")
    return valid(STRATEGIES[config.strategy](segments, config, **options), config.min_chunk)


def adaptive_overlap(chunks: DataFrame, overlap: int = 128) -> DataFrame:
    """Add the overlap each chunk should have: none around tables, code and very short chunks, more for long ones."""
    n = F.length("content")
    own = F.when(F.col("content_type").isin(*ALONE) | (n < 100), 0).when(n > 1000, F.least(F.lit(overlap), F.lit(256))).otherwise(overlap)
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumn("own", own).withColumn("overlap", F.when(F.lead("own").over(w) == 0, 0).otherwise(F.col("own"))).drop("own").withColumn("adaptive", F.lit(True))
