"""Queries of the engine's own operators over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkConfig, RetrievalConfig, VectorIndexConfig
from ..functions import text as T
from ..operators import chunking, contains, context, evaluation, fusion, indexing, rerank, retrieval, textindex, validation, vectorindex
from ..sources import parsers, segments
from ..sources.files import parse_files
from ..streaming import sync
from .folders import new_folder
from .oracle import ORACLE_SQL  # noqa: F401 - part of this module's interface

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# Inputs in the engine's shapes -------------------------------------------------


def _plain(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks, without vectors."""
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "lang", "source")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks; the vector of the same number stands for a document's embedding."""
    docs = _plain(spark, sf)
    vectors = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return docs.join(vectors, "chunk_id", "left")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    items = _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    vectors = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items.join(vectors, "query_id", "left")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents; every fifth line opens a section, and every seventh is a table."""
    s = segments.line_segments(_read(spark, sf, "documents"))
    title = F.when(F.col("seg_idx") % 5 == 0, F.concat(F.lit("S"), ((F.col("seg_idx") / 5).cast("int") % 3).cast("string")))
    kind = F.when(F.col("seg_idx") % 7 == 6, "table").otherwise("text")
    return s.withColumn("section_title", title).withColumn("content_type", kind).withColumn("page_num", (F.col("seg_idx") / 4).cast("int")).withColumn("seg_id", F.concat_ws("-", "doc_id", F.col("seg_idx").cast("string")))


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    questions = _questions(spark, sf)
    found = retrieval.vector_topk(questions, _chunks(spark, sf), 20).unionByName(retrieval.bm25_topk(questions, _plain(spark, sf), 20))
    return found.select("query_id", F.col("source").alias("route"), F.col("rank").alias("pos"), "chunk_id")


def _stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, as what follows uses it several times."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    routes = _stored(_routes(spark, sf), "routes")
    fused = fusion.fuse(routes).select("query_id", F.lit("rrf").alias("route"), F.col("rank").alias("pos"), "chunk_id")
    return routes.unionByName(fused)


def _qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Items and the documents that contain them."""
    found = contains.contained_items(_texts(spark, sf), _items(spark, sf))
    return found.select(F.col("item_id").alias("query_id"), F.col("text_id").alias("chunk_id"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks with their first line as title; ids as text, as the stored index has them."""
    return _read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), F.substring_index("text", "\n", 1).alias("title"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 hits with their content; chunk ids as text, as the context formats them."""
    chunks = _plain(spark, sf)
    # Stored, so that its size is known where it meets the documents, which then are not shuffled.
    found = _stored(retrieval.bm25_topk(_questions(spark, sf), chunks, 8), "hits")
    return found.join(chunks.select("chunk_id", "content", F.col("source").alias("doc_name")), "chunk_id").withColumn("page_num", (F.col("chunk_id") % 7).cast("int"))


# Retrieval ---------------------------------------------------------------------


@query
def bm25_topk(spark, sf):
    return retrieval.bm25_topk(_questions(spark, sf), _plain(spark, sf), 10)


@query
def bm25_fields(spark, sf):
    """The better of text and first line."""
    return retrieval.bm25_topk(_questions(spark, sf), _titled(spark, sf), 10, ("content", "title"))


@query
def bm25_indexed(spark, sf):
    """From a stored index, which is built first; the search reads nothing else."""
    path = new_folder(spark, "text-index")
    textindex.build(path, _titled(spark, sf))
    return textindex.search(_questions(spark, sf), path, 10)


@query
def bm25_indexed_fields(spark, sf):
    """The better of text and first line, from a stored index of three segments that replace parts of each other, merged."""
    path, docs, fields = new_folder(spark, "text-index"), _titled(spark, sf), ("content", "title")
    number = F.col("chunk_id").cast("long")
    early, late = docs.where(number % 3 <= 1), docs.where(number % 3 >= 1)
    stale = lambda df: df.withColumns({"content": F.concat_ws(" ", F.lit("stale"), "content"), "title": F.lit("stale")})
    textindex.add_segment(path, 0, stale(early), fields=fields)
    textindex.add_segment(path, 1, late, stale(early.where(number % 3 == 1)), fields)
    textindex.add_segment(path, 2, docs.where(number % 3 == 0), stale(early.where(number % 3 == 0)), fields)
    textindex.compact(spark, path, f"{path}-merged")
    return textindex.search(_questions(spark, sf), f"{path}-merged", 10, fields)


@query
def vector_topk(spark, sf):
    return retrieval.vector_topk(_vector_queries(spark, sf), _vectors(spark, sf), 10)


@query
def vector_topk_filtered(spark, sf):
    return retrieval.vector_topk(_vector_queries(spark, sf), _vectors(spark, sf), 5, equals={"label": 3})


@query
def hybrid_search(spark, sf):
    return retrieval.hybrid_search(_questions(spark, sf), _chunks(spark, sf), RetrievalConfig())


@query
def rrf_dup_positions(spark, sf):
    """Routes with every position twice: only first positions count, later ones keep theirs."""
    r = _stored(_routes(spark, sf), "routes")
    return fusion.fuse(r.withColumn("pos", 2 * F.col("pos") - 1).unionByName(r.withColumn("pos", 2 * F.col("pos"))), final_top_k=8)


@query
def ivf_probe(spark, sf):
    v = _vectors(spark, sf)
    centers = indexing.train_lists(v, VectorIndexConfig(dim=64, lists=16))
    return indexing.ivf_topk(_vector_queries(spark, sf), v, centers, 10, 8)


def _indexed(spark: SparkSession, sf: str, k: int, probes: int) -> DataFrame:
    path = new_folder(spark, "vector-index")
    vectorindex.build(_vectors(spark, sf), path, VectorIndexConfig(dim=64, lists=16))
    return vectorindex.search(_vector_queries(spark, sf), path, k, probes)


@query
def vector_indexed(spark, sf):
    """From a stored index, with every list probed: candidates by code, compared exactly."""
    return _indexed(spark, sf, 10, 16)


@query
def vector_indexed_recall(spark, sf):
    """Whether twelve of sixteen lists give nine in ten of the exact neighbours; these vectors have hardly any clusters."""
    got, want = _indexed(spark, sf, 10, 12), retrieval.vector_topk(_vector_queries(spark, sf), _vectors(spark, sf), 10)
    both = want.select("query_id", "chunk_id").join(got.select("query_id", "chunk_id", F.lit(1).alias("found")), ["query_id", "chunk_id"], "left")
    return both.agg(F.count("*").alias("neighbours"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


# Evaluation --------------------------------------------------------------------


@query
def contained_items(spark, sf):
    return contains.contained_items(_texts(spark, sf), _items(spark, sf))


@query
def eval_per_query(spark, sf):
    q = _stored(_qrels(spark, sf), "judgments")
    s = evaluation.per_query(q.select("query_id").distinct(), q, _runs(spark, sf), 5)
    return s.select("route", "query_id", *[F.round(m, 9).alias(m) for m in evaluation.METRICS], "hits", "relevant", "returned")


@query
def ablation_by_route(spark, sf):
    q = _stored(_qrels(spark, sf), "judgments")
    m = evaluation.macro(evaluation.per_query(q.select("query_id").distinct(), q, _runs(spark, sf), 5))
    return m.select("route", "metric", F.round("value", 9).alias("value"), "total", "correct", "hits")


# Cleaning ----------------------------------------------------------------------

_HEAD = "Page 3 of 9\nCopyright notice\n12 - 34\n"
_TOC = "目录\n1.2 Title ..... 7\n\n第一章 Start .... 12\n"


def _cleaned(spark, sf, before: Column, f) -> DataFrame:
    docs = _read(spark, sf, "documents")
    return docs.select("doc_id", f(F.concat(before, F.col("text"))).alias("content"))


@query
def clean_headers(spark, sf):
    return _cleaned(spark, sf, F.lit(_HEAD), T.remove_headers_footers)


@query
def clean_toc(spark, sf):
    return _cleaned(spark, sf, F.lit("Before\n" + _TOC), T.remove_toc)


@query
def clean_dedup_lines(spark, sf):
    return _cleaned(spark, sf, F.lit(""), T.remove_duplicate_lines)


@query
def clean_normalize(spark, sf):
    return _cleaned(spark, sf, F.lit("　ＡＢＣ１２３\a  x\t\ty\n\n\n\n"), T.normalize)


@query
def clean_all(spark, sf):
    return _cleaned(spark, sf, F.lit(_HEAD + _TOC), T.clean)


@query
def detect_type(spark, sf):
    urls = _read(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("name"))
    return urls.select("page_id", T.file_type("name").alias("file_type"))


@query
def content_md5(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.fingerprint("text").alias("md5"))


# Segments and chunks -----------------------------------------------------------


@query
def segments_lines(spark, sf):
    return segments.line_segments(_read(spark, sf, "documents")).select("doc_id", "seg_idx", "content", "content_type")


@query
def page_table_segments(spark, sf):
    """Two blocks a document: its whole text, and a table made from its columns."""
    d = _read(spark, sf, "documents")
    block = F.concat_ws("\n", F.lit("## Facts"), F.concat_ws("  ", F.lit("id"), F.lit("lang"), F.lit("source")), F.concat_ws("  ", F.col("doc_id").cast("string"), "lang", "source"))
    pages = d.select("doc_id", F.lit(1).alias("page_num"), F.concat(F.lit("intro "), F.col("lang"), F.lit(" "), F.col("text"), F.lit("\n\n"), block).alias("text"))
    return segments.page_segments(pages).select("doc_id", "seg_idx", "content", "content_type", "page_num", "section_title", "heading_level", "table_markdown")


@query
def html_h1_segments(spark, sf):
    s = segments.html_segments(_read(spark, sf, "pages"))
    return s.where("heading_level = 1").groupBy("doc_id").agg(F.min_by("section_title", "seg_idx").alias("content"))


@query
def markdown_segments(spark, sf):
    d = _read(spark, sf, "documents")
    md = F.concat(F.lit("lost\n# "), F.col("lang"), F.lit("\n"), F.col("text"), F.lit("\n```py\n# no heading\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n## End\nlast\n"))
    files = d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_name"), md.cast("binary").alias("content"))
    return parse_files(files, {"MARKDOWN": parsers.parse_markdown}).select("doc_id", "seg_idx", "content_type", "section_title", "heading_level", F.length("content").alias("n"))


_CHUNK_COLUMNS = ("doc_id", "chunk_index", "chunk_id", "content", "content_type", "page_num", "section_title")


@query
def chunk_fixed(spark, sf):
    c = chunking.fixed(_lines(spark, sf), ChunkConfig("fixed", 512, 0, 50))
    return c.select(*_CHUNK_COLUMNS, F.size("segment_ids").alias("n_segments"))


@query
def chunk_fixed_overlap(spark, sf):
    c = chunking.fixed(_lines(spark, sf), ChunkConfig("fixed", 512, 128, 50))
    return c.select(*_CHUNK_COLUMNS, F.size("segment_ids").alias("n_segments"))


@query
def chunk_hierarchical(spark, sf):
    return chunking.hierarchical(_lines(spark, sf), ChunkConfig("hierarchical", 512, 0, 50)).select("doc_id", "chunk_index", "content", "content_type", "section_title")


@query
def chunk_validate(spark, sf):
    return chunking.chunk(_lines(spark, sf), ChunkConfig("fixed", 512, 0, 200)).select("doc_id", "chunk_index", "content")


@query
def adaptive_overlap(spark, sf):
    c = chunking.fixed(_lines(spark, sf), ChunkConfig("fixed", 512, 0, 50))
    return chunking.adaptive_overlap(c, 128).select("doc_id", "chunk_index", "overlap")


@query
def semantic_cut_points(spark, sf):
    v = _vectors(spark, sf)
    s = chunking.semantic_islands(v, 0.1, "label", "chunk_id")
    return s.select("label", F.col("chunk_id").alias("vec_id"), F.round("sim", 6).alias("sim"), F.col("island").cast("long").alias("island"))


@query
def semantic_chunks(spark, sf):
    """Groups embedded by counts of four letters: enough to place cuts."""

    def embed(groups: DataFrame) -> DataFrame:
        counts = F.array(*[F.regexp_count("group_text", F.lit(x)).cast("float") for x in ("e", "n", "ch", "qu")])
        return groups.withColumn("vector", counts)

    return chunking.semantic(_lines(spark, sf), ChunkConfig("semantic", 256, 0, 50), embed, 0.95).select("doc_id", "chunk_index", "content")


# Filters, budgets, context -----------------------------------------------------


@query
def token_estimate(spark, sf):
    mixed = F.concat(F.lit("abc中文def "), F.col("text"))
    return _read(spark, sf, "documents").select("doc_id", T.estimate_tokens(mixed).alias("tokens"))


@query
def threshold_filter(spark, sf):
    return rerank.filter_by_threshold(_hits(spark, sf), 20.0).select("query_id", "chunk_id", "score")


@query
def token_budget(spark, sf):
    return rerank.limit_tokens(_hits(spark, sf), 600).select("query_id", "chunk_id", "score")


@query
def near_dup_greedy(spark, sf):
    return rerank.deduplicate(_hits(spark, sf), 0.9).select("query_id", "chunk_id", "score")


@query
def rerank_fallback(spark, sf):
    """Scores by length; queries of odd number fail and fall back to what they had."""

    def scorer(h: DataFrame) -> DataFrame:
        return h.withColumn("new_score", F.round(1 / (1 + F.length("content") / 1000.0), 6)).withColumn("failed", F.col("query_id") % 2 == 1)

    return rerank.rerank(_hits(spark, sf), scorer, 4, 0.45).select("query_id", "chunk_id", "score", "fallback")


@query
def context_build(spark, sf):
    return context.build_context(_hits(spark, sf))


@query
def context_meta(spark, sf):
    return context.build_context(_hits(spark, sf), with_meta=True)


@query
def context_truncate_head(spark, sf):
    return context.truncated_context(_hits(spark, sf), 800)


@query
def context_truncate_tail(spark, sf):
    return context.truncated_context(_hits(spark, sf), 800, keep="tail")


@query
def context_citations(spark, sf):
    c = context.build_citations(_hits(spark, sf))
    return c.select("query_id", F.explode("citations").alias("c")).select("query_id", F.col("c.id").alias("id"), F.col("c.chunk_id").alias("chunk_id"), F.col("c.citation").alias("citation"))


# Validation --------------------------------------------------------------------


def _answers(spark, sf) -> DataFrame:
    c = _read(spark, sf, "conversations")
    cited = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("] x ["), (F.col("turn") + 2).cast("string"), F.lit("]"))
    return c.select("conv_id", "turn", cited.alias("answer"), (F.col("turn") % 4 + 1).cast("int").alias("sources"))


@query
def citations_check(spark, sf):
    a = _answers(spark, sf)
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return a.select("conv_id", "turn", text(validation.extract_citations("answer")).alias("cited"), text(validation.invalid_citations("answer", "sources")).alias("invalid"))


@query
def verdict_parse(spark, sf):
    said = F.concat(F.lit("幻觉判定："), F.when(F.col("turn") % 2 == 0, "是").otherwise("否"), F.lit("\n幻觉部分："), F.when(F.col("turn") % 3 == 0, "无").otherwise(F.col("role")), F.lit("\n置信度：0."), F.col("turn").cast("string"))
    v = _read(spark, sf, "conversations").select("conv_id", "turn", validation.parse_verdict(said).alias("v"))
    return v.select("conv_id", "turn", F.col("v.has_hallucination").alias("bad"), F.array_join("v.details", "|").alias("details"), F.col("v.confidence").alias("confidence"))


@query
def answer_gate(spark, sf):
    a = _answers(spark, sf).withColumn("has_hallucination", F.col("turn") % 5 == 0)
    return validation.gate(a).select("conv_id", "turn", "final_answer", "flag")


# Deltas and streams ------------------------------------------------------------


def _stored_marks(spark, sf) -> DataFrame:
    """What an earlier run stored: two documents in three, one in nine of them with another text."""
    d = _read(spark, sf, "documents").where("doc_id % 3 <> 0")
    return d.select("doc_id", F.md5(F.when(F.col("doc_id") % 9 == 1, F.lit("old")).otherwise(F.col("text"))).alias("md5"))


@query
def change_detect(spark, sf):
    now = _read(spark, sf, "documents").select("doc_id", T.fingerprint("text").alias("md5"))
    return indexing.detect_changes(now, _stored_marks(spark, sf)).select("doc_id", "changed")


@query
def upsert_result(spark, sf):
    now = _read(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    fresh = indexing.changed_only(now, _stored_marks(spark, sf)).select("doc_id", "md5")
    return indexing.upsert(_stored_marks(spark, sf), fresh)


@query
def delete_anti(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", "source")
    return indexing.delete(d, d.where("doc_id % 4 = 1"), "doc_id")


@query
def ttl_expire(spark, sf):
    e = _read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("updated_at"))
    return indexing.expire(e, "2024-01-20 00:00:00", 10).select("event_id")


@query
def ttl_by_day(spark, sf):
    """The same rows, from a table with a folder a day, of which expired ones go without being read."""
    e = _read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("updated_at"))
    path = new_folder(spark, "events-by-day")
    indexing.write_by_day(e, path)
    indexing.purge_expired(spark, path, "2024-01-20 00:00:00", 10)
    return indexing.read_unexpired(spark, path, "2024-01-20 00:00:00", 10).select("event_id")


@query
def sync_latest_action(spark, sf):
    action = F.when(F.col("event_type") == "purchase", "DELETE").when(F.col("event_type") == "click", "UPDATE").otherwise("ADD")
    m = _read(spark, sf, "events").select(F.col("user_id").cast("string").alias("docId"), action.alias("action"), F.col("event_id").cast("string").alias("md5"), F.col("event_id").alias("timestamp"))
    return sync.latest_action(m).select("docId", "action", F.col("timestamp").alias("last"))
