"""Context strings and citations from ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens

# The words of the context format.
UNKNOWN_DOCUMENT, SOURCE, PAGE = "未知文档", "来源", "页码"
DEFAULT_TOKENS = 4096


def _ranked(hits: DataFrame) -> DataFrame:
    """``(query_id, ranked)``: hits best first (then rank and id)."""
    fields = F.struct((-F.col("score")).alias("s"), "rank", "chunk_id", F.coalesce("content", F.lit("")).alias("content"), F.col("doc_name") if "doc_name" in hits.columns else F.lit(None).cast("string").alias("doc_name"), F.coalesce("page_num", F.lit(0)).alias("page_num") if "page_num" in hits.columns else F.lit(0).alias("page_num"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(fields)).alias("ranked"))


def _meta(h: Column, i: Column) -> Column:
    return F.concat(F.lit("["), (i + 1).cast("string"), F.lit(f"] ({SOURCE}: "), F.coalesce(h["doc_name"], F.lit(UNKNOWN_DOCUMENT)), F.lit(f", {PAGE}: "), h["page_num"].cast("string"), F.lit(")"))


def build_context(hits: DataFrame, with_meta: bool = False) -> DataFrame:
    """``(query_id, context)``: numbered hits, one after the other; with their document and page if wished."""
    plain = lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["content"], F.lit("\n"))
    rich = lambda h, i: F.concat(_meta(h, i), F.lit("\n"), h["content"], F.lit("\n"))
    return _ranked(hits).select("query_id", F.array_join(F.transform("ranked", rich if with_meta else plain), "").alias("context"))


def build_citations(hits: DataFrame) -> DataFrame:
    """``(query_id, citations)``: number, chunk and citation text of each hit."""
    one = lambda h, i: F.struct((i + 1).cast("int").alias("id"), h["chunk_id"].alias("chunk_id"), F.concat(_meta(h, i), F.lit("\n"), h["content"]).alias("citation"))
    return _ranked(hits).select("query_id", F.transform("ranked", one).alias("citations"))


def truncate(context: Column | str, max_tokens: int, keep: str = "head") -> Column:
    """Whole lines within the budget, blank ones left out; the first line if none fits.

    ``head`` keeps the best-ranked lines; ``tail`` counts from the end, which drops
    them first.
    """
    if keep not in ("head", "tail"):
        raise ValueError("keep must be 'head' or 'tail'")
    c = F.coalesce(F.col(context) if isinstance(context, str) else context, F.lit(""))
    if max_tokens <= 0:
        return F.lit("")
    every = F.split(F.regexp_replace(c, r"\n+\z", ""), "\n")
    lines = F.filter(every, lambda x: x.rlike(r"\S"))
    seq = F.reverse(lines) if keep == "tail" else lines
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("go"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        t = estimate_tokens(x)
        fits = a["go"] & (a["n"] + t <= max_tokens)
        return F.struct(F.when(fits, a["n"] + t).otherwise(a["n"]).alias("n"), fits.alias("go"), F.when(fits, F.array_append(a["out"], x)).otherwise(a["out"]).alias("out"))

    kept = F.aggregate(seq, start, step, lambda a: a["out"])
    kept = F.reverse(kept) if keep == "tail" else kept
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(every[0])


def truncated_context(hits: DataFrame, max_tokens: int = DEFAULT_TOKENS, with_meta: bool = False, keep: str = "head") -> DataFrame:
    """``build_context`` within a budget; a budget that is not positive means the default."""
    return build_context(hits, with_meta).withColumn("context", truncate("context", max_tokens if max_tokens > 0 else DEFAULT_TOKENS, keep))
