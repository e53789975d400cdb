"""Cleaning and chunking against plain statements of their rules."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.config import SEGMENTS, ChunkConfig
from lodestone.functions import text as T
from lodestone.operators import chunking, context, rerank


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f("t").alias("x")).first().x


def test_cleaning_samples(spark):
    assert one(spark, T.remove_headers_footers, "a\nPage 3 of 9\nb\n2024-05-01 log\n© x\n第 3 页") == "a\n\nb\n\n\n"
    assert one(spark, T.remove_toc, "x\n目录\n1.2 Title ..... 7\n\nbody\n目录\nkept") == "x\nbody\n目录\nkept\n"
    assert one(spark, T.remove_toc, "目录\n1.2 T .... 7") == ""
    assert one(spark, T.remove_duplicate_lines, "a\n\n a \nb\n\nb") == "a\n\nb\n\n"
    assert one(spark, T.normalize, "　ＡＢＣ１２３\a\n\n\n\nx \t y ") == "ABC123\n\nx y"
    for f in (T.remove_headers_footers, T.remove_toc, T.remove_duplicate_lines, T.normalize, T.clean):
        assert one(spark, f, None) == "" and one(spark, f, "").strip() == ""


def toc_rule(text):
    out, inside, found = [], False, False
    for line in text.rstrip("\n").split("\n"):
        if not found and re.search(r"(?i)^\s*目[录録]|^\s*CONTENTS|^\s*Table\s+of\s+Contents", line):
            inside = found = True
        elif inside and (not line.strip() or re.fullmatch(r"\s*([第\d一二三四五六七八九十百千]+[章节篇部]|\d{1,2}\.\d{1,2}\.?\d{0,2}|•)\s.*\.{2,}\s*\d+\s*", line)):
            pass
        else:
            inside = False
            out.append(line + "\n")
    return "".join(out)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["目录", "Contents", "1.2 T .... 7", "", "body", "第1章 x .. 3"]), max_size=8), min_size=1, max_size=20))
def test_toc_and_repeated_lines_follow_their_rules(spark, texts):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, t string").select("t", T.remove_toc("t").alias("toc"), T.remove_duplicate_lines("t").alias("dup")).collect()
    for r in got:
        assert r.toc == toc_rule(r.t)
        seen, want = set(), []
        for line in r.t.rstrip("\n").split("\n"):
            if not line.strip() or line.strip() not in seen:
                want.append(line + "\n")
            seen.add(line.strip())
        assert r.dup == "".join(want)


def test_long_form_of_line_deduplication(spark):
    df = spark.createDataFrame([(1, "a\nb\na\n\nb"), (2, "x")], "doc_id int, t string")
    got = {r.doc_id: r.t for r in T.remove_duplicate_lines_long(df, "t", "doc_id").collect()}
    assert got == {1: "a\nb\n\n", 2: "x\n"}


def test_tokens_types_overlap(spark):
    assert one(spark, T.estimate_tokens, "abc中def") == 0 + 1 + 0
    assert one(spark, T.estimate_tokens, "中文字 two words") == 2 + 2 + 1
    names = ["a.MD", ".md", "x", "b.tar.pdf", None, "c.htm"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(T.file_type("n").alias("t")).collect()
    assert [r.t for r in got] == ["MARKDOWN", "UNKNOWN", "UNKNOWN", "PDF", "UNKNOWN", "HTML"]
    assert one(spark, T.terms, "Ab中文 c1") == ["ab", "中", "文", "c1"]
    df = spark.createDataFrame([("abc", "cab"), ("abc", "xyz"), ("", "x"), ("hello world", "say hello world!")], "a string, b string")
    compat = [r.o for r in df.select(T.overlap_ratio("a", "b").alias("o")).collect()]
    assert compat == [1.0, 0.0, 0.0, 1.0] and [rerank.overlap(a, b, 1) for a, b in (("abc", "cab"), ("abc", "xyz"))] == [1.0, 0.0]
    assert rerank.overlap("abc", "cab", 8) == 0.0


def seg(i, content, kind="text", title=None, page=0, doc="d"):
    return (doc, i, f"{doc}{i}", content, kind, page, title, 1 if title else 0, None, None)


def fixed_rule(segs, size, overlap):
    out, buf, ids, pages, kind = [], "", [], [], None
    emit = lambda c, k, i, p, s: out.append((c, k or "text", list(i), sum(p) // max(1, len(p)), s[6]))
    for s in segs:
        if s[4] in ("table", "code"):
            if buf:
                emit(buf, kind, ids, pages, s)
                buf, ids, pages, kind = "", [], [], None
            emit(s[3], s[4], [s[2]], [s[5]], s)
            continue
        if len(buf) + len(s[3]) > size and buf:
            emit(buf, kind, ids, pages, s)
            buf = buf[-overlap:] if overlap else ""
        if not buf:
            kind = s[4]
        buf += s[3]
        ids.append(s[2])
        pages.append(s[5])
    if buf:
        emit(buf, kind, ids, pages, segs[-1])
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(1, 60), st.sampled_from(["text"] * 5 + ["table", "code"]), st.integers(0, 9)), min_size=1, max_size=12), min_size=1, max_size=12), st.sampled_from([0, 7, 30]))
def test_fixed_packing(spark, docs, overlap):
    every = {f"d{k:02}": [seg(i, chr(97 + i) * n, kind, f"t{i}", page, f"d{k:02}") for i, (n, kind, page) in enumerate(d)] for k, d in enumerate(docs)}
    df = spark.createDataFrame([s for d in every.values() for s in d], SEGMENTS)
    got = chunking.fixed(df, ChunkConfig("fixed", 80, overlap, 0)).orderBy("doc_id", "chunk_index").collect()
    want = [(d, i, *c) for d, segs in every.items() for i, c in enumerate(fixed_rule(segs, 80, overlap))]
    assert [(r.doc_id, r.chunk_index, r.content, r.content_type, r.segment_ids, r.page_num, r.section_title) for r in got] == want


def test_fixed_table_stands_alone_and_sections_merge(spark):
    df = spark.createDataFrame([seg(0, "one"), seg(1, "two"), seg(2, "| t |", "table"), seg(3, "three")], SEGMENTS)
    got = chunking.chunk(df, ChunkConfig("fixed", 50, 0, 3)).orderBy("chunk_index").collect()
    assert [r.content for r in got] == ["onetwo", "| t |", "three"]
    df = spark.createDataFrame([seg(0, "aaa", title="第一章"), seg(1, "bbb"), seg(2, "ccc", title="第二章"), seg(3, "ddd", title="第一章")], SEGMENTS)
    got = chunking.chunk(df, ChunkConfig("hierarchical", 200, 0, 3)).orderBy("chunk_index").collect()
    assert [(r.section_title, r.content) for r in got] == [("第一章", "aaa\nbbb\nddd"), ("第二章", "ccc")]


def test_strategy_errors_and_semantic_fallback(spark):
    df = spark.createDataFrame([seg(0, "x" * 60)], SEGMENTS)
    with pytest.raises(ValueError):
        chunking.chunk(df, None)
    with pytest.raises(ValueError, match="fixed"):
        chunking.chunk(df, ChunkConfig("other"))
    assert chunking.chunk(df, ChunkConfig("semantic")).count() == 1
    assert chunking.chunk(df.where("false"), ChunkConfig("fixed")).count() == 0


def test_semantic_cuts(spark):
    df = spark.createDataFrame([seg(i, c * 10) for i, c in enumerate("aabb")], SEGMENTS)
    embed = lambda g: g.withColumn("vector", F.when(F.col("group_text").startswith("a"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    got = chunking.semantic(df, ChunkConfig("semantic", 10, 0, 1), embed).orderBy("chunk_index").collect()
    assert [r.content for r in got] == ["a" * 10 + "\n" + "a" * 10, "b" * 10 + "\n" + "b" * 10]


def test_greedy_duplicates_budget_and_rerank(spark):
    rows = [(1, "a", "x" * 9 + "yz one two", 3.0, 1, "q"), (1, "b", "x" * 9 + "yz one two", 2.0, 2, "q"), (1, "c", "entirely different words", 1.0, 3, "q")]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, content string, score double, rank int, question string")
    assert [r.chunk_id for r in rerank.deduplicate(df).orderBy("rank").collect()] == ["a", "c"]
    assert rerank.limit_tokens(df, 0).count() == 0 and rerank.limit_tokens(df, 5).count() == 1
    good = rerank.batch_scorer(lambda q, t: [0.5 if "x" in x else 0.1 for x in t])
    assert {r.chunk_id for r in rerank.rerank(df, good, 5).collect()} == {"a", "b"}

    def broken(q, t):
        raise OSError("down")

    assert [r.score for r in rerank.rerank(df, rerank.batch_scorer(broken), 2).orderBy("rank").collect()] == [3.0, 2.0]


def test_truncation(spark):
    t = "one two\n\nthree four\nfive six"
    assert one(spark, lambda c: context.truncate(c, 4), t) == "one two"
    assert one(spark, lambda c: context.truncate(c, 1), t) == "one two"
    assert one(spark, lambda c: context.truncate(c, 0), t) == ""
