"""The jobs: two runs over growing input, reruns without new input, a repeated batch, and the command line."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from jobs import evaluate_retrieval, index_documents
from lodestone.operators import textindex

DOC = "doc_id long, text string, lang string, source string"
SMALL = {"chunk_size": 40, "overlap": 10, "min_chunk": 0, "buckets": 4}


def add(spark, folder, name, docs):
    spark.createDataFrame(docs, DOC).coalesce(1).write.mode("overwrite").parquet(f"{folder}-{name}")
    spark.read.schema(DOC).parquet(f"{folder}-{name}").coalesce(1).write.mode("append").parquet(folder)


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def text(n, word):
    return "\n".join(f"{word} line {i} of document {n} with some words" for i in range(n % 4 + 1))


FIRST = [(n, text(n, "old"), "en" if n % 2 else None, f"s{n % 3}") for n in range(12)] + [(None, "of nobody", "en", "s"), (20, None, "en", "s"), (21, "", "de", None), (22, "twice", "en", "s"), (22, "twice", "en", "s"), (23, "one", "en", "s"), (23, "two", "de", "t")]
SECOND = [(3, text(3, "new"), "en", "s0"), (4, text(4, "old"), None, "s1"), (5, None, "en", "s2"), (30, text(2, "more"), "fr", "s9")]
COLUMNS = ("doc_id", "chunk_index", "chunk_id", "content", "lang", "source")


def test_index_documents_takes_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    folder, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    config = SMALL | {"documents": folder, "output": out}
    add(spark, folder, "a", FIRST)
    one = rows(index_documents.run(spark, config), *COLUMNS)
    assert {r[0] for r in one} == {*map(str, range(12)), "22", "23"} and len({r[2] for r in one}) == len(one)
    before = rows(spark.read.parquet(f"{out}/chunks").select("chunk_id", F.input_file_name().alias("f")), "chunk_id", "f")
    assert rows(index_documents.run(spark, config), *COLUMNS) == one  # nothing new
    add(spark, folder, "b", SECOND)
    two = rows(index_documents.run(spark, config), *COLUMNS)
    assert {r[0] for r in two} == {*(str(n) for n in range(12) if n != 5), "22", "23", "30"}
    assert "new line" in " ".join(r[3] for r in two if r[0] == "3") and "old line" not in " ".join(r[3] for r in two if r[0] == "3")
    # Files of the first batch stay, document 4 was not chunked again.
    after = rows(spark.read.parquet(f"{out}/chunks").select("chunk_id", F.input_file_name().alias("f")), "chunk_id", "f")
    assert set(before) <= set(after) and {r[0] for r in spark.read.parquet(f"{out}/marks").where("batch = 1").select("doc_id").collect()} == {"3", "5", "30"}
    assert rows(spark.read.parquet(f"{out}/rejected"), "text") == [("of nobody",)]
    # The index follows: it equals one that is built from the chunks as they are now.
    now = index_documents.current_chunks(spark, out)
    textindex.compact(spark, f"{out}/index", f"{tmp_path}/merged", buckets=4)
    textindex.build(f"{tmp_path}/built", now, buckets=4)
    for table in ("postings", "stats"):
        names = sorted(spark.read.parquet(f"{tmp_path}/built/{table}").columns)
        assert rows(spark.read.parquet(f"{tmp_path}/merged/{table}"), *names) == rows(spark.read.parquet(f"{tmp_path}/built/{table}"), *names)
    # One batch over everything in another place gives the same as two.
    whole = SMALL | {"documents": f"{tmp_path}/all", "output": f"{tmp_path}/out2"}
    add(spark, whole["documents"], "c", [r for r in FIRST if r[0] not in {3, 4, 5}] + SECOND)
    assert rows(index_documents.run(spark, whole), *COLUMNS) == two
    assert "3 new or changed" in caplog.text and "reading" in caplog.text


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    config, out = index_documents.DEFAULTS | SMALL, f"{tmp_path}/out"
    a, b = spark.createDataFrame(FIRST, DOC), spark.createDataFrame(SECOND, DOC)
    index_documents.apply_batch(a, 0, out, config)
    index_documents.apply_batch(b, 1, out, config)
    want = rows(index_documents.current_chunks(spark, out), *COLUMNS)
    hits = rows(textindex.search(spark.createDataFrame([(1, "new old line")], "query_id long, question string"), f"{out}/index", 50, buckets=4), "chunk_id", "score")
    index_documents.apply_batch(b, 1, out, config)
    assert rows(index_documents.current_chunks(spark, out), *COLUMNS) == want
    assert rows(textindex.search(spark.createDataFrame([(1, "new old line")], "query_id long, question string"), f"{out}/index", 50, buckets=4), "chunk_id", "score") == hits


def test_no_documents(spark, tmp_path):
    add(spark, f"{tmp_path}/docs", "a", [])
    assert index_documents.run(spark, SMALL | {"documents": f"{tmp_path}/docs", "output": f"{tmp_path}/out"}).count() == 0


@pytest.fixture
def evaluated(spark, tmp_path):
    docs = [(n, f"document {n} tells of {w} and of other things\nsecond line of {n}", "en", "s") for n, w in enumerate(["storms", "rivers", "old towns by the sea", "storms and rivers"] * 5)]
    items = [(0, "tells of storms and of other"), (1, "of old towns by the sea"), (2, "is in no document at all"), (3, None)]
    vectors = [(n, [float(n % 5), 1.0, float(n % 3)]) for n in range(20)] + [(20, None)]
    spark.createDataFrame(docs, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return {"documents": f"{tmp_path}/documents.parquet", "questions": f"{tmp_path}/benchmark.parquet", "embeddings": f"{tmp_path}/embeddings.parquet", "output": f"{tmp_path}/report", "k": 3, "depth": 10}


def test_evaluation_report(spark, evaluated, caplog):
    caplog.set_level(logging.INFO)
    out = evaluated["output"]
    got = rows(evaluate_retrieval.run(spark, evaluated), "route", "query_id", "recall", "precision", "mrr", "ndcg", "hits", "relevant", "returned")
    assert {r[0] for r in got} == {"bm25", "vector", "rrf"} and {r[1] for r in got} == {0, 1}
    by = {(r[0], r[1]): r for r in got}
    assert by["bm25", 1][6:] == (3, 5, 3) and by["bm25", 1][4] == 1.0
    files = sorted(f for f in map(str, spark.read.parquet(f"{out}/scores").inputFiles()))
    assert rows(evaluate_retrieval.run(spark, evaluated), "route", "query_id", "recall", "precision", "mrr", "ndcg", "hits", "relevant", "returned") == got
    assert files and all("route=" in f for f in files)
    lines = [r.line for r in spark.read.json(f"{out}/report").collect()]
    assert len(lines) == 12 and any(x.startswith("recall: ") for x in lines)
    runs = spark.read.parquet(f"{out}/runs")
    assert runs.where("pos > 10").count() == 0 and runs.where("query_id = 3 AND route = 'bm25'").count() == 0  # no text, but a vector
    assert "questions" in caplog.text


def test_command_lines(spark, evaluated, tmp_path, monkeypatch):
    add(spark, f"{tmp_path}/docs", "a", FIRST)
    for job, config, more in ((index_documents, SMALL | {"documents": "nowhere", "output": f"{tmp_path}/o"}, ["--documents", f"{tmp_path}/docs"]), (evaluate_retrieval, evaluated, [])):
        path = tmp_path / f"{job.__name__}.json"
        path.write_text(json.dumps(config))
        monkeypatch.setattr(type(spark), "stop", lambda self: None)
        job.main(["--config", str(path), *more])
    assert index_documents.current_chunks(spark, f"{tmp_path}/o").count() > 0
    assert spark.read.parquet(f"{evaluated['output']}/scores").count() > 0
