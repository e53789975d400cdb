"""Functions that no other test calls: hits, filters in a row, OCR, repeated messages, evaluation requests, IVF lists, days that expire."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import EVAL_REQUEST, SYNC_MESSAGE, VectorIndexConfig
from lodestone.functions import text as T
from lodestone.operators import indexing, rerank, retrieval
from lodestone.plans import api
from lodestone.sources.files import ocr
from lodestone.streaming import sync


def test_hits_fill_what_is_missing(spark):
    df = spark.createDataFrame([(1, "c", None, "7", None)], "query_id long, chunk_id string, content string, page_num string, score double")
    r = retrieval.hits(df.withColumn("doc_id", F.lit(5))).first()
    assert (r.query_id, r.chunk_id, r.doc_id, r.doc_name, r.content, r.section_title, r.page_num, r.score) == (1, "c", "5", "", "", "", 7, 0.0)
    assert retrieval.hits(df.withColumn("page_num", F.lit("no number"))).first().page_num == 0


def plain_greedy(rows, threshold, step):
    out = []
    for q in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (r[2] is None, -(r[2] or 0), r[3], r[1])):
            if all(rerank.overlap(r[4] or "", o, step) <= threshold for o in kept):
                kept.append(r[4] or "")
                out.append(r)
    return sorted(map(str, out))


@pytest.mark.parametrize("step", [1, 8])
def test_greedy_near_duplicates(spark, step):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randrange(0, 400))) for _ in range(6)]
    rows = []
    for q in range(5):
        for c in range(12):
            t = rng.choice(base)
            cut = rng.randrange(0, len(t) + 1)
            rows.append((q, f"c{c}", rng.choice([None, 1.0, 2.0, 3.0]), c % 3, rng.choice([t, t[:cut], t + "tail", None, ""])))
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int, content string").withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    got = rerank.deduplicate(df, 0.9, step)
    assert got.columns == df.columns
    assert sorted(str((r.query_id, r.chunk_id, r.score, r["rank"], r.content)) for r in got.collect()) == plain_greedy(rows, 0.9, step)
    assert rerank.deduplicate(df.where("false")).count() == 0


def test_filters_in_a_row(spark):
    rows = [(1, "a", 0.9, 1, "alpha beta gamma delta one"), (1, "b", 0.8, 2, "alpha beta gamma delta one"), (1, "c", 0.7, 3, "quite another text of words"), (1, "d", 0.1, 4, "low")]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int, content string")
    assert [r.chunk_id for r in rerank.combine_and_filter(df, 0.5).orderBy("rank").collect()] == ["a", "c"]
    assert [r.chunk_id for r in rerank.combine_and_filter(df, 0.5, max_tokens=9).collect()] == ["a"]


def test_ocr(spark):
    def engine(data, language):
        if data == b"broken":
            raise ValueError("no image")
        return None if data == b"blank" else f"{language}:{len(data)}"

    df = spark.createDataFrame([(1, b"1234"), (2, b"broken"), (3, b"blank")], "id long, content binary")
    assert {r.id: r.text for r in ocr(df, engine, "deu").collect()} == {1: "deu:4", 2: "", 3: ""}


def test_repeated_messages_are_dropped(spark, tmp_path):
    for no, rows in enumerate(([("a", 1), ("a", 1), ("b", 2)], [("a", 1), ("a", 3)])):
        spark.createDataFrame([(d, d, None, "ADD", None, "m", t * 1000) for d, t in rows], SYNC_MESSAGE).coalesce(1).write.mode("append").json(f"{tmp_path}/in{no}")
    stream = sync.deduplicated(spark.readStream.schema(SYNC_MESSAGE).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in*"))
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
    assert q.awaitTermination(120) and q.exception() is None
    assert sorted((r.docId, r.timestamp) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 1000), ("a", 3000), ("b", 2000)]


def test_evaluation_of_requests(spark):
    requests = spark.createDataFrame([([("q one", ["a", "b"], None), ("q two", ["c"], None)], 2), ([], 2), ([("x", ["y"], None)], 0)], EVAL_REQUEST)

    def retrieve(asked):
        return asked.withColumn("hit", F.explode(F.when(F.col("question") == "q one", F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("n"), F.lit("c"))))).select(
            F.lit("one").alias("route"), "query_id", F.when(F.col("hit").isin("a", "n"), 1).otherwise(2).alias("pos"), F.col("hit").alias("chunk_id")
        )

    got = {r.metric: (r.value, r.total) for r in api.run_evaluation(requests, retrieve, 2).collect()}
    assert got["recall"] == (0.75, 2) and got["precision"] == (0.5, 2) and got["mrr"] == (0.75, 2)


def test_ivf_lists(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)).astype(np.float32))] + [(200, None)]
    df = spark.createDataFrame(rows, "chunk_id long, vector array<float>")
    asked = df.where("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), "vector")
    centers = indexing.train_lists(df, VectorIndexConfig(dim=8, lists=5))
    key = lambda d: sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in d.collect())
    exact = key(retrieval.vector_topk(asked, df, 5, threshold=-1.0))
    assert key(indexing.ivf_topk(asked, df, centers, 5, 5)) == exact
    near = {x[:2] for x in key(indexing.ivf_topk(asked, df, centers, 5, 3))}
    assert len(near & {x[:2] for x in exact}) >= 0.7 * len(exact)


def test_days_that_expire(spark, tmp_path):
    path = f"{tmp_path}/days"
    times = ["2024-01-01 10:00:00", "2024-01-09 23:59:59", "2024-01-10 00:00:00", "2024-01-10 06:00:00", "2024-01-10 12:00:00", "2024-01-15 00:00:00", None]
    df = spark.createDataFrame(list(enumerate(times)), "id long, t string").select("id", F.col("t").cast("timestamp").alias("updated_at"))
    indexing.write_by_day(df, path)
    want = sorted(r.id for r in indexing.expire(df, "2024-01-20 06:00:00", 10).collect())
    assert sorted(r.id for r in indexing.read_unexpired(spark, path, "2024-01-20 06:00:00", 10).collect()) == want == [3, 4, 5]
    plan = indexing.read_unexpired(spark, path, "2024-01-20 06:00:00", 10)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert indexing.purge_expired(spark, path, "2024-01-20 06:00:00", 10) == 2 and indexing.purge_expired(spark, path, "2024-01-20 06:00:00", 10) == 0
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4, 5, 6]
    assert sorted(r.id for r in indexing.read_unexpired(spark, path, "2024-01-20 06:00:00", 10).collect()) == want
    assert indexing.read_unexpired(spark, path, "2024-01-20 06:00:00", 0).count() == 5 and indexing.purge_expired(spark, path, "x", 0) == 0


def test_lines_of_a_very_long_text(spark):
    rng = random.Random(6)
    lines = [rng.choice(["", " ", f"line {rng.randrange(20_000)}", f"  line {rng.randrange(20_000)} "]) for _ in range(60_000)]
    seen, kept = set(), []
    while lines and lines[-1] == "":
        lines.pop()
    for x in lines:
        if not x.strip() or x.strip() not in seen:
            kept.append(x)
            seen.add(x.strip())
    df = spark.createDataFrame([("\n".join(lines),), (None,), ("",)], "t string")
    got = [r.t for r in df.select(T.remove_duplicate_lines("t").alias("t")).collect()]
    assert got == ["".join(f"{x}\n" for x in kept), "", "\n"]
