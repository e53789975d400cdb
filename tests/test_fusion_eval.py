"""Rank fusion and metrics: the golden values of the frozen ranking snapshot and of small lists."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation, fusion

SNAPSHOT = [
    ("q1", ["e42"], ["overview", "e42"], ["e42", "error-list"]),
    ("q2", ["recovery"], ["recovery", "common"], ["common", "account-list"]),
    ("q3", ["refund-conditions", "refund-time"], ["refund-conditions", "shared"], ["refund-time", "shared"]),
    ("q4", ["cross-border-fee"], [], []),
]
RUN = "query_id string, route string, pos int, chunk_id string"


def runs(spark, **routes):
    return spark.createDataFrame([("q", r, i, c) for r, cs in routes.items() for i, c in enumerate(cs, 1)], RUN)


def snapshot(spark):
    rows = [(q, r, i, c) for q, _, v, b in SNAPSHOT for r, cs in (("vector", v), ("bm25", b)) for i, c in enumerate(cs, 1)]
    samples = spark.createDataFrame([(q,) for q, *_ in SNAPSHOT], "query_id string")
    qrels = spark.createDataFrame([(q, c) for q, rel, *_ in SNAPSHOT for c in rel], "query_id string, chunk_id string")
    return samples, qrels, spark.createDataFrame(rows, RUN)


def test_sum_over_routes(spark):
    got = fusion.fuse(runs(spark, vector=["a", "b"], bm25=["b", "c"]), 60, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and [r["rank"] for r in got] == [1, 2, 3]
    assert got[0].score == pytest.approx(0.03252247488101534, abs=1e-12)


def test_first_position_in_a_route_counts_and_later_ones_stay(spark):
    got = {r.chunk_id: r.score for r in fusion.fuse(runs(spark, vector=["a", "a", "b"]), 60, 2).collect()}
    assert got == {"a": pytest.approx(0.01639344262295082, abs=1e-12), "b": pytest.approx(0.01587301587301587, abs=1e-12)}


def test_ties_go_to_the_smaller_id_and_payload_to_the_first_route(spark):
    r = runs(spark, vector=["z"], bm25=["a"])
    assert fusion.fuse(r, 60, 1).first().chunk_id == "a"
    both = runs(spark, vector=["x"], bm25=["x"]).withColumn("content", F.concat(F.lit("from "), "route"))
    assert fusion.fuse(both).first().content == "from vector"


def test_empty_and_invalid(spark):
    assert fusion.fuse(runs(spark), 60, 2).count() == 0
    for k, n in ((0, 1), (-1, 1), (60, 0), (60, -1)):
        with pytest.raises(ValueError):
            fusion.fuse(runs(spark), k, n)


def test_ablation_reproduces_the_published_aggregates(spark):
    samples, qrels, routes = snapshot(spark)
    fused = fusion.fuse(routes, 60, 2).select("query_id", F.lit("rrf").alias("route"), F.col("rank").alias("pos"), "chunk_id")
    got = {(r.route, r.metric): r.value for r in evaluation.evaluate(samples, qrels, routes.unionByName(fused), 2).collect()}
    want = {("vector", "recall"): 0.625, ("bm25", "recall"): 0.375, ("rrf", "recall"): 0.625, ("vector", "mrr"): 0.625, ("rrf", "mrr"): 0.5, ("bm25", "mrr"): 0.5,
            ("vector", "precision"): 0.375, ("bm25", "precision"): 0.25, ("rrf", "precision"): 0.375,
            ("vector", "ndcg"): 0.561019236584229, ("bm25", "ndcg"): 0.4032867981913646, ("rrf", "ndcg"): 0.5044456402014998}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert [r.chunk_id for r in fused.where("query_id = 'q2'").orderBy("pos").collect()] == ["common", "recovery"]


@pytest.mark.parametrize(
    "retrieved, relevant, k, want",
    [
        (["wrong", "right"], ["right"], 1, {"recall": 0, "precision": 0}),
        ([], ["right"], 3, {"recall": 0, "precision": 0, "mrr": 0, "ndcg": 0}),
        (["right"], ["right"], 4, {"precision": 0.25}),
        (["right"], ["right", "right"], 1, {"recall": 1.0}),
        (["wrong", "right"], ["right"], 3, {"mrr": 0.5, "ndcg": 0.6309297535714574}),
    ],
)
def test_metrics(spark, retrieved, relevant, k, want):
    samples = spark.createDataFrame([("q",)], "query_id string")
    qrels = spark.createDataFrame([("q", c) for c in relevant], "query_id string, chunk_id string")
    other = spark.createDataFrame([("other", "vector", 1, "x")], RUN)
    got = evaluation.per_query(samples, qrels, runs(spark, vector=retrieved).unionByName(other), k).first()
    assert {m: got[m] for m in want} == {m: pytest.approx(v, abs=1e-12) for m, v in want.items()}


def test_checks(spark):
    samples, qrels, routes = snapshot(spark)
    with pytest.raises(ValueError):
        evaluation.evaluate(samples, qrels, routes, 0)
    with pytest.raises(ValueError):
        evaluation.evaluate(samples.where("false"), qrels, routes, 1)
    with pytest.raises(ValueError):
        evaluation.evaluate(samples, qrels.where("query_id <> 'q1'"), routes, 1)


def test_request_validation(spark):
    ok = [("q", ["right"], None)]
    rows = [([], 2), (None, 2), ([None], 2), (ok, 0), (ok, 101), ([(" ", ["right"], None)], 2), ([("q", [], None)], 2), ([("q", [None], None)], 2), (ok, 2)]
    df = spark.createDataFrame(rows, "samples array<struct<question: string, relevantChunkIds: array<string>, expectedAnswer: string>>, topK int")
    assert [r.error is None for r in evaluation.validate_requests(df).collect()] == [False] * 8 + [True]
    assert evaluation.report_lines(spark.createDataFrame([("recall", 0.5, 1, 2)], "metric string, value double, correct long, total long")).first().line == "recall: 0.5000 (1/2)"
