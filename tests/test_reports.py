"""JSON inputs, the report of a frozen snapshot, and tombstones."""

import hashlib
import json

import pytest

from lodestone.operators import indexing
from lodestone.plans import api
from lodestone.sources import json_inputs

from test_fusion_eval import SNAPSHOT


def _snapshot(folder):
    queries = [{"question": q, "category": "c", "relevantChunkIds": rel, "vector": v, "bm25": b} for q, rel, v, b in SNAPSHOT]
    path = folder / "snapshot.json"
    path.write_text(json.dumps({"snapshotId": "s1", "provenance": "made", "topK": 2, "rankConstant": 60, "queries": queries}, indent=1))
    return path


def test_ablation_report(spark, tmp_path):
    path = _snapshot(tmp_path)
    for _ in range(2):
        api.ablation(spark, str(path), str(tmp_path / "report"))
    metrics = spark.read.json(str(tmp_path / "report/metrics")).collect()
    got = {(r.route, r.metric): r.value for r in metrics}
    assert len(metrics) == 12 and {r.snapshotSha256 for r in metrics} == {hashlib.sha256(path.read_bytes()).hexdigest()}
    assert got["vector", "recall"] == 0.625 and got["bm25", "recall"] == 0.375 and got["rrf", "mrr"] == 0.5
    lists = {(r.route, r.question): r.retrieved for r in spark.read.json(str(tmp_path / "report/samples")).collect()}
    assert len(lists) == 12 and lists["rrf", "q2"] == ["common", "recovery"]
    assert lists["vector", "q4"] == [] and lists["rrf", "q4"] == []


def test_one_snapshot_only(spark, tmp_path):
    path = _snapshot(tmp_path)
    (tmp_path / "two.json").write_text(path.read_text())
    with pytest.raises(ValueError):
        api.ablation(spark, str(tmp_path / "*.json"), str(tmp_path / "report"))


def test_requests(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"question": "a", "topK": 3}\n{"question": null}\n')
    assert [(r.question, r.topK) for r in json_inputs.read_requests(spark, str(tmp_path / "q.json")).collect()] == [("a", 3), (None, None)]
    (tmp_path / "e.json").write_text('{"samples": [{"question": "a", "relevantChunkIds": ["x"]}], "topK": 2}\n')
    assert json_inputs.read_eval_requests(spark, str(tmp_path / "e.json")).first().samples[0].relevantChunkIds == ["x"]
    (tmp_path / "bad.json").write_text("{broken\n")
    with pytest.raises(Exception):
        json_inputs.read_requests(spark, str(tmp_path / "bad.json")).collect()


def test_tombstones(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "chunk_id string, n int").write.parquet(str(tmp_path / "t"))
    for ids in ([("a",), (None,)], [("a",), ("zz",)]):
        indexing.soft_delete(spark.createDataFrame(ids, "chunk_id string"), str(tmp_path / "dead"))
    indexing.purge(spark, str(tmp_path / "t"), str(tmp_path / "dead"), str(tmp_path / "new"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "new")).collect()) == [3, 4]
