"""What grows with the input: how often texts are dealt, how many tasks build an index, what a unit vector costs."""

import re

from pyspark.sql import functions as F

from jobs import index_documents
from lodestone.functions.vectors import unit
from lodestone.operators import textindex


def test_changed_texts_are_dealt_once_by_id(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        named = spark.createDataFrame([("1", "a", "x"), ("1", "b", "y"), ("1", "b", "y"), ("2", "c", "z"), ("3", "d", "w")], "doc_id string, text string, md5 string")
        fresh = index_documents._fresh(named, spark.createDataFrame([("1", "y"), ("2", "z")], "doc_id string, md5 string"))
        keys = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", fresh._jdf.queryExecution().executedPlan().toString())
        assert len(keys) == 2 and all(re.fullmatch(r"doc_id#\d+", k) for k in keys), keys
        assert sorted(map(tuple, fresh.collect())) == [("1", "b", "y"), ("2", "c", "z")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tasks_of_a_build_grow_with_the_text():
    assert textindex._tasks(1, 100, 8) == 1 and textindex._tasks(64, 100, 8) == 16
    assert textindex._tasks(64, 100 * textindex.TASK, 8) == 100


def test_the_length_of_a_vector_is_taken_once(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,), ([None, 1.0],)]
    df = spark.createDataFrame(rows, "v array<float>").select(unit(F.col("v")).alias("u"))
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], None, None, None, None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # What divides a component is a variable, no sum over the vector.
    assert "aggregate(" in plan and not re.search(r"/ (?:SQRT|sqrt)\(", plan)
