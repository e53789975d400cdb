"""Scans score whole chunks in the task that reads them: what they shuffle, and what they give for odd input."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import retrieval, scoring


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def plain_bm25(questions, chunks, k):
    """The formula, with rows of one id and length as one text."""
    texts, size = defaultdict(list), []
    for c, t in chunks:
        if t is not None:
            size.append(len(t.split()))
            texts[c, len(t.split())] += t.split()
    df = Counter(w for t in texts.values() for w in set(t))
    n, avg = len(size), sum(size) / len(size)
    out = []
    for q, asked in questions:
        scores = defaultdict(float)
        for (c, dl), t in texts.items():
            tf = Counter(t)
            for w in asked.split():
                if tf[w]:
                    scores[c] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.2 * (0.25 + 0.75 * dl / avg))
        best = sorted(((-round(s, 6), c) for c, s in scores.items()), key=lambda x: (x[0], x[1]))[:k]
        out += [(q, c, -s) for s, c in best]
    return sorted(out)


@pytest.mark.parametrize("pairs", [50_000, 3])
def test_bm25_shuffles_only_the_best_of_each_task(spark, monkeypatch, pairs):
    monkeypatch.setattr(retrieval, "PAIRS", pairs)
    rng = random.Random(4)
    chunks = [(i, " ".join(rng.choices("abcdefgh", range(8, 0, -1), k=rng.randrange(1, 20)))) for i in range(300)]
    chunks += [(i, chunks[7][1]) for i in range(300, 340)] + [(3, "a b c"), (3, "c c a"), (3, "h"), (5, None), (400, "")]
    questions = [(0, "a b"), (1, "h h g"), (2, "c"), (3, "z"), (4, chunks[7][1])]
    q, c = spark.createDataFrame(questions, "query_id long, question string"), spark.createDataFrame(chunks, "chunk_id long, content string").repartition(3)
    got = retrieval.bm25_topk(q, c, 10)
    want = plain_bm25(questions, chunks, 10)
    rows = sorted((r["query_id"], r["chunk_id"], r["score"]) for r in got.collect())
    assert [r[:2] for r in rows] == [r[:2] for r in want] and np.allclose([r[2] for r in rows], [r[2] for r in want])
    once = retrieval.bm25_topk(q, c.where("chunk_id > 5"), 10)
    assert exchanges(once) == ["query_id"]


def test_vectors_are_not_paired_row_by_row(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4 if i % 5 else 3)]) for i in range(120)] + [(200, None), (201, [0.0, 0.0, 0.0])] + [(i, [1.0, 2.0, 3.0]) for i in range(210, 240)]
    df = spark.createDataFrame(vectors, "chunk_id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v) for i, v in vectors if i % 10 == 0], "query_id long, vector array<double>")
    got = retrieval.vector_topk(asked, df, 6, 0.2)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and exchanges(got) == ["query_id"]
    want = []
    for i, q in vectors:
        if i % 10 == 0 and q and any(q):
            near = [(-round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 6), c) for c, v in vectors if v and any(v) and len(v) == len(q)]
            want += [(i, c, -s) for s, c in sorted(x for x in near if -x[0] >= 0.2)[:6]]
    assert sorted((r["query_id"], r["chunk_id"], r["score"]) for r in got.collect()) == sorted(want)


def test_best_holds_few_and_breaks_ties_by_id(monkeypatch):
    monkeypatch.setattr(scoring, "HELD", 8)
    rng = np.random.default_rng(1)
    best, ids = scoring.Best(5, 3), rng.permutation(400)
    scores = rng.integers(0, 6, (5, 400)) / 4
    for a in range(0, 400, 50):
        order = np.argsort(ids[a : a + 50])
        best.offer(0, pa.array(ids[a : a + 50][order]), scores[:, a : a + 50][:, order], scores[:, a : a + 50][:, order] > 0)
        assert best.held <= 200
    q, found, score = best.result()
    for k in range(5):
        want = sorted((-s, i) for s, i in zip(scores[k], ids, strict=True))[:3]
        assert sorted((-s, i) for n, i, s in zip(q, found.to_pylist(), score, strict=True) if n == k) == want
