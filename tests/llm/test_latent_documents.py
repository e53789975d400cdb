"""The latent space of op1 is fitted to all documents, whole, and to all item passages."""

import numpy as np

from lodestone.llm import common, decontam
from lodestone.llm.wordscan import Vocabulary


def _space(rows, k):
    return np.linalg.svd(rows, full_matrices=False)[2][:k].T


def test_axes_are_those_of_all_documents_and_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "RANK", 6)
    monkeypatch.setattr(decontam, "FIT_ROWS", 16)
    rng = np.random.default_rng(8)
    words = [b"w%d" % k for k in range(90)]
    topics = rng.dirichlet(np.full(90, 0.05), 6)
    docs = [b" ".join(rng.choice(np.array(words), rng.integers(1, 400), p=topics[i % 6])).decode() + " other words" for i in range(301)] + [None, "", "none of them"]
    table = spark.createDataFrame([(d,) for d in docs], "text string").repartition(5)
    weight = 1 + rng.random(90)
    chosen = np.sort(rng.permutation(90)[:70])  # the block's words
    row = np.full(90, -1, np.int32)
    row[chosen] = np.arange(70)
    unit = rng.random((3, 70))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    terms = common.stored(decontam.item_terms(table, words), "test-terms")
    assert terms.count() == 301
    v = decontam.latent_axes(terms, 301, unit, row, weight[chosen])
    count = {w: k for k, w in enumerate(words)}
    a = np.zeros((301, 90))
    for i, d in enumerate(docs[:301]):
        np.add.at(a[i], [count[w] for w in d.encode().split() if w in count], 1)
    a = a[:, chosen] * weight[chosen]
    a = a[a.any(1)]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    want = _space(np.vstack([a, np.sqrt(301 / 3) * unit]), 6)
    assert np.linalg.svd(want.T @ v, compute_uv=False).min() > 0.999
    part = _space(np.vstack([a[:100], np.sqrt(301 / 3) * unit]), 6)  # fewer documents, or none, give other axes
    assert np.linalg.svd(part.T @ v, compute_uv=False).min() < 0.999
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-8)


def test_terms_are_exact_counts_of_whole_texts(spark):
    words = [b"a", b"bc", b"x" * 40, b"x" * 39 + b"y"]
    texts = ["a A, a. bc", "bc " * 70_000 + "x" * 40, "zz " * 500_000 + "x" * 39 + "y"]
    got = decontam.item_terms(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), words).collect()
    assert [(r.n, r.tf) for r in got] == [([0, 1], [3, 1]), ([1, 2], [70_000, 1]), ([3], [1])]
    assert len(Vocabulary(words, decontam.BITS).bins) == 4
