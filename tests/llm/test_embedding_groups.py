"""op8 sends a vector once for each group of tiles, not once for each block of vectors."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import embeddings


def _links(x, threshold=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    label = np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return [(int(n) - 1, int(c)) for n, c in zip(near.sum(1), label, strict=True)]
        label = new


def _table(spark, seed, n, dim, clusters, copies):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.standard_normal((n, dim)), *[c + 0.05 * rng.standard_normal((copies, dim)) for c in rng.standard_normal((clusters, dim))]])
    x = x.astype(np.float32)[rng.permutation(len(x))] if clusters else x.astype(np.float32)
    return x.astype(np.float64), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def _check(spark, x, df):
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_classes(df).collect()}
    assert [got[i] for i in range(len(x))] == _links(x)


def test_links_across_and_inside_many_groups(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    monkeypatch.setattr(embeddings, "CELLS", 5)  # several pairs of groups in a task
    monkeypatch.setattr(embeddings, "EDGES", 50)
    _check(spark, *_table(spark, 1, 700, 24, 6, 60))
    _check(spark, *_table(spark, 2, 300, 6, 3, 40))  # fewer dimensions than the leading ones


def test_a_vector_is_sent_to_no_more_pairs_than_there_are_groups(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    tables = []
    store = embeddings.stored
    monkeypatch.setattr(embeddings, "stored", lambda df, label, *a, **k: tables.append((label, store(df, label, *a, **k))) or tables[-1][1])
    embeddings.embedding_classes(_table(spark, 3, 1500, 16, 0, 0)[1])
    blocks = dict(tables)["emb-blocks"]
    assert blocks.count() > 60 and blocks.agg(F.max(F.size("to"))).first()[0] <= embeddings.GROUPS


def test_settled_agrees_with_plain_cosines():
    rng = np.random.default_rng(5)
    for dim in (3, 16, 20, 40, 100):
        a, b = rng.standard_normal((60, dim)), rng.standard_normal((50, dim))
        b[:20] = a[:20] * 3 + 0.2 * rng.standard_normal((20, dim))
        cos = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        i, j = embeddings.compare(a, b, np.linalg.qr(rng.standard_normal((dim, dim)))[0], 0.95)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(cos >= 0.95).tolist()))


def test_groups_cover_every_block_once():
    first, tiles = embeddings.groups_of(np.array([10, 100, 5, 40]), np.array([1, 10, 1, 4]), 30)
    assert first.tolist() == [0, 10, 110, 115] and [t.tolist() for t in tiles] == [[0, 1], [1], [1], [1, 2, 3], [3]]
