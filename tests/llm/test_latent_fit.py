"""The latent space of op1 is that of all item passages; which documents there are does not change it."""

import numpy as np

from lodestone.llm import decontam


def test_axes_come_from_the_items_alone(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    items = spark.createDataFrame([(i, " ".join(rng.choice(words, 20))) for i in range(6)], "item_id long, text string")
    docs = [" ".join(rng.choice(words, 50)) for _ in range(20)]
    gains = []
    for order in (docs, [" ".join(reversed(d.split())) for d in docs]):  # the same document frequencies, other passages
        table = spark.createDataFrame([(d,) for d in order], "text string")
        (index, _), = decontam._each_pass(spark, table, items)
        gains.append([b.gain for b in index.blocks])
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(*gains, strict=True))
    found = decontam.find_leaks(spark.createDataFrame([(1, items.first()["text"]), (2, "nothing here")], "doc_id long, text string"), items)
    assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(1, 0)]
