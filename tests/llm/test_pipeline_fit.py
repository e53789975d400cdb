"""The pipeline's decontamination fits its latent spaces to all documents, once for each block, and leaves no table of terms behind."""

from lodestone.llm import common, decontam


def test_drop_leaks_fits_all_documents(spark, monkeypatch):
    seen = []
    axes = decontam.latent_axes
    monkeypatch.setattr(decontam, "latent_axes", lambda terms, docs_n, *a: seen.append((terms.count(), docs_n)) or axes(terms, docs_n, *a))
    leak = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([leak, "one and two " * 40, "nothing of it", None, *["two plain words"] * 300])], "doc_id long, text string")
    with common.tables() as own:
        kept = decontam.drop_leaks(docs, spark.createDataFrame([(7, leak), (8, "six five")], "item_id long, text string"))
    assert seen == [(302, 304)] * 2 and not [t for t in own if "lsa-terms" in t]  # a block of long items and one of short ones
    assert sorted(r.doc_id for r in kept.collect()) == list(range(1, 304))
