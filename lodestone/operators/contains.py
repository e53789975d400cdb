"""Which texts contain which of many items, as equality joins on anchors and a check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of an anchor.
ANCHOR = 3


def _words(c: Column | str) -> Column:
    return F.split(c, " ")


def _anchors(text: str, n: int) -> Column:
    """Digests of every ``n`` words in a row, once each; the text is split once."""
    own = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n))))
    return F.array_distinct(F.element_at(F.transform(F.array(_words(text)), own), 1))


def contained_items(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct ``(text_id, item_id)`` where a text of ``texts(text_id, text)`` contains, as ``contains`` has it, an item of ``items(item_id, item)``.

    A text is cut at its spaces.  The words of an item but its first and last are whole words of
    every text that contains it, so the item's first three of these (one, where it has
    fewer than three) occur there in a row.  Texts give ids with digests of their words, which
    are joined with those of the items; only texts that share one come back to be checked.
    Items of one or two words have no such words; they, and only they, are compared with every
    text.  Null ids, texts and items match nothing, the empty item matches every text.
    """
    inner = F.slice(_words("item"), F.lit(2), F.greatest(F.size(_words("item")) - 2, F.lit(0)))
    known = items.where("item_id IS NOT NULL AND item IS NOT NULL").select("item_id", "item", inner.alias("inner"))
    some = texts.where("text_id IS NOT NULL AND text IS NOT NULL").select("text_id", "text")
    candidates = None
    for n, which in ((ANCHOR, F.size("inner") >= ANCHOR), (1, F.size("inner").between(1, ANCHOR - 1))):
        asked = known.where(which).select("item_id", "item", F.xxhash64(F.slice("inner", 1, n)).alias("anchor"))
        met = some.select("text_id", F.explode(_anchors("text", n)).alias("anchor")).join(asked, "anchor").select("text_id", "item_id", "item")
        candidates = met if candidates is None else candidates.unionByName(met)
    found = candidates.distinct().join(some, "text_id").where(F.contains("text", "item"))
    short = some.join(known.where(F.size("inner") == 0), F.contains("text", "item"))
    return found.select("text_id", "item_id").unionByName(short.select("text_id", "item_id")).distinct()
