"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted, discard, marked, need, read, stored, trimmed, words
from .components import connected_components, lowest

#: Texts are hashed this many shingles at a time, however long they are.
STEP = 1 << 16
#: A key with more fingerprints than this is not compared within; its fingerprints are cut further.
GROUP = 2048
#: Keys are broadcast up to this many (16 bytes each), and joined by a shuffle beyond.
BROADCAST_KEYS = 1_000_000
#: Bands of minima of the shingle hashes, and minima in each: texts of similarity 0.8 share a band
#: with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.996, texts of 0.9 nearly always.
BANDS, ROWS = 14, 5
#: Keys of up to so many texts have all pairs compared at once; those of larger keys are taken in rounds.
SMALL_KEY = 64
#: Texts of a larger key that travel as one block.
BLOCK = 128


def shingles(text: str | None, size: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles, repeats included, in runs of ``STEP``; of a shorter text all its words are one."""
    w = words(text)
    if not w:
        return
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w))) + np.arange(len(w))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(w) - size + 1)
    lo, hi = starts[:n].tolist(), (ends[size - 1 :] if len(w) >= size else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, STEP):
        yield np.fromiter([digest(joined[s:e], 42) for s, e in zip(lo[a : a + STEP], hi[a : a + STEP], strict=True)], np.uint64)


def fingerprint(text: str | None, size: int) -> int:
    """64-bit SimHash of the word shingles, repeats included; without words it is 0."""
    return _simhash(shingles(text, size))


def _simhash(runs: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in runs:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, ``fp`` the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return need(docs, (id_col, text_col)).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, fp long")


def cut(bits: list[int], parts: int) -> list[list[int]]:
    """Bit numbers in ``parts`` runs whose lengths differ by one at most."""
    ends = [len(bits) * k // parts for k in range(parts + 1)]
    return [bits[a:z] for a, z in zip(ends, ends[1:], strict=False) if z > a]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def variants(bits: list[int], differing: int) -> list[tuple[int, int]]:
    """(kept mask, wildcard mask) of every signature: each segment whole, and with each of its bits left out."""
    out = []
    for segment in cut(bits, differing // 2 + 1):
        whole = sum(1 << b for b in segment)
        out += [(whole, 0)] + [(whole & ~(1 << b), 1 << b) for b in segment]
    return out


def _signatures(fps: DataFrame, bits: list[int], differing: int, nested: bool) -> DataFrame:
    """Rows (fp, c, key, no, wild): fingerprints with one key agree in segment variant ``no``, but for the wild bit.

    The key is a digest; were two to collide, the pairs would fail verification.
    """
    masks = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(_signed(keep)).alias("keep"), F.lit(_signed(wild)).alias("wild")) for k, (keep, wild) in enumerate(variants(bits, differing))])
    above = [F.col("above")] if nested else []
    rows = fps.withColumn("m", F.explode(masks))
    return rows.select("fp", "c", F.xxhash64(F.col("m.no"), F.expr("fp & m.keep"), *above).alias("key"), F.col("m.no").alias("no"), F.col("m.wild").alias("wild"))


def _verified(a: str, b: str, differing: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= differing


def links(fps: DataFrame, differing: int, group: int = GROUP) -> DataFrame:
    """Pairs ``(u, v)`` of distinct fingerprints that differ in ``differing`` bits or fewer; none is missed.

    The 64 bits are cut into ``differing // 2 + 1`` segments, so one of them has at
    most one differing bit, and the pair shares that segment whole or with one bit
    left out.  Keys of two fingerprints are settled by their minimum and maximum
    alone; keys of up to ``group`` by an equality join whose condition counts bits,
    so unlinked pairs are never rows.  A key above that is never compared within:
    its members are cut again over the bits the key leaves open, with the same
    argument, until the groups are small or no bits are left to tell them apart.
    With a column ``c`` (a component known already) only pairs of different ``c``
    are found; a fingerprint may then be in several rows.
    """
    found = []
    known = "c" in fps.columns
    fps = fps if known else fps.withColumn("c", F.col("fp"))
    # Each entry: fingerprints (below the first level with the key above), and the bits still open.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a row becomes dozens of signatures, so rows are dealt first
    queue: list[tuple[DataFrame, list[int], bool]] = [(fps.repartition(parts, "fp"), list(range(64)), False)]
    while queue:
        rows, bits, nested = queue.pop()
        signed = _signatures(rows, bits, differing, nested)
        ends = [F.min("c").alias("cl"), F.max("c").alias("ch")] if known else []
        stats = signed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), *ends).where("n > 1 AND lo <> hi")
        stats = stored(stats.where("cl <> ch") if known else stats, "sim-keys")
        found.append(stats.where("n = 2").where(_verified("lo", "hi", differing)).select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        more, crowded = counted(stats.where("n > 2").select("key", "n"), "sim-crowded")
        if not crowded:
            continue
        members = stored(signed.join(F.broadcast(more) if crowded <= BROADCAST_KEYS else more, "key"), "sim-members")
        some = members.where(F.col("n") <= group)
        a, b = some.select("key", "wild", F.col("fp").alias("u"), F.col("c").alias("cu")), some.select("key", F.col("fp").alias("v"), F.col("c").alias("cv"))
        # With a wild bit only the two values of that bit are new to each other; equal ones meet under the whole segment.
        found.append(a.join(b, "key").where("u < v").where("cu <> cv").where("wild = 0 OR ((u ^ v) & wild) <> 0").where(_verified("u", "v", differing)).select("u", "v"))
        large = members.where(F.col("n") > group)
        if large.isEmpty():
            continue
        first = 0
        for segment in cut(bits, differing // 2 + 1):
            last = first + len(segment)
            rest = [x for x in bits if x not in segment]
            inside = large.where(F.col("no").between(first, last)).select("fp", "c", F.col("key").alias("above"))
            if rest:  # without further bits a key has two fingerprints at most
                queue.append((inside, rest, True))
            first = last + 1
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.distinct()


def simhash_classes(docs: DataFrame, size: int = 5, differing: int = 3, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``(doc_id, fp, component_id)``: documents whose fingerprints are linked, directly or by steps.

    Equal fingerprints are one class before anything is compared, so a group of
    copies costs one row.  ``component_id`` is the smallest id reachable.

    Null and empty texts have fingerprint 0 and are linked like any other.  A null
    id gets its class like any row, but names none unless all ids of the class are
    null.  Repeated rows stay.  An empty table gives an empty result.
    """
    fp = stored(fingerprints(docs, size, id_col, text_col), "sim-fps")
    classes = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "sim-classes")
    found = connected_components(links(classes.select("fp"), differing, group))
    joined = stored(classes.join(found, classes.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("c")), "sim-joined")
    lows = stored(joined.groupBy("c").agg(F.min("low").alias("component_id")), "sim-lows")
    named = stored(joined.join(lows, "c").select("fp", "component_id"), "sim-named")
    return fp.join(named, "fp").select("doc_id", "fp", "component_id")


_TURNS = np.random.default_rng(17).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64, endpoint=False)


def bands(own: np.ndarray) -> list[int]:
    """A key for each band of minima over the distinct shingle hashes ``own``; no shingles, no keys."""
    if not len(own):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(own), 1024):
        low = np.minimum(low, (own[None, a : a + 1024] * (_TURNS[0] | np.uint64(1)) + _TURNS[1]).min(1))
    return [xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text, fp, sid, n, bands)``, ``sid`` a digest of the set of shingles and ``n`` its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, sid, n, keys = [], [], [], []
            for t in b.column(1):
                h = list(shingles(t.as_py(), size))
                own = np.unique(np.concatenate(h)) if h else np.zeros(0, np.uint64)
                fp.append(_simhash(h))
                sid.append(xxhash.xxh64_intdigest(own.tobytes()))
                n.append(len(own))
                keys.append(np.array(bands(own), np.uint64).view(np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (fp, sid)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *signed, pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text", "fp", "sid", "n", "bands"])

    rows = need(docs, (id_col, text_col)).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(trimmed(run), "doc_id long, text string, fp long, sid long, n long, bands array<long>")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """``(sid, own)``: the sorted hashes of the distinct shingles of ``texts(sid, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(t.as_py(), size)])).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], ["sid", "own"])

    return texts.mapInArrow(trimmed(run), "sid long, own binary")


def _small(keys: DataFrame, label: str) -> DataFrame:
    """``keys`` as a table, to be broadcast if they are counted to be at most BROADCAST_KEYS."""
    table, n = counted(keys, label)
    return F.broadcast(table) if n <= BROADCAST_KEYS else table


def _as_similar(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those distinct pairs ``(u, v)`` of ``sid`` whose sets of shingles have that Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(h.as_buffer(), np.uint64) for h in (x, y))
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["u", "v"])

    asked = _small(pairs.select(F.col("u").alias("sid")).unionAll(pairs.select("v")).distinct(), "sim-asked")
    held = stored(_sets(texts.join(asked, "sid", "left_semi").dropDuplicates(["sid"]), size), "sim-sets-asked")
    a, b = held.select(F.col("sid").alias("u"), F.col("own").alias("p")), held.select(F.col("sid").alias("v"), F.col("own").alias("q"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "p", "q").mapInArrow(trimmed(run), "u long, v long")


def _linked_blocks(members: DataFrame, pivots: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Rows ``(u, v)``, linked directly or by steps: ``pivots(key, a, ca)`` against ``members(key, sid, c, texts)`` of their keys, with the sets ``held``.

    Both sides are dealt in blocks, and a task compares two blocks; what it returns is
    for every text the smallest row that it is linked with there, not the pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ps, ms in zip(b.column(0), b.column(1), strict=True):
                (pid, pc, pown), (sid, c, own) = (([x.field("sid").to_numpy(), x.field("c").to_numpy(), [np.frombuffer(o.as_buffer(), np.uint64) for o in x.field("own")]]) for x in (ps.values, ms.values))
                n = np.fromiter(map(len, own), np.int64, len(own))
                every, first = np.concatenate(own), np.cumsum(n) - n
                i, j = [], []
                for k, p in enumerate(pown):
                    could = (c != pc[k]) & (np.minimum(n, len(p)) >= similarity * np.maximum(n, len(p)))
                    if could.any():
                        at = np.minimum(np.searchsorted(p, every), len(p) - 1)
                        both = np.add.reduceat((p[at] == every).astype(np.int64), first)
                        got = np.flatnonzero(could & (both >= similarity * (n + len(p) - both)))
                        i.append(np.full(len(got), len(own) + k))
                        j.append(got)
                if i:
                    names = np.concatenate([sid, pid])
                    low = lowest(len(names), np.concatenate(i), np.concatenate(j))
                    told = np.flatnonzero(low != np.arange(len(names)))
                    yield pa.RecordBatch.from_arrays([pa.array(names[told]), pa.array(names[low[told]])], ["u", "v"])

    lot = lambda x, n: F.pmod(F.xxhash64(F.lit("block"), x), F.ceil(n / BLOCK))
    one = F.collect_list(F.struct("sid", "c", "own"))  # about BLOCK rows
    left = pivots.withColumn("texts", F.lit(1)).select("key", F.col("a").alias("sid"), F.col("ca").alias("c"))
    many = left.groupBy("key").agg(F.count("*").alias("texts"))
    left = left.join(many, "key").join(held, "sid").groupBy("key", lot(F.col("sid"), F.col("texts")).alias("lot")).agg(one.alias("ps"))
    right = members.join(held, "sid").groupBy("key", lot(F.col("sid"), F.col("texts")).alias("lot")).agg(one.alias("ms"))
    spark, name = members.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")  # a row is two blocks
    try:
        return stored(stored(left, "sim-pivots").drop("lot").join(stored(right, "sim-blocks").drop("lot"), "key").select("ps", "ms").mapInArrow(trimmed(run), "u long, v long"), "sim-linked")
    finally:
        spark.conf.set(name, before)


def _united(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``labels(sid, c)`` after the components of both ends of each of ``pairs(u, v)`` are joined."""
    own, other = (labels.select(F.col("sid").alias(x), F.col("c").alias(y)) for x, y in (("u", "cu"), ("v", "cv")))
    found = connected_components(pairs.join(own, "u").join(other, "v"), "cu", "cv")
    return stored(labels.join(found, F.col("c") == F.col("node"), "left").select("sid", F.coalesce("component", "c").alias("c")), "sim-labels")


def _could(n: str, m: str, similarity: float) -> Column:
    """Whether sets of these sizes can be as similar."""
    return F.least(n, m) >= similarity * F.greatest(n, m)


def _compared_keys(sets: DataFrame, members: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(sid, c)``: components over the pairs of ``members(key, sid, n)`` that share a key and are as similar.

    Texts of a key need not all be compared: those of one component have nothing to
    add.  At first every text is compared with the key's most central one, which shares
    its keys with the most texts, as the origin of many copies does.  Then each round
    takes some texts of every key that is not yet one component (all of small keys, 32
    times as many of the others as before, the more central first), none of them in the
    component of the key's most central text, and compares each with all texts of the
    key outside its own component.  A text so taken is done with in that key; the rounds
    end when every key is one component or all its other texts are done, so no pair is
    left out and a group of thousands of near copies costs few comparisons a text.
    """

    def compare(met: DataFrame, labels: DataFrame) -> DataFrame:
        pairs = stored(met.select(F.least("sid", "a").alias("u"), F.greatest("sid", "a").alias("v")).distinct(), "sim-pairs")
        return _as_similar(pairs, texts, size, similarity)

    spark, mark = sets.sparkSession, marked()

    keys = members.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1")
    members = stored(members.join(keys, "key"), "sim-members")
    central = members.groupBy("sid").agg(F.sum("texts").alias("w"))
    members = stored(members.join(central, "sid"), "sim-members")
    first = stored(members.groupBy("key").agg(F.max(F.struct("w", F.col("sid").alias("a"), F.col("n").alias("na"))).alias("t")).select("key", "t.a", "t.na"), "sim-first")
    members = stored(members.join(first, "key"), "sim-members")
    labels = sets.select("sid", F.col("sid").alias("c"))
    labels = _united(labels, compare(members.where("sid <> a").where(_could("n", "na", similarity)), labels))
    discard(spark, mark, members, labels)
    members, held, k = members.select("key", "sid", "n", "texts", "w", F.col("a").alias("first"), F.lit(False).alias("done")), None, 32
    while True:
        named = members.join(labels, "sid")
        state = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.when(F.col("sid") == F.col("first"), F.col("c"))).alias("main")).where("lo <> hi")
        members = stored(named.join(_small(state.select("key", "main"), "sim-open"), "key"), "sim-members")
        lot = F.when(F.col("texts") <= SMALL_KEY, F.col("sid")).otherwise(F.pmod(F.xxhash64("sid", F.lit(k)), F.lit(k)))
        taken = members.where("c <> main AND NOT done").groupBy("key", "texts", lot.alias("lot")).agg(F.max(F.struct("w", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))).alias("t")).select("key", F.col("texts").alias("of"), "t.a", "t.na", "t.ca")
        taken = stored(taken, "sim-taken", measures={"n": F.count(F.lit(1)), "large": F.count_if(F.col("of") > SMALL_KEY)})
        n, large = (taken._measured.get(x) or 0 for x in ("n", "large"))
        if not n:
            discard(spark, mark, labels)
            return labels
        alike = []
        if n > large:  # small keys are done with at once
            met = members.where(F.col("texts") <= SMALL_KEY).join(taken.drop("of"), "key").where("c <> ca").where(_could("n", "na", similarity))
            alike.append(compare(met, labels))
        if large:
            some = taken.where(F.col("of") > SMALL_KEY)
            keys = some.select("key").distinct()
            many = members.where(F.col("texts") > SMALL_KEY).join(F.broadcast(keys) if large <= BROADCAST_KEYS else keys, "key", "left_semi")
            if held is None:  # what is still open later was open now
                asked = _small(many.select("sid").distinct(), "sim-asked")
                held = stored(_sets(texts.join(asked, "sid", "left_semi").dropDuplicates(["sid"]), size).where("length(own) > 0"), "sim-sets-asked")
            alike.append(_linked_blocks(many, some, held, similarity))
        labels = _united(labels, alike[0] if len(alike) == 1 else alike[0].unionAll(alike[1]))
        spent = taken.select("key", F.col("a").alias("sid"), F.lit(True).alias("now"))
        members = members.where(F.col("texts") > SMALL_KEY).join(spent, ["key", "sid"], "left").select("key", "sid", "n", "texts", "w", "first", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        k *= 32


def similar_classes(docs: DataFrame, size: int = 5, differing: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``(doc_id, fp, component_id)``: documents whose sets of shingles are as similar (Jaccard), directly or by steps.

    Candidates are fingerprints at most ``differing`` bits apart and texts that share
    a band of minima; a candidate counts if its exact similarity is enough.  Every
    candidate is compared unless both texts are in one component already.  Texts with
    one set of shingles are one class before anything is compared.  Ids, empty texts and
    repeated rows are as in ``simhash_classes``.
    """
    rows = stored(sketches(docs, size, id_col, text_col), "sim-sketches")
    texts = rows.select("sid", "text")
    sets = stored(rows.groupBy("sid").agg(F.min("doc_id").alias("low"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("bands").alias("bands")), "sim-sets")
    dealt = sets.select(F.explode(F.concat(F.array(F.xxhash64(F.lit("fp"), "fp")), "bands")).alias("key"), "sid", "n")
    labels = _compared_keys(sets, dealt, texts, size, similarity)
    # Fingerprints that differ stand for the texts that have them; only pairs of different components are left to compare.
    byfp = stored(sets.join(labels, "sid").select("fp", "sid", "n", "c"), "sim-byfp")
    near = links(byfp.select("fp", "c").distinct(), differing, group)
    side = lambda x, k: byfp.select(F.col("fp").alias(x), F.col("sid").alias(f"s{k}"), F.col("n").alias(f"n{k}"), F.col("c").alias(f"c{k}"))
    left = near.join(side("u", 1).groupBy("u", "c1").agg(F.min("n1").alias("n1"), F.max("n1").alias("m1")), "u").join(side("v", 2).groupBy("v", "c2").agg(F.min("n2").alias("n2"), F.max("n2").alias("m2")), "v")
    left = stored(left.where("c1 <> c2").where((F.col("m1") >= similarity * F.col("n2")) & (F.col("m2") >= similarity * F.col("n1"))).select("u", "v", "c1", "c2"), "sim-left")
    met = left.join(side("u", 1), ["u", "c1"]).join(side("v", 2), ["v", "c2"]).where(_could("n1", "n2", similarity))
    pairs = stored(met.select(F.least("s1", "s2").alias("u"), F.greatest("s1", "s2").alias("v")).distinct(), "sim-pairs")
    alike = _as_similar(pairs, texts, size, similarity)
    found = _united(labels, alike)
    joined = stored(sets.select("sid", "low").join(found, "sid"), "sim-joined")
    lows = stored(joined.groupBy("c").agg(F.min("low").alias("component_id")), "sim-lows")
    named = stored(joined.join(lows, "c").select("sid", "component_id"), "sim-named")
    return rows.select("doc_id", "fp", "sid").join(named, "sid").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, size: int = 5, differing: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """Keep one document, that of the smallest id, of each class; all columns stay.

    With ``similarity`` classes are those of ``similar_classes``, else of ``simhash_classes``.

    Rows that share the smallest id of their class (repeated ids) collapse to one.
    A row without id is compared with the others but never removed, as nothing
    could say which of several it is.
    """
    key = F.col(f"`{id_col}`")
    if similarity is None:
        classes = simhash_classes(docs, size, differing, id_col, text_col)
    else:
        classes = similar_classes(docs, size, differing, similarity, id_col, text_col)
    keep = classes.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.where(key.isNotNull()).join(keep, key == F.col("__kept"), "left_semi")
    if not named.groupBy(key).count().where("count > 1").isEmpty():
        named = named.dropDuplicates([id_col])
    return named.unionByName(docs.where(key.isNull()))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return simhash_classes(docs, size=3, differing=2).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
