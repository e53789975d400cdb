"""Mixing sources to target weights by entropy balancing, as DataFrame operations only."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, need, read, stored

#: Sources are rows of a table on the driver; more than this are refused.
MAX_SOURCES = 100_000
#: Values of the rounding order that one refinement tells apart.
BINS = 1 << 12
ROUNDS = 5


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight; no share exceeds ``cap`` times its size, the excess is shared anew."""
    out, free = [0.0] * len(sizes), [k for k, s in enumerate(sizes) if s > 0]
    left = min(total, cap * sum(sizes))
    while free:
        unit = left / sum(weights[k] for k in free)
        over = [k for k in free if unit * weights[k] > cap * sizes[k]]
        if not over:
            for k in free:
                out[k] = unit * weights[k]
            break
        for k in over:
            out[k] = cap * sizes[k]
            left -= out[k]
        free = [k for k in free if k not in set(over)]
    return out


def _table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A few rows as a plan literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def rate(tilt: Column, x: Column, cap: float) -> Column:
    """The tilted rate ``min(cap, exp(tilt * x))``; the exponent is held where exp is finite."""
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), tilt * x)))


def solve_tilts(cells: DataFrame, targets: dict[str | None, float], totals: dict[str | None, tuple[int, int]], cap: float, tolerance: float = 1e-9, rounds: int = 80) -> dict[str | None, float]:
    """Newton's method on the convex dual, one multiplier a source.

    The primal is: rates r_i of least relative entropy to "each document once",
    0 <= r_i <= cap, so that the words r_i * n_i of a source add up to its target.
    Its dual has gradient sum(n_i r_i) - T and curvature sum of n_i x_i r_i over the
    documents below the cap, with r_i = min(cap, exp(tilt * x_i)) and x_i the size
    in units of the source's mean.  Each round is one aggregation over ``cells``
    (source, size, documents), and only two sums a source reach the driver, where
    the step is kept inside the bracket that the gradients seen so far prove.
    """
    spark = cells.sparkSession
    tilts = dict.fromkeys(targets, 0.0)
    low, high = dict.fromkeys(targets, -math.inf), dict.fromkeys(targets, math.inf)
    open_ = {s for s, t in targets.items() if totals[s][0] > 0}
    for s in list(open_):
        if targets[s] >= cap * totals[s][0]:  # every rate is at the cap
            tilts[s] = 1e6
            open_.discard(s)
    for _ in range(rounds):
        if not open_:
            break
        now = _table(spark, [{"k": s, "tilt": tilts[s], "mean": totals[s][0] / totals[s][1]} for s in open_], "k string, tilt double, mean double")
        x = F.col("size") / F.col("mean")
        r = rate(F.col("tilt"), x, cap)
        # At most MAX_SOURCES rows are broadcast.
        got = cells.join(F.broadcast(now), cells.source.eqNullSafe(now.k)).groupBy("source").agg(F.sum(r * F.col("size") * F.col("docs")).alias("g"), F.sum(F.when(r < cap, r * x * F.col("size") * F.col("docs")).otherwise(0.0)).alias("h")).collect()
        for row in got:
            s, g = row["source"], row["g"] - targets[row["source"]]
            if abs(g) <= tolerance * max(1.0, targets[s]):
                open_.discard(s)
                continue
            if g < 0:
                low[s] = tilts[s]
            else:
                high[s] = tilts[s]
            step = tilts[s] - g / row["h"] if row["h"] > 0 else math.nan
            if not low[s] < step < high[s] or abs(step - tilts[s]) > 50:
                if math.isinf(low[s]) or math.isinf(high[s]):
                    step = tilts[s] + (1 if g < 0 else -1) * max(1.0, abs(tilts[s]))
                else:
                    step = (low[s] + high[s]) / 2
            if step == tilts[s]:
                open_.discard(s)
            tilts[s] = step
    if open_:
        raise RuntimeError(f"no tilt found in {rounds} rounds for {sorted(map(str, open_))[:5]}")
    return tilts


def _sized(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, text, source, ...)`` with their ``size`` in words and a ``hash`` of id and text."""
    return rows.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("hash", F.xxhash64(F.lit(7), "doc_id", F.coalesce("text", F.lit(""))))


def _rated(sized: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """With ``rate``, its ``whole`` part, and the ``order`` in which fractions are rounded up."""
    rated = sized.join(F.broadcast(plan), sized.source.eqNullSafe(plan.k)).withColumn("rate", F.when(F.col("size") > 0, rate(F.col("tilt"), F.col("size") / F.col("mean"), cap)).otherwise(0.0))
    part = F.col("rate") - F.floor("rate")
    # A uniform number over the fraction: documents below a threshold near 1 are rounded up.
    return rated.withColumn("whole", F.floor("rate").cast("long")).withColumn("order", F.when(part > 0, F.pmod("hash", F.lit(1 << 52)) / F.lit(float(1 << 52)) / part))


def _copied(rated: DataFrame, limit: DataFrame) -> DataFrame:
    up = F.col("order") <= F.try_element_at("cuts", _class().cast("string"))
    return rated.join(F.broadcast(limit), rated.source.eqNullSafe(limit.c)).withColumn("copies", F.col("whole") + F.when(up, 1).otherwise(0))


def _planned(slim: DataFrame, weights: Sequence[float], share: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """A row a source: what ``_rated`` and what ``_copied`` need to know of it."""
    spark = slim.sparkSession
    cells = stored(slim.groupBy("source", "size").agg(F.count("*").alias("docs")), "mix-cells")
    found = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("words"), F.sum(F.when(F.col("size") > 0, F.col("docs")).otherwise(0)).alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in found]
    shares = water_fill(sizes, [weights[k % len(weights)] for k in range(len(found))], share * sum(sizes), cap)
    targets = {r["source"]: t for r, t in zip(found, shares, strict=True)}
    totals = {r["source"]: (r["words"], r["docs"]) for r in found}
    tilts = solve_tilts(cells, targets, totals, cap)
    plan = _table(spark, [{"k": s, "source_size": totals[s][0], "mean": totals[s][0] / max(1, totals[s][1]), "target": targets[s], "tilt": tilts[s]} for s in targets], "k string, source_size long, mean double, target double, tilt double")
    rated = stored(_rated(slim, plan, cap).where("order IS NOT NULL").select("source", "size", "order", ((F.col("rate") - F.col("whole")) * F.col("size")).alias("part"), _class().alias("class")), "mix-rated")
    parts = rated.groupBy("source", "class").agg(F.sum("part").alias("w"), F.sum("size").alias("all")).collect()  # a row for each source and class of sizes
    cuts: dict[str | None, dict[str, float]] = {s: {} for s in targets}
    carry = dict.fromkeys(targets, 0.0)
    # What smaller classes can take less or more than their fractions stand for.
    room = {s: (-sum(r["w"] for r in parts if r["source"] == s), sum(r["all"] - r["w"] for r in parts if r["source"] == s)) for s in {r["source"] for r in parts}}
    for c in sorted({r["class"] for r in parts}, reverse=True):
        wanted = {r["source"]: r["w"] + carry[r["source"]] for r in parts if r["class"] == c}
        for r in (r for r in parts if r["class"] == c):
            less, more = room[r["source"]]
            room[r["source"]] = less + r["w"], more - (r["all"] - r["w"])
        cut, got = _thresholds(spark, rated.where(F.col("class") == c), wanted, room)
        for s, w in wanted.items():
            cuts[s][str(c)], carry[s] = cut[s], w - got[s]
    return plan, _table(spark, [{"c": s, "cuts": c} for s, c in cuts.items()], "c string, cuts map<string, double>")


def _class() -> Column:
    """Documents whose sizes differ by less than four times are of one class."""
    return F.floor(F.log2("size") / 2).cast("int")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies, rate)`` for every document.

    Sizes are words.  Sources in order of code points, null last, get ``weights``
    repeating and share ``share`` of all words, none above ``cap`` times its own.
    Rates come from ``solve_tilts`` and are rounded to whole copies: the whole part
    stays, and the fractions are rounded by a threshold on a hash of (id, text) over
    the fraction.  Each class of sizes has a threshold of its own, which comes nearest to the
    words that its fractions stand for and what larger classes left over or took too
    much, so the last to settle are the smallest documents.  A
    threshold is found by counting words in bins and again within one bin, so no
    task sees more than bins.  Reruns agree, and repeated rows fare alike.

    Sources are few: at most 100,000 or an error.  Null or empty texts have size 0,
    take nothing and have rate 0; a null id is hashed as such.  A source without words
    has target 0.  An empty table gives an empty result.  Further columns are ignored.
    """
    rows = need(docs, (id_col, text_col, source_col)).toDF("doc_id", "text", "source")
    slim = stored(_sized(rows).select("doc_id", "source", "size", "hash"), "mix-docs")
    plan, limit = _planned(slim, weights, share, cap)
    return _copied(_rated(slim, plan, cap), limit).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def _thresholds(spark: SparkSession, rated: DataFrame, wanted: dict[str | None, float], room: dict[str | None, tuple[float, float]]) -> tuple[dict[str | None, float], dict[str | None, float]]:
    """For each source the ``order`` up to which rounding up comes nearest to the words wanted, and the words it gives.

    What is left over (or, below 0, too much) should be little and, which counts twice, lie within ``room``.
    """

    def off(s: str | None, left: float) -> float:
        less, more = room[s]
        return 2 * max(0.0, less - left, left - more) + abs(left)

    cut, got = dict.fromkeys(wanted, -1.0), dict.fromkeys(wanted, 0.0)
    # The window of orders still open, and the words that lie below it.
    low, high, below = dict.fromkeys(wanted, 0.0), dict.fromkeys(wanted, 4.0), dict.fromkeys(wanted, 0)
    open_ = {s for s, w in wanted.items() if w > 0}
    for _ in range(ROUNDS):
        if not open_:
            break
        now = _table(spark, [{"k": s, "low": low[s], "width": high[s] - low[s]} for s in open_], "k string, low double, width double")
        at = (F.col("order") - F.col("low")) / F.col("width")
        inside = rated.where("order IS NOT NULL").select("source", "order", "size").join(F.broadcast(now), F.col("source").eqNullSafe(F.col("k"))).where((at >= 0) & (at < 1))
        bins = inside.groupBy("source", F.floor(at * BINS).alias("bin")).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("order").alias("lo"), F.max("order").alias("top"))
        run = F.sum("w").over(_by_bin())
        # The last bin that ends at or below the wanted words, and the first that ends above: two rows a source.
        marked = bins.withColumn("upto", run).withColumn("want", _lookup({s: wanted[s] - below[s] for s in open_}))
        edge = marked.groupBy("source").agg(F.max_by(F.struct("upto", "top"), F.when(F.col("upto") <= F.col("want"), F.col("bin"))).alias("under"), F.min_by(F.struct("upto", "w", "lo", "top", "n"), F.when(F.col("upto") > F.col("want"), F.col("bin"))).alias("over")).collect()
        seen = set()
        for r in edge:
            s, under, over = r["source"], r["under"], r["over"]
            seen.add(s)
            want = wanted[s] - below[s]
            if under is not None and under["upto"] is not None:
                cut[s], got[s] = under["top"], below[s] + under["upto"]
            if over is None or over["upto"] is None:
                open_.discard(s)
            elif over["lo"] == over["top"]:
                # One document, or several that cannot be told apart: all or none, whichever is nearer.
                if off(s, want - over["upto"]) < off(s, want - (over["upto"] - over["w"])):
                    cut[s], got[s] = over["top"], below[s] + over["upto"]
                open_.discard(s)
            else:
                below[s] += over["upto"] - over["w"]
                low[s], high[s] = over["lo"], math.nextafter(over["top"], math.inf)
        open_ &= seen
    return cut, got


def _by_bin():
    from pyspark.sql import Window

    return Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)


def _lookup(values: dict[str | None, float]) -> Column:
    """A number by source, as a literal of at most MAX_SOURCES entries; null has its own."""
    named = {k: v for k, v in values.items() if k is not None}
    out = F.try_element_at(F.from_json(F.lit(json.dumps(named)), "map<string, double>"), F.col("source")) if named else F.lit(None).cast("double")
    return F.when(F.col("source").isNull(), F.lit(values[None])).otherwise(out) if None in values else out


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it has copies, with all its columns.

    The copies are those of ``mix_sources``: a row's follow from its source, id and
    text, so rows are neither shuffled nor told apart by their ids, which may repeat or
    be null.  Rows without words are left out.  An empty table stays empty.
    """
    rows = need(docs, (id_col, text_col, source_col)).toDF("doc_id", "text", "source")
    plan, limit = _planned(stored(_sized(rows).select("source", "size", "hash"), "mix-docs"), weights, share, cap)
    whole = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    copied = _copied(_rated(_sized(whole), plan, cap), limit).where("copies > 0")
    return copied.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))
