"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, marked, stored

#: Edges (two ids each) up to this many are worked on by one task, without shuffles; they are counted first.
FEW_EDGES = 1 << 18


def _state() -> dict[str, Column]:
    """Row count and an order-free digest, to see whether a round changed anything."""
    return {"n": F.count(F.lit(1)), "x": F.expr("bit_xor(xxhash64(a, b))")}


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node of an edge, ``component`` the smallest node reachable.

    Alternating large-star and small-star rounds, O(log^2 n) of them in the worst
    case.  Every round is two aggregations with map-side combining and two
    equi-joins whose sides are both dealt by the join, so that adaptive execution
    splits a hub with a third of all edges.  Each round ends in a written table.
    Nothing but a count and a digest reaches the driver.

    Once no more than ``FEW_EDGES`` edges are left, which are counted, one task of a
    scan reads them and labels their nodes: rounds on so few rows cost more than the rows do.

    Nulls in either column and self-loops are ignored, repeated edges count once.
    An empty table gives an empty result.  Ids may be of any ordered type.
    """
    x, y, mark = F.col(f"`{u}`"), F.col(f"`{v}`"), marked()
    e = stored(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "cc-edges", measures=_state())
    state = e._measured
    if not state.get("n"):
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        if state["n"] <= FEW_EDGES:
            out = stored(_labelled(e), "cc-labels")
            discard(e.sparkSession, mark, out)
            return out
        ends = F.array(*[F.struct(F.col(n).alias("n"), F.col(v).alias("v")) for n, v in (("a", "b"), ("b", "a"))])
        both = e.select(F.inline(ends))
        low = stored(both.groupBy("n").agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m")), "cc-low")
        large = both.where("v > n").join(low, "n").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "cc-large")
        root = stored(large.groupBy("a").agg(F.min("b").alias("m")), "cc-root")
        # An edge (a, b) gives (b, m) for the smallest neighbour m of a, and the edge to m itself stays.
        kept = F.when(F.col("b") == F.col("m"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(root, "a").select(kept.alias("e")).select("e.a", "e.b").distinct()
        e = stored(small, "cc-edges", measures=_state())
        before, state = state, e._measured
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    discard(e.sparkSession, mark, e)
    pairs = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _labelled(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of at most ``FEW_EDGES`` edges ``(a, b)``, in one task."""
    kind = edges.schema["a"].dataType

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [pa.concat_arrays(x) for x in zip(*((b.column(0), b.column(1)) for b in batches), strict=True)]
        if ends:
            ids, at = np.unique(pa.concat_arrays(ends).to_numpy(zero_copy_only=False), return_inverse=True)
            low = lowest(len(ids), at[: len(ends[0])], at[len(ends[0]) :])
            yield pa.RecordBatch.from_arrays([pa.array(ids, ends[0].type), pa.array(ids[low], ends[0].type)], ["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(label, StructType().add("node", kind).add("component", kind))


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest it is linked with over the edges (i, j), directly or by steps."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
