"""Embedding near-duplicates by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, read, stored, trimmed
from .components import connected_components, lowest

#: Vectors compared as one block, and the most tiles that space is cut into (their boxes are on the driver).
BLOCK = 1024
TILES = 1 << 13
#: Neighbouring tiles are dealt as groups, of each of which a task holds one: this many, more where one had more bytes (as doubles).
GROUPS, GROUP_BYTES = 8, 64 << 20
#: Partitions that pairs of groups are dealt over at most, and edges after which a task brings those of its pair together.
CELLS, EDGES = 4096, 1 << 21
#: Vectors from which the tiles' cutting planes are taken (every vector is put in a tile).
SAMPLE = 20_000
#: Leading dimensions that tile boxes cover.
BOX = 8
#: Leading dimensions by which pairs are dropped, before all.
LEADING = (16, 32)
#: Slack on bounds, far above rounding in doubles and far below any real margin; in single precision so much a dimension.
EPS, SINGLE = 1e-9, 2.0**-23


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are brought near 1 by a power of two first, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def second_moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of outer products of the unit vectors; each task adds up its own, dim * dim numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim)
                x = _unit(x)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["k", "v"])

    got = vectors.select("embedding").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(dim * dim)
    for r in got:
        out[r["k"]] = r["v"]
    return out.reshape(dim, dim)


def principal_axes(moments: np.ndarray) -> np.ndarray:
    """Orthonormal columns by falling share of the vectors' length."""
    values, axes = np.linalg.eigh((moments + moments.T) / 2)
    return axes[:, np.argsort(-values, kind="stable")]


def cutting_planes(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A k-d tree as (axis, threshold) arrays by level, cut at medians of the widest axis."""
    groups, levels = [points], []
    for _ in range(depth):
        axes, cuts, below = np.zeros(len(groups), int), np.zeros(len(groups)), []
        for k, g in enumerate(groups):
            if len(g) > 1:
                axes[k] = int(np.argmax(g.std(0)))
                cuts[k] = np.median(g[:, axes[k]])
            left = g[:, axes[k]] <= cuts[k] if len(g) else np.zeros(0, bool)
            below += [g[left], g[~left]]
        levels.append((axes, cuts))
        groups = below
    return levels


def tile_of(points: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    for axes, cuts in levels:
        at = 2 * at + (points[np.arange(len(points)), axes[at]] > cuts[at])
    return at


@dataclass
class Rows:
    """Vectors ready to be compared: brought near 1 by powers of two, their norms, unit vectors on the axes (single precision), suffix norms by beginning."""

    own: np.ndarray
    norm: np.ndarray
    unit: np.ndarray
    rest: dict[int, np.ndarray]

    @classmethod
    def of(cls, a: np.ndarray, axes: np.ndarray) -> Rows:
        a = np.ldexp(a, -np.frexp(np.abs(a).max(1, initial=0))[1][:, None])  # exact, and no square overflows
        norm = np.linalg.norm(a, axis=1)
        x = (a / norm[:, None]) @ axes
        return cls(a, norm, x.astype(np.float32), {k: np.sqrt((x[:, k:] ** 2).sum(1)).astype(np.float32)[:, None] for k in LEADING if k < x.shape[1]})

    def leading(self, k: int) -> np.ndarray:
        """The first ``k`` dimensions, and the suffix norm as one more: products of these are at least the cosines."""
        return np.hstack([self.unit[:, :k], self.rest[k]]) if k in self.rest else self.unit


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with cosine >= ``threshold`` (see ``settled``)."""
    return settled(Rows.of(a, axes), Rows.of(b, axes), threshold)


def settled(p: Rows, q: Rows, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with cosine >= ``threshold``.

    Leading dimensions come first; what the rest can add is at most the product of
    the suffix norms.  Pairs that cannot reach the threshold, with slack for single
    precision, are dropped as soon as few are left; those are settled by exact cosines
    in double precision.
    """
    dim = p.own.shape[1]
    for upto in (*LEADING, dim):
        score = p.leading(upto) @ q.leading(upto).T
        at = np.flatnonzero(score >= threshold - (dim + 8) * SINGLE)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(at) * 20 < score.size or upto >= dim:
            break
    if len(at) * 4 > score.size:
        exact = (p.own @ q.own.T) / (p.norm[:, None] * q.norm[None, :])
        return np.nonzero(exact >= threshold)
    i, j = np.divmod(at, score.shape[1])
    keep = np.concatenate([np.einsum("ij,ij->i", p.own[i[k : k + 65536]], q.own[j[k : k + 65536]]) / (p.norm[i[k : k + 65536]] * q.norm[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) >= threshold
    return i[keep], j[keep]


def groups_of(n: np.ndarray, parts: np.ndarray, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of tiles with ``n`` vectors in ``parts`` blocks: each tile's first vector, and the tiles of each group of about ``size`` vectors.

    A group is a run of blocks; a tile of many blocks may be in several.
    """
    first = np.cumsum(n) - n
    tiles: dict[int, list[int]] = {}
    for k in range(len(n)):
        for g in np.unique((first[k] + np.arange(parts[k]) * n[k] // parts[k]) // size).tolist():
            tiles.setdefault(g, []).append(k)
    return first, [np.array(tiles.get(g, []), np.int64) for g in range(max(tiles) + 1)]


class Cell:
    """Links among the vectors of a pair of groups, as blocks come in: of each vector how many, and the component."""

    def __init__(self):
        self.ids, self.copies, self.links, self.n = [], [], [], 0
        self.i, self.j, self.edges = [], [], 0

    def add(self, ids: np.ndarray, copies: np.ndarray) -> int:
        """The number of a new block."""
        self.ids.append(ids)
        self.copies.append(copies)
        self.links.append(np.zeros(len(ids)))
        self.n += len(ids)
        return len(self.ids) - 1

    def link(self, a: int, b: int, i: np.ndarray, j: np.ndarray) -> None:
        """Rows ``i`` of block ``a`` and ``j`` of block ``b`` are linked."""
        first = np.cumsum([0, *map(len, self.ids)])
        self.links[a] += np.bincount(i, self.copies[b][j], len(self.ids[a]))
        self.links[b] += np.bincount(j, self.copies[a][i], len(self.ids[b]))
        na = len(self.ids[a]) if a != b else 0
        low = lowest(na + len(self.ids[b]), i, j + na)
        got = np.flatnonzero(low != np.arange(len(low)))
        at = np.concatenate([np.arange(na) + first[a], np.arange(len(self.ids[b])) + first[b]])
        self._keep(at[got], at[low[got]])
        if self.edges > EDGES:
            self._together()

    def _keep(self, i: np.ndarray, j: np.ndarray) -> None:
        self.i.append(i)
        self.j.append(j)
        self.edges += len(i)

    def _together(self) -> np.ndarray:
        low = lowest(self.n, np.concatenate(self.i), np.concatenate(self.j))
        got = np.flatnonzero(low != np.arange(self.n))
        self.i, self.j, self.edges = [], [], 0
        self._keep(got, low[got])
        return low

    def rows(self) -> pa.RecordBatch | None:
        if not self.i:
            return None
        low, ids, links = self._together(), np.concatenate(self.ids), np.concatenate(self.links)
        got = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(links[got].astype(np.int64)), pa.array(ids[low[got]])], ["cls", "links", "root"])


def embedding_classes(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each vector.

    Two vectors are linked if their cosine in double precision is ``threshold`` or
    more.  Equal vectors are one class before anything is compared and count as
    links of each other.  Classes are put in tiles of the leading principal axes;
    tile pairs whose boxes are too far apart for the threshold are never compared, the
    others are, block by block (``settled``).  Neighbouring tiles are dealt as groups:
    a task gets a pair of groups, holds the blocks of one and lets those of the other pass,
    so a vector is sent once for each group, not for each block.  A pair of groups returns, for
    every row, how many it is linked with there and the smallest row of its component
    there, so a group of thousands of near copies gives a row each, not all pairs.
    No link is missed: the sample of 20,000 only places the cuts, while boxes and
    blocks cover all vectors, and a tile of any size is dealt out in blocks of 1024.

    Vectors that are null, zero, or hold null or non-finite components link with
    nothing; the others are compared with those of their own length, one length after
    the other.  A null id is a vector like any other that names no component unless all
    ids there are null; repeated ids stay apart.  An empty table gives an empty result;
    further columns are ignored.  Components are compared in the precision they have.
    """
    rows = need(vectors, (id_col, vector_col)).toDF("vec_id", "embedding")
    kind = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.coalesce(~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    out = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lengths = rows.where(sound).select(F.size("embedding").alias("d")).distinct().collect()  # embeddings have few lengths
    for dim in sorted(r["d"] for r in lengths):
        out = out.unionAll(_classes_of(rows.where(sound & (F.size("embedding") == dim)), dim, threshold, kind))
    return out


def _classes_of(good: DataFrame, dim: int, threshold: float, kind: str) -> DataFrame:
    """``embedding_classes`` of vectors of one length, none of them odd."""
    packed = np.float32 if kind == "float" else np.float64
    classes = stored(good.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("cls", F.monotonically_increasing_id()), "emb-classes")
    axes = principal_axes(second_moments(classes, dim))
    n = classes.count()
    depth = max(0, min(TILES.bit_length() - 1, int(np.ceil(np.log2(max(1, n / BLOCK))))))
    box = min(BOX, dim)
    lead = np.ascontiguousarray(axes[:, :box])
    chosen = classes.orderBy(F.xxhash64("cls")).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    sample = np.stack(chosen.to_numpy()).astype(np.float64)
    levels = cutting_planes(_unit(sample) @ lead, depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            p = _unit(x) @ lead
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(tile_of(p, levels)), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), box).cast(pa.list_(pa.float64()))], ["cls", "embedding", "copies", "tile", "lead"])

    tiled = stored(classes.select("cls", "embedding", "copies").mapInArrow(place, f"cls long, embedding array<{kind}>, copies long, tile long, lead array<double>"), "emb-tiled")
    corners = tiled.groupBy("tile").agg(F.count("*").alias("n"), *[f(F.col("lead")[k]).alias(f"{w}{k}") for k in range(box) for w, f in (("lo", F.min), ("hi", F.max))]).orderBy("tile").toPandas()  # at most TILES rows
    lo, hi = (corners[[f"{w}{k}" for k in range(box)]].to_numpy() for w in ("lo", "hi"))
    parts = np.ceil(corners["n"].to_numpy() / BLOCK).astype(int)
    counts = dict(zip(corners["tile"].tolist(), parts.tolist(), strict=True))
    shares = F.element_at(F.create_map(*[F.lit(v) for kv in counts.items() for v in kv]), F.col("tile"))
    blocked = tiled.withColumn("part", F.pmod(F.xxhash64("cls"), shares).cast("long")).withColumn("block", F.col("tile") * F.lit(1 << 32) + F.col("part"))

    n_of, numbers = corners["n"].to_numpy(np.int64), corners["tile"].to_numpy(np.int64)
    size = min(max(-(-n // GROUPS), BLOCK), max(BLOCK, GROUP_BYTES // (8 * dim)))
    first, tiles = groups_of(n_of, parts, size)
    low, high = (np.array([f(x[t], axis=0) if len(t) else np.full(box, np.nan) for t in tiles]) for f, x in ((np.min, lo), (np.max, hi)))
    total = len(tiles) * (len(tiles) + 1) // 2

    def near(lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
        """The boxes that come near enough to box ``k``: unit vectors at cosine c are sqrt(2 - 2c) apart, and no projection stretches that."""
        gap = np.maximum(0, np.maximum(lo[k] - hi, lo - hi[k]))
        return (gap**2).sum(1) <= 2 - 2 * threshold + EPS

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cls")
        k = int(np.searchsorted(numbers, frame["tile"].iloc[0]))
        own = int((first[k] + int(frame["part"].iloc[0]) * n_of[k] // parts[k]) // size)
        # The pairs of groups that the block goes to, by number, doubled; odd where it passes and is not held.
        g = np.flatnonzero(near(low, high, own))
        a, b = np.minimum(g, own), np.maximum(g, own)
        to = 2 * (a * len(tiles) - a * (a - 1) // 2 + b - a) + (g < own)
        return pd.DataFrame({"block": frame["block"].iloc[:1], "tile": [k], "to": [to], "ids": [frame["cls"].to_numpy(np.int64).tobytes()], "copies": [frame["copies"].to_numpy(np.int64).tobytes()], "data": [np.stack(frame["embedding"].to_numpy()).astype(packed).tobytes()]})

    blocks = stored(blocked.select("cls", "embedding", "copies", "block", "tile", "part").groupBy("block").applyInPandas(pack, "block long, tile long, to array<long>, ids binary, copies binary, data binary"), "emb-blocks")
    diagonal = {a * len(tiles) - a * (a - 1) // 2 for a in range(len(tiles))}
    sent = blocks.select(F.explode("to").alias("to"), "block", "tile", "ids", "copies", "data")
    sent = sent.repartitionById(min(total, CELLS), F.pmod(F.shiftright("to", 1), F.lit(min(total, CELLS))).cast("int")).sortWithinPartitions("to", "block")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell, held = -1, Cell(), []
        for batch in batches:
            for r in range(batch.num_rows):
                to, tile = batch.column(0)[r].as_py(), batch.column(2)[r].as_py()
                if to >> 1 != at:
                    if (done := cell.rows()) is not None:
                        yield done
                    at, cell, held = to >> 1, Cell(), []
                ids, copies, data = (np.frombuffer(batch.column(c)[r].as_buffer(), k) for c, k in ((3, np.int64), (4, np.int64), (5, packed)))
                rows = Rows.of(data.reshape(-1, dim).astype(np.float64), axes)
                no = cell.add(ids.copy(), copies.copy())
                if not to & 1:
                    held.append((no, tile, rows))
                if to & 1 or at in diagonal:
                    close = near(lo, hi, tile)
                    for k, other, theirs in held:
                        if close[other]:
                            i, j = settled(theirs, rows, threshold)
                            if k == no:
                                i, j = i[i < j], j[i < j]
                            if len(i):
                                cell.link(k, no, i, j)
        if (done := cell.rows()) is not None:
            yield done

    matched = stored(sent.mapInArrow(trimmed(match), "cls long, links long, root long"), "emb-matched")
    summed = matched.groupBy("cls").agg(F.sum("links").alias("links"))
    found = connected_components(matched, "cls", "root")
    told = classes.join(summed, "cls", "left").join(found, F.col("cls") == F.col("node"), "left").select("cls", "embedding", "low", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("c"))
    told = stored(told, "emb-told")
    lows = stored(told.groupBy("c").agg(F.min("low").alias("component_id")), "emb-lows")
    named = stored(told.join(lows, "c").select("embedding", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "emb-named")
    linked = good.join(named, "embedding").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
    return linked


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_classes(read(spark, sf_dir, "embeddings"))


OP8_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
