"""Prefix trie of conversations, built as a Patricia tree from sorted turn sequences.

Turns become digests and conversations sequences of them; equal sequences are one row.
The distinct sequences are sorted over range partitions, and one streaming pass a
partition makes points only where sequences branch or end, with compressed edges
between them and aggregates over what hangs below.  Prefixes that two partitions share
are known from the partitions' first and last sequences; each partition gives what it
has of them, and the parts are added.  Edges are expanded to one row for each node at
the end, with the suffix sums of their turns' sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, read, stored, trimmed

#: Hexadecimal digits of SHA-256 that stand for a turn and for a prefix.
DIGITS = 32
#: Ids of conversations in one piece of the text that is hashed for a node's ends.
PIECE_IDS = 4096
#: Parents with at least this share of all edges are broadcast to them: there are no more than this many.
HEAVY = 1000
#: Rows that leave a task at once.
ROWS = 2048
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _digest(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, DIGITS)


def sequences(turns: DataFrame) -> DataFrame:
    """``(conv_id, path, sizes)`` of rows ``(conv_id, turn, role, text)``: digests and UTF-8 bytes of the turns in order.

    Null turns come first, then by number, equal numbers by role and text; null roles
    and texts are empty; repeated rows are repeated turns.  Rows without a conv_id
    belong to no conversation and are left out; other columns are ignored.
    """
    rows = need(turns, ("conv_id", "turn", "role", "text")).where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length keeps role and text apart.
    said = _digest(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)))
    place = F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)")
    flat = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), said.alias("said")).select("conv_id", place.alias("place"), "said", F.octet_length("text").cast("long").alias("size"))
    ordered = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "said", "size"))).alias("t"))
    return ordered.select("conv_id", F.col("t.said").alias("path"), F.col("t.size").alias("sizes"))


def rebuilt(own: DataFrame, base: Column, head: Column, longest_head: int) -> DataFrame:
    """Sequences with their first ``head`` turns (at most ``longest_head``) taken from the sequence ``base``.

    A base with fewer turns gives all of them, an absent one none; what a sequence has
    beyond its first ``head`` turns follows.
    """
    firsts = own.select(F.col("conv_id").alias("base"), F.slice("path", 1, longest_head).alias("base_path"), F.slice("sizes", 1, longest_head).alias("base_sizes"))
    paired = own.withColumns({"base": base, "head": head.cast("int")}).join(firsts, "base", "left")

    def spliced(before: str, after: str) -> Column:
        start = F.when(F.col("head") > 0, F.slice(before, F.lit(1), F.col("head")))
        return F.concat(F.coalesce(start, F.slice(after, 1, 0)), F.slice(after, F.col("head") + 1, F.size(after))).alias(after)

    return paired.select("conv_id", spliced("base_path", "path"), spliced("base_sizes", "sizes"))


# Hashes of the conversations that end at a node -----------------------------------

_PIECES = pa.schema([("key", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
_HASHES = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one key, cut every ``PIECE_IDS``; rows come sorted by key and id."""
    key, ids, out = None, [], []
    for b in batches:
        for k, conv_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == PIECE_IDS):
                out.append({"key": key, "first": ids[0], "ids": ",".join(map(str, ids))})
                ids = []
                if len(out) == ROWS:
                    yield pa.RecordBatch.from_pylist(out, _PIECES)
                    out = []
            key = k
            ids.append(conv_id)
    if ids:
        out.append({"key": key, "first": ids[0], "ids": ",".join(map(str, ids))})
    yield pa.RecordBatch.from_pylist(out, _PIECES)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces joined by commas; pieces come sorted by key and first id."""
    key, state, out = None, None, []
    for b in batches:
        for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k == key:
                state.update(b",")
            else:
                if state is not None:
                    out.append({"key": key, "ends_sha256": state.hexdigest()})
                key, state = k, hashlib.sha256()
                if len(out) == ROWS:
                    yield pa.RecordBatch.from_pylist(out, _HASHES)
                    out = []
            state.update(ids.encode())
    if state is not None:
        out.append({"key": key, "ends_sha256": state.hexdigest()})
    yield pa.RecordBatch.from_pylist(out, _HASHES)


def ends_hashes(keyed: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of ``(key, conv_id)``: the hash of a key's ids, ascending, joined by commas.

    Ids are range-partitioned with their key, so those of a key that a third of all
    conversations share are sorted and joined to pieces by many tasks; only pieces
    meet in one task, one after the other, as the hash has to read them in order.
    """
    pieces = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", "conv_id").mapInArrow(_pieces, "key string, first long, ids string")
    dealt = pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
    return dealt.mapInArrow(_hashes, "key string, ends_sha256 string")


# The pass over sorted sequences ----------------------------------------------------

_EDGES = pa.schema([("key", pa.string()), ("parent_key", pa.string()), ("open", pa.bool_()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("suffix", pa.list_(pa.int64()))])
EDGES_DDL = "key string, parent_key string, open boolean, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, suffix array<long>"


@dataclass
class _Point:
    """A branch or end on the present path, with what was found below it so far."""

    depth: int
    conv_id: int | None = None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ends: str | None = None
    #: Something hangs here; ``n_children`` leaves out children that an earlier part counts.
    inner: bool = False

    def add(self, conv_id: int, n_convs: int, n_children: int, n_leaves: int, saved: int) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n_convs += n_convs
        self.n_children += n_children
        self.n_leaves += n_leaves
        self.saved += saved


class _Part:
    """The points of one range partition's sequences, taken in order.

    ``before`` is how many turns the first sequence shares with the one before the part,
    ``after`` how many the last shares with the one after it; -1 where there is none.
    Prefixes of so many turns are open: other parts have some of what is below them.
    Each open depth is a point of its own, so that an edge is either open and one turn
    long or closed.  A task holds the points of one path.
    """

    def __init__(self, before: int, after: int):
        self.before, self.after = before, after
        self.path: list[str] | None = None
        self.sizes: list[int] = []
        self.stack = [_Point(0)]
        self.hashes = [hashlib.sha256()]
        self.flushing = False

    def push(self, path: list[str], sizes: list[int], conv_id: int, n_ends: int, ends: str) -> Iterator[dict]:
        if self.path is None:
            fits = 0
            self.stack += [_Point(d) for d in range(1, self.before + 1)]
        else:
            fits = next((k for k, (a, b) in enumerate(zip(self.path, path, strict=False)) if a != b), min(len(self.path), len(path)))
            yield from self._close(fits)
            self.before = min(self.before, fits)
        del self.hashes[fits + 1 :]
        for turn in path[fits:]:
            state = self.hashes[-1].copy()
            state.update(turn.encode())
            self.hashes.append(state)
        self.path, self.sizes = path, sizes
        if self.stack[-1].depth < len(path):
            self.stack.append(_Point(len(path)))
        self.stack[-1].ends = ends
        self.stack[-1].add(conv_id, n_ends, 0, 0, 0)

    def finish(self) -> Iterator[dict]:
        self.flushing = True
        for depth in range(max(self.after, 0), -2, -1):
            yield from self._close(depth)

    def _key(self, depth: int) -> str:
        return self.hashes[depth].hexdigest()[:DIGITS]

    def _close(self, fits: int) -> Iterator[dict]:
        """Take the points deeper than ``fits`` from the stack and hang each on the nearest place above."""
        while self.stack and self.stack[-1].depth > fits:
            p = self.stack.pop()
            goes_on = self.flushing and p.depth == self.after  # in the next part
            if not p.inner and not goes_on:
                p.n_leaves += 1
            in_before = p.depth <= self.before
            is_open = in_before or (self.flushing and p.depth <= self.after)
            if not p.depth:
                yield self._row(p, None, is_open, [0])
                return
            above = max(self.stack[-1].depth, fits)
            if self.stack[-1].depth < above:
                self.stack.append(_Point(above))
            suffix = [0]
            for size in reversed(self.sizes[above : p.depth - 1]):
                suffix.append(suffix[-1] + size)
            suffix.reverse()
            # Of an open node each part adds its conversations; the first part that has it takes the one off.
            p.saved += (p.n_convs - (not in_before)) * self.sizes[p.depth - 1]
            yield self._row(p, self._key(above), is_open, suffix)
            self.stack[-1].add(p.conv_id, p.n_convs, int(not in_before), p.n_leaves, p.saved + (p.n_convs - 1) * suffix[0])
            self.stack[-1].inner = True

    def _row(self, p: _Point, parent_key: str | None, is_open: bool, suffix: list[int]) -> dict:
        return {"key": self._key(p.depth), "parent_key": parent_key, "open": is_open, "conv_id": p.conv_id, "depth": p.depth, "n_convs": p.n_convs, "n_children": p.n_children, "n_leaves": p.n_leaves, "saved_tokens": p.saved, "ends_sha256": p.ends, "suffix": suffix}


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and path."""
    names = ("part", "before", "after", "path", "sizes", "conv_id", "n_ends", "ends_sha256")
    part, at, out = None, None, []
    for b in batches:
        for number, before, after, *row in zip(*(b.column(n).to_pylist() for n in names), strict=True):
            if number != at:
                if part is not None:
                    out.extend(part.finish())
                part, at = _Part(before, after), number
            out.extend(part.push(*row))
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, _EDGES)
                out = []
    if part is not None:
        out.extend(part.finish())
    yield pa.RecordBatch.from_pylist(out, _EDGES)


def _shared(a: str, b: str) -> str:
    """How many leading elements two arrays have in common; -1 where one is null."""
    both = f"least(size({a}), size({b}))"
    same = f"zip_with(slice({a}, 1, {both}), slice({b}, 1, {both}), (x, y) -> x = y)"
    return f"CAST(CASE WHEN {a} IS NULL OR {b} IS NULL THEN -1 ELSE coalesce(nullif(array_position({same}, false), 0) - 1, {both}) END AS LONG)"


def compressed(seqs: DataFrame) -> DataFrame:
    """The Patricia tree of ``(conv_id, path, sizes)``: a row for each point and for each prefix that two partitions share.

    Returns ``key, parent_key`` (the row at the upper end of its edge), ``conv_id`` (the
    smallest member), ``depth, n_convs, n_children, n_leaves, saved_tokens``,
    ``ends_sha256`` (null where no conversation ends) and ``suffix``: for each depth of
    the edge, from its upper end on, the bytes of the turns after it.
    """
    keyed = stored(seqs.withColumn("key", _digest(F.array_join("path", ""))), "trie-paths")
    distinct = keyed.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_ends"), F.first(F.struct("path", "sizes")).alias("p"))
    ended = distinct.join(ends_hashes(keyed.select("key", "conv_id")), "key").select("p.path", "p.sizes", "conv_id", "n_ends", "ends_sha256")
    ended = stored(ended, "trie-sequences")
    parts = stored(ended.repartitionByRange("path").withColumn("part", F.spark_partition_id()), "trie-parts")
    # One row a partition.
    ends = parts.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    beside = ends.selectExpr("part", "first", "last", "lag(last) OVER (ORDER BY part) AS prior", "lead(first) OVER (ORDER BY part) AS next")
    bounds = beside.select("part", F.expr(_shared("prior", "first")).alias("before"), F.expr(_shared("last", "next")).alias("after"))
    dealt = parts.join(F.broadcast(bounds), "part").repartition("part").sortWithinPartitions("part", "path")
    found = stored(dealt.select("part", "before", "after", "path", "sizes", "conv_id", "n_ends", "ends_sha256").mapInArrow(trimmed(_points), EDGES_DDL), "trie-points")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = found.where("open").groupBy("key", "parent_key", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.first("suffix").alias("suffix"))
    return found.where("NOT open").drop("open").unionByName(merged)


def expanded(points: DataFrame) -> DataFrame:
    """One row for each node of a compressed tree: the unary nodes inside an edge, then the point at its end.

    A node is named by its smallest member and depth.  Parents with very many children
    (a thousandth of all edges or more, so at most a thousand parents) are broadcast,
    the others joined by key.
    """
    points = stored(points, "trie-edges", measures={"n": F.count(F.lit(1))})
    n = points._measured.get("n", 0)
    parents = points.where("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"), (F.col("n_children") * HEAVY >= n).alias("heavy"))
    heavy = F.broadcast(parents.where("heavy").drop("heavy"))
    near = points.join(heavy, "parent_key", "left").where("above IS NOT NULL OR parent_key IS NULL")
    far = points.where("parent_key IS NOT NULL").join(heavy, "parent_key", "left_anti").join(parents.where("NOT heavy").drop("heavy"), "parent_key")
    rows = near.unionByName(far).withColumn("last", F.size("suffix") - 1).select("*", F.posexplode("suffix").alias("k", "after"))
    is_point = F.col("k") == F.col("last")
    return rows.select(
        "conv_id", (F.col("depth") - F.col("last") + F.col("k")).alias("depth"),
        F.when(F.col("k") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(is_point, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("after")).alias("saved_tokens"),
        F.when(is_point & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(NO_ENDS).alias("ends_sha256"),
    )


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``(conv_id, path, sizes)``, one row each.

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id`` (null at the root),
    ``n_convs`` members, ``n_children``, ``n_leaves`` childless nodes in the subtree,
    ``saved_tokens`` bytes of turns that the subtree's nodes share, ``ends_sha256`` over
    the members that end there.  An empty path ends at the root; without any sequence
    there are no nodes; an id that is repeated counts each time.
    """
    return expanded(compressed(seqs))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sequences(read(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefix_trie(rebuilt(stored(own, "trie-own"), F.col("conv_id") - F.col("conv_id") % 5, head, 8))


OP12_SQL = """
WITH t AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS u, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id AS c, list(u ORDER BY turn NULLS FIRST, role, text) AS p FROM t GROUP BY conv_id),
h AS (SELECT c, p, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda d, e: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 9 AS h FROM own),
full_ AS (SELECT h.c, list_concat(coalesce(b.p[1:h.h], []), h.p[h.h + 1:]) AS p FROM h LEFT JOIN own b ON b.c = h.c - h.c % 5),
pre AS (SELECT c, len(p) AS n, d, CAST(p[1:d] AS VARCHAR) AS k, p[1:d] AS q FROM full_, LATERAL (SELECT unnest(range(len(p) + 1)) AS d)),
nodes AS (SELECT q, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d) AS ends, max(n > d) AS inner_ FROM pre GROUP BY q, d),
kids AS (SELECT q[1:d - 1] AS q, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
below AS (SELECT q[1:a] AS q, sum(CASE WHEN inner_ THEN 0 ELSE 1 END) AS n_leaves, sum(CASE WHEN d > 0 THEN (n_convs - 1) * strlen(q[d].x) ELSE 0 END) AS saved
  FROM nodes, LATERAL (SELECT unnest(range(d + 1)) AS a) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.q = n.q LEFT JOIN kids k ON k.q = n.q LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.q = n.q[1:n.d - 1]
"""
