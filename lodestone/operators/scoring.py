"""Scores of a batch of rows for many queries at once; a task keeps the best of each query and passes on nothing else."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores are compared as multiples of this many to one, as ``retrieval.DIGITS`` rounds them.
UNITS = 1e6
#: Queries, and cells of a matrix of rows by terms, that are worked on at once.
QUERIES, CELLS = 256, 1 << 21
#: Results that are held beyond those that stay before they are cut to the best.
HELD = 1 << 16


class Best:
    """The ``k`` best rows of each query among those offered; of equal rounded scores the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, 0
        self.floor = np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.limit = HELD

    def offer(self, first: int, ids: pa.Array, scores: np.ndarray, real: np.ndarray | None = None) -> None:
        """``scores`` of the queries from number ``first`` on (rows) and of ``ids`` (columns, ascending); where not ``real`` there is none."""
        key = np.rint(np.where(np.isnan(scores), np.inf, scores) * UNITS)
        if real is not None:
            key[~real] = -np.inf
        floor = self.floor[first : first + len(key), None]
        good = (key >= floor) & (key > -np.inf)
        many = np.flatnonzero(good.sum(axis=1) > 4 * self.k)
        if len(many):
            # Columns ascend by id, so an earlier one wins a tie: the k-th best key, and of those equal to it the first.
            kth = -np.partition(-key[many], self.k - 1, axis=1)[:, self.k - 1 : self.k]
            ties = key[many] == kth
            room = self.k - (key[many] > kth).sum(axis=1, keepdims=True)
            good[many] &= (key[many] > kth) | (ties & (np.cumsum(ties, axis=1) <= room))
        q, at = np.nonzero(good)
        if len(q):
            self.parts.append((q + first, ids.take(pa.array(at)), scores[q, at]))
            self.held += len(q)
            if self.held > self.limit:
                self._cut()

    def _cut(self) -> None:
        q, ids, score = np.concatenate([p[0] for p in self.parts]), pa.concat_arrays([p[1] for p in self.parts]), np.concatenate([p[2] for p in self.parts])
        key, place = np.rint(np.where(np.isnan(score), np.inf, score) * UNITS), np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place, -key, q))
        q = q[order]
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        nth = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        last = order[nth == self.k - 1]
        self.floor[q[nth == self.k - 1]] = key[last]
        order, q = order[nth < self.k], q[nth < self.k]
        self.parts = [(q, ids.take(pa.array(order)), score[order])]
        self.held, self.limit = len(q), 2 * len(q) + HELD

    def result(self) -> tuple[np.ndarray, pa.Array, np.ndarray] | None:
        """Query numbers, ids and scores."""
        if not self.parts:
            return None
        self._cut()
        return self.parts[0]


@dataclass
class Weights:
    """Queries as sums over terms: ``weight`` of term number ``term`` in query number ``query``; pairs ascend by query."""

    queries: int
    query: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def blocks(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, its block's terms, weights of the queries by these terms) for every ``QUERIES`` queries."""
        out = []
        for first in range(0, self.queries, QUERIES):
            n = min(QUERIES, self.queries - first)
            part = slice(*np.searchsorted(self.query, [first, first + n]))
            own, place = np.unique(self.term[part], return_inverse=True)
            w = np.zeros((n, len(own)))
            np.add.at(w, (self.query[part] - first, place), self.weight[part])
            out.append((first, own, w))
        return out


def score_rows(fields: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], blocks: Sequence[list], ids: pa.Array, terms: int, best: Best) -> None:
    """Offer the sums of rows to ``best``, of several fields the best one.

    A field is ``(row, term, part)``, ascending by row, with one entry at most for a row and a term; ``blocks``
    has each field's ``Weights.blocks``.  ``ids`` ascend.
    """
    step = max(1, CELLS // max(1, terms))
    for a in range(0, len(ids), step):
        n = min(step, len(ids) - a)
        mats = []
        for row, term, part in fields:
            here = slice(*np.searchsorted(row, [a, a + n]))
            m = np.zeros((n, terms))
            m[row[here] - a, term[here]] = part[here]
            mats.append(m)
        for each in zip(*blocks, strict=True):
            total = None
            for (_, own, w), m in zip(each, mats, strict=True):
                got = w @ m[:, own].T
                total = got if total is None else np.maximum(total, got)
            best.offer(each[0][0], ids.slice(a, n), total, total > 0)


def ascending(ids: pa.Array) -> np.ndarray:
    """The order in which ids ascend, null first."""
    return pc.sort_indices(ids, null_placement="at_start").to_numpy()


def emitted(best: Best, queries: pa.Array) -> Iterator[pa.RecordBatch]:
    """``(query_id, chunk_id, score)`` of what ``best`` holds."""
    got = best.result()
    if got is not None:
        q, ids, score = got
        yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), ids, pa.array(score)], ["query_id", "chunk_id", "score"])
