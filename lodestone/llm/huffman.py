"""Canonical length-limited Huffman codes, packed and unpacked with numpy."""

from __future__ import annotations

import numpy as np


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit in codes of {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.int64)
    n = len(order)
    # A level's items are the n coins and the packages of the level below, in order of weight.
    levels = []
    packages = np.zeros(0, np.int64)
    for _ in range(limit):
        items = np.concatenate([weight, packages])
        by = np.argsort(items, kind="stable")
        levels.append(by)
        items = items[by]
        even = len(items) // 2 * 2
        packages = items[:even:2] + items[1:even:2]
    # From the top: the first 2n-2 items are taken; each package taken takes two items below.
    taken, depth = 2 * n - 2, np.zeros(n, np.int64)
    for by in reversed(levels):
        chosen = by[:taken]
        coins = chosen[chosen < n]
        depth[coins] += 1
        taken = 2 * (len(chosen) - len(coins))
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), so that the lengths alone describe them."""
    codes = np.zeros(len(lengths), np.uint32)
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.lexsort((symbols, lengths[symbols]))]
    code, last = 0, 0
    for s, n in zip(symbols.tolist(), lengths[symbols].tolist(), strict=True):
        code <<= n - last
        codes[s] = code
        code, last = code + 1, n
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every ``width``-bit window: symbol << 8 | code length."""
    width = int(lengths.max(initial=1))
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.lexsort((symbols, lengths[symbols]))]
    n = lengths[symbols].astype(np.int64)
    entries = (symbols.astype(np.uint32) << np.uint32(8)) | n.astype(np.uint32)
    table = np.repeat(entries, 1 << (width - n))
    return np.concatenate([table, np.zeros((1 << width) - len(table), np.uint32)]), width


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int) -> tuple[bytes, np.ndarray, int]:
    """Bits of ``ids`` (most significant first), the bit offset of every ``every``-th id, and the bit count."""
    n = lengths[ids].astype(np.int64)
    if len(ids) and not n.all():
        raise ValueError("an id without a code")
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ids) else 0
    starts = ends - n
    words = np.zeros(total // 32 + 3, np.uint32)
    step = 1 << 20
    for a in range(0, len(ids), step):
        s, m, c = starts[a : a + step], n[a : a + step], codes[ids[a : a + step]].astype(np.uint64)
        first = int(s[0]) >> 5
        at = (s >> 5) - first
        shifted = c << (64 - (s & 31) - m).astype(np.uint64)
        # Bits of different codes never overlap, so adding up is the same as or; each sum is below 2^32 and exact.
        size = int(at[-1]) + 2
        high = np.bincount(at, (shifted >> np.uint64(32)).astype(np.float64), size)
        low = np.bincount(at + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
        words[first : first + size] |= (high + low).astype(np.uint32)
    return words[: (total + 31) // 32].astype(">u4").tobytes(), starts[::every].astype(np.int64), total


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, every: int, table: np.ndarray, width: int) -> np.ndarray:
    """The ``n`` ids of a block.  All stretches between checkpoints advance together, one id a step."""
    words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(3, np.uint64)])
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    out = np.zeros((len(checkpoints), every), np.uint32)
    at = checkpoints.astype(np.int64).copy()
    last = len(pairs) - 1
    mask = np.uint64((1 << width) - 1)
    rows = len(checkpoints)
    for k in range(every):
        if k and rows and (rows - 1) * every + k >= n:
            rows -= 1  # the last stretch is shorter
            at = at[:rows]
        got = table[((pairs[np.minimum(at >> 5, last)] >> (np.uint64(64 - width) - (at & 31).astype(np.uint64))) & mask).astype(np.int64)]
        out[:rows, k] = got >> np.uint32(8)
        at = at + (got & np.uint32(255))
    return out.reshape(-1)[:n]
