"""Words of many texts at once, as numpy arrays: where they stand, exact keys, hash bins, and a vocabulary's numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of a word that its key holds; longer words are told apart by their bytes.
KEY_BYTES = 24
#: Bytes of text that are handled at once; a longer text is alone.
WINDOW = 1 << 20
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Odd multipliers that mix a key; any would do.
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def keys_of(x: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 24 bytes of each word as three numbers (zero after its end), and a mixed hash of them and its length.

    ``x`` has 32 bytes after the last word.
    """
    at = np.ndarray((len(x) - 7,), "<u8", np.ascontiguousarray(x), 0, (1,))
    keys = np.zeros((KEY_BYTES // 8, len(starts)), np.uint64)
    keys[0] = at[starts] & _MASKS[np.minimum(size, 8)]
    for k in range(1, KEY_BYTES // 8):
        long = np.flatnonzero(size > 8 * k)
        keys[k, long] = at[starts[long] + 8 * k] & _MASKS[np.minimum(size[long] - 8 * k, 8)]
    mixed = size.astype(np.uint64)
    for key, turn in zip(keys, _TURNS, strict=True):
        mixed = (mixed ^ key) * turn
        mixed ^= mixed >> np.uint64(32)
    return keys, mixed * _TURNS[0]


@dataclass
class Words:
    """Words of consecutive texts: bytes after mapping, first byte, length, and the first word of each text (and the end)."""

    x: np.ndarray
    starts: np.ndarray
    size: np.ndarray
    first: np.ndarray

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return keys_of(self.x, self.starts, self.size)

    def word(self, k: int) -> bytes:
        return self.x[self.starts[k] : self.starts[k] + self.size[k]].tobytes()


class Splitter:
    """Texts to words: A-Z lower-cased, bytes of ``drop`` left out, cut at ASCII white space."""

    def __init__(self, drop: bytes = b""):
        byte = np.arange(256, dtype=np.uint8)
        self.map = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
        self.space = np.isin(byte, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
        self.drop = np.isin(byte, np.frombuffer(drop, np.uint8)) if drop else None

    def split(self, x: np.ndarray, ends: np.ndarray) -> Words:
        """``ends``: where each text ends in ``x``; texts stand side by side."""
        x = self.map[x]
        if self.drop is not None:
            keep = ~self.drop[x]
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            x = x[keep]
        inside = np.zeros(len(x) + 2, bool)
        inside[1:-1] = ~self.space[x]
        begins = inside[1:] & ~inside[:-1]
        stops = inside[:-1] & ~inside[1:]
        # A text's end parts words that stand side by side.
        edge = ends[(ends > 0) & (ends < len(x))]
        edge = edge[inside[edge] & inside[edge + 1]]
        begins[edge] = stops[edge] = True
        starts = np.flatnonzero(begins)
        size = np.flatnonzero(stops) - starts
        return Words(np.concatenate([x, np.zeros(32, np.uint8)]), starts, size, np.concatenate([[0], np.searchsorted(starts, ends)]))

    def each(self, texts: pa.Array) -> Iterator[tuple[int, Words]]:
        """(number of the first text, words) of runs of texts of about ``WINDOW`` bytes; a null is an empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        x = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        a = 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(at, at[a] + WINDOW, "right")) - 1)
            yield a, self.split(x[at[a] : at[z]], at[a + 1 : z + 1] - at[a])
            a = z


class Vocabulary:
    """Numbers of known words, looked up for many at once; exact for words of any length."""

    def __init__(self, words: list[bytes], bits: int):
        self.words, self.shift = words, np.uint64(64 - bits)
        size = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(size) - size
        keys, mixed = keys_of(np.frombuffer(b"".join(words) + bytes(32), np.uint8), starts, size)
        self.bins = (mixed >> self.shift).astype(np.int64)
        self.order = np.argsort(self.bins, kind="stable").astype(np.int32)
        self.keys, self.size = keys[:, self.order], size[self.order]
        self.count = np.bincount(self.bins, minlength=1 << bits).astype(np.int32)
        self.first = (np.cumsum(self.count) - self.count).astype(np.int32)

    def numbers(self, words: Words, keys: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out = np.full(len(bins), -1, np.int64)
        open_ = np.flatnonzero(self.count[bins] > 0)
        step = 0
        while len(open_):
            at = self.first[bins[open_]] + step
            same = self.size[at] == words.size[open_]
            for own, key in zip(self.keys, keys, strict=True):
                same &= own[at] == key[open_]
            for k in np.flatnonzero(same & (words.size[open_] > KEY_BYTES)):
                same[k] = self.words[self.order[at[k]]] == words.word(open_[k])
            out[open_[same]] = self.order[at[same]]
            step += 1
            open_ = open_[~same & (self.count[bins[open_]] > step)]
        return out
