"""How much a search of many passages holds at once."""

import tracemalloc
from types import SimpleNamespace

import numpy as np

from lodestone.llm.decontam import PASSAGE, STRIDE, Benchmark, Block, Searcher


def test_gains_are_copied_for_some_passages_at_a_time():
    gain = np.zeros((64, 256), np.float32)
    gain[:, 0] = np.tile([1, -1], 32)  # every passage may come near, none does
    block = Block(np.arange(64), gain, np.zeros(256, np.int64), PASSAGE, STRIDE)
    searcher = Searcher(Benchmark([b"w%d" % k for k in range(64)], [], [block]), np.ones(8, np.float32))
    n = PASSAGE + 2047 * STRIDE
    tracemalloc.start()
    try:
        found = list(searcher.candidates(SimpleNamespace(first=np.array([0, n])), np.arange(n) % 64, np.arange(n + 1.0), block, searcher.rows[0], searcher.most[0]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not found and peak < 20 << 20
