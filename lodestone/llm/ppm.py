"""Language-model scores: prediction by partial matching over bytes, beside a word unigram."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, counted, need, read, stored, trimmed

#: Bytes of context.
ORDER = 4
#: Text of a block, the unit in which model entries are fetched.
BLOCK_BYTES = 32_000_000
#: Bytes handled at once inside a block.
STEP = 2_000_000
#: Distinct keys of a part of the key space, counted first; up to ``LEAST_PARTS`` parts may be smaller.
PART_KEYS, SMALL_PART_KEYS, LEAST_PARTS = 1 << 20, 1 << 16, 64
#: Blocks whose questions about a part are answered by one task.
BIN_BLOCKS = 1 << 13
#: These two never occur in UTF-8: what stands before a text, and its end.
START, END = 0xFE, 0xFF
SYMBOLS = 256
END_WORD = b"\n"  # no word can be this


def symbols(text: str | None) -> bytes:
    return (text or "").encode().lower() + bytes([END])


def context_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """One number for each coded symbol: ``order`` bytes of context, then the symbol; and each text's length."""
    pad = bytes([START]) * order
    x = np.frombuffer(b"".join([pad + t for t in texts]), np.uint8)
    keys = np.zeros(len(x) - order, np.int64)
    for j in range(order + 1):
        keys <<= 8
        keys |= x[j : len(x) - order + j]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # Windows that end in the next text's padding code nothing.
    return keys[x[order:] != START], lengths


def _count(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (``n``: weights)."""
    if n is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class Tally:
    """Counts of one block: those of training texts, and the other keys with 0."""

    def __init__(self, order: int):
        self.order, self.parts, self.words = order, [], ({}, Counter())
        self.held: tuple[list[bytes], list[bytes]] = ([], [])
        self.size = 0

    def add(self, s: bytes, learn: bool) -> None:
        self.held[learn].append(s)
        w = s[:-1].split()
        if learn:
            self.words[1].update(w)
            self.words[1][END_WORD] += 1
        else:
            self.words[0].update(dict.fromkeys(w, 0))
            self.words[0][END_WORD] = 0
        self.size += len(s)
        if self.size >= STEP:
            self.flush()

    def flush(self) -> None:
        for learn in (0, 1):
            if self.held[learn]:
                k, n = _count(context_keys(self.held[learn], self.order)[0])
                self.parts.append((k, n if learn else np.zeros(len(k), np.int64)))
                self.held[learn].clear()
        self.size = 0
        if len(self.parts) > 8:
            self._merge()

    def _merge(self) -> None:
        if self.parts:
            self.parts = [_count(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        self.flush()
        self._merge()
        keys, n = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        unseen, seen = self.words
        every = [*seen, *(w for w in unseen if w not in seen)]
        hashes = np.fromiter(map(word_hash, every), np.int64, len(every))
        counts = np.fromiter((seen[w] for w in every), np.int64, len(every))
        return keys, n, hashes, counts


#: Kinds of rows: packed texts, counts of contexts, counts of words.
TEXTS, GRAMS, WORDS = 0, 1, 2
ROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
ROW_DDL = "block long, kind int, keys binary, n binary"


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part, of ``parts``, that counts a key."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _delta(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, which compress well."""
    return np.diff(keys, prepend=np.int64(0)).tobytes()


def _undelta(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.int64))


def _counts(block: int, kind: int, keys: np.ndarray, n: np.ndarray) -> dict:
    """One row of a block's (keys, n), keys ascending."""
    by = np.argsort(keys)
    return {"block": block, "kind": kind, "keys": _delta(keys[by]), "n": n[by].tobytes()}


def pack_texts(ids: list[int | None], texts: list[bytes]) -> tuple[bytes, bytes]:
    """Texts compressed together, and their ids, null marks and lengths."""
    marks = np.array([[0 if i is None else i, i is None, len(t)] for i, t in zip(ids, texts, strict=True)], np.int64).reshape(-1, 3)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(texts)), marks.tobytes()


def unpack_texts(payload: bytes, marks: bytes) -> tuple[list[int | None], list[bytes]]:
    m = np.frombuffer(marks, np.int64).reshape(-1, 3)
    ends = np.cumsum(m[:, 2])
    raw = zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(1, int(ends[-1]) if len(m) else 1))
    return [None if none else i for i, none, _ in m.tolist()], [raw[z - n : z] for z, n in zip(ends.tolist(), m[:, 2].tolist(), strict=True)]


def blocks(docs: DataFrame, learn: Column, order: int) -> DataFrame:
    """Blocks of a task's input: rows of packed texts, and a row each for the block's counts of contexts and of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        tally = Tally(order)
        ids: list[int | None] = []
        held: list[bytes] = []
        held_size = 0

        def texts() -> dict:
            payload, marks = pack_texts(ids, held)
            return {"block": block, "kind": TEXTS, "keys": payload, "n": marks}

        def counts() -> list[dict]:
            keys, n, hashes, wn = tally.result()
            return [_counts(block, GRAMS, keys, n), _counts(block, WORDS, hashes, wn)]

        for b in batches:
            for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = symbols(t)
                tally.add(s, y)
                ids.append(i)
                held.append(s)
                held_size += len(s)
                size += len(s)
                if held_size >= STEP:
                    yield pa.RecordBatch.from_pylist([texts()], ROW)
                    ids, held, held_size = [], [], 0
                if size >= BLOCK_BYTES:
                    if held:
                        yield pa.RecordBatch.from_pylist([texts()], ROW)
                    yield pa.RecordBatch.from_pylist(counts(), ROW)
                    block, size, tally = block + 1, 0, Tally(order)
                    ids, held, held_size = [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist([texts()], ROW)
        if size:
            yield pa.RecordBatch.from_pylist(counts(), ROW)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), learn.alias("learn")).mapInArrow(run, ROW_DDL)


def totals(counts: DataFrame) -> DataFrame:
    """``(key, c)``: the counts of all blocks added up, in the JVM, tasks first."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in zip(b.column(0), b.column(1), strict=True):
                keys, c = _undelta(k.as_py()), np.frombuffer(n.as_py(), np.int64)
                for a in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)]), pa.array(c[a : a + (1 << 16)])], ["key", "c"])

    return counts.select("keys", "n").mapInArrow(trimmed(pairs), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def answers(asked: DataFrame, model: DataFrame, distinct: int, n_blocks: int) -> DataFrame:
    """``(block, keys, v)``: of the keys that each row of ``asked(block, keys)`` has, those that ``model(key, v)`` has, with its value.

    Keys are dealt by parts of about ``PART_KEYS`` of the ``distinct`` ones, so a block asks in
    as many rows as there are parts and not in more when the corpus grows but its
    contexts do not.  A task has the keys of one part and the questions of
    at most some ``BIN_BLOCKS`` blocks; the model's part goes to each such bin.
    """
    parts = max(1, -(-distinct // PART_KEYS), min(LEAST_PARTS, -(-distinct // SMALL_PART_KEYS)))
    bins = max(1, -(-n_blocks // BIN_BLOCKS))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys = _undelta(raw.as_py())
                p = part_of(keys, parts)
                by = np.argsort(p, kind="stable")
                keys, p = keys[by], p[by]
                found, starts = np.unique(p, return_index=True)
                cuts = [_delta(k) for k in np.split(keys, starts[1:])] if len(keys) else []
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array(found.astype(np.int32)), pa.array(cuts, pa.binary())], ["block", "part", "keys"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part_of(b.column(0).to_numpy(), parts).astype(np.int32)), b.column(0), b.column(1)], ["model_part", "key", "v"])

    def look_up(questions: pa.Table, known: pa.Table) -> pa.Table:
        keys, v = known.column("key").to_numpy(), known.column("v").to_numpy()
        by = np.argsort(keys)
        keys, v = keys[by], v[by]
        out = []
        for block, raw in zip(questions.column("block").to_pylist(), questions.column("keys"), strict=True):
            wanted = _undelta(raw.as_py())
            at = np.searchsorted(keys, wanted)
            there = at < len(keys)
            there[there] = keys[at[there]] == wanted[there]
            out.append({"block": block, "keys": _delta(wanted[there]), "v": v[at[there]].tobytes()})
        return pa.Table.from_pylist(out, ENTRY)

    questions = asked.select("block", "keys").mapInArrow(trimmed(split), "block long, part int, keys binary").withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(bins)))
    shared = model.mapInArrow(trimmed(own), "model_part int, key long, v double").withColumn("model_bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return questions.groupBy("part", "bin").cogroup(shared.groupBy("model_part", "model_bin")).applyInArrow(look_up, ENTRY_DDL)


def code_table(total: DataFrame, order: int) -> DataFrame:
    """``(key, v)`` for every key of ``total(key, c)``: ``v`` is log10 of the symbol's probability after its context.

    Method C: in a context with N counts of D symbols, a seen symbol has c / (N + D)
    and the escape D / (N + D); after an escape the shorter context leaves out the
    symbols of the longer one, in N and in D; below order 0 what is left of 256
    symbols is uniform; contexts never seen are passed over without cost.

    Everything is joins of a level of the trie with the next shorter one; a node has
    256 children at most, so no join key is hot.  Levels of up to two bytes have at
    most 65,536 rows, which bounds what is broadcast.
    """
    masks = [(1 << 8 * (k + 1)) - 1 for k in range(order + 1)]
    levels: dict[int, DataFrame] = {order: total}
    for k in range(order - 1, -1, -1):
        levels[k] = stored(levels[k + 1].groupBy(F.col("key").bitwiseAND(F.lit(masks[k])).alias("key")).agg(F.sum("c").alias("c")), f"ppm-level{k}")
    context = F.shiftright("key", 8).alias("ctx")
    small = lambda df, k: F.broadcast(df) if k <= 1 else df
    # Level 0: what is left below it is uniform.
    row = levels[0].where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("d")).first()
    n0, d0 = float(row["n"] or 0), float(row["d"])
    rest = 1.0 / max(1.0, SYMBOLS - d0)
    f0 = F.when(F.col("c") > 0, F.col("c") / F.lit(n0 + d0)).otherwise(F.lit(d0 / (n0 + d0) * rest if n0 else 1.0 / SYMBOLS))
    at = levels[0].select("key", F.col("c").cast("double").alias("c"), F.lit(n0).alias("n"), F.lit(d0).alias("d"), F.lit(rest).alias("q"), f0.alias("f"))
    for k in range(1, order + 1):
        lower = at.select(F.col("key").alias("suffix"), F.col("c").alias("c0"), F.col("n").alias("n0"), F.col("d").alias("d0"), F.col("q").alias("q0"), F.col("f").alias("f0"))
        here = levels[k].withColumn("suffix", F.col("key").bitwiseAND(F.lit(masks[k - 1])))
        both = stored(here.join(small(lower, k - 1), "suffix").withColumn("ctx", context), f"ppm-both{k}")
        stats = both.where("c > 0").groupBy("ctx").agg(F.sum("c").cast("double").alias("n"), F.count("*").cast("double").alias("d"), F.sum("c0").alias("x"))
        joined = both.join(small(stored(stats, f"ppm-stats{k}"), k - 1), "ctx", "left")
        left = (F.col("n0") - F.col("x")) + (F.col("d0") - F.col("d"))
        q = F.when(left <= 0, F.col("q0")).when(F.col("c0") > 0, F.col("c0") / left).otherwise((F.col("d0") - F.col("d")) / left * F.col("q0"))
        joined = joined.withColumn("q", q)
        f = F.when(F.col("n").isNull(), F.col("f0")).when(F.col("c") > 0, F.col("c") / (F.col("n") + F.col("d"))).otherwise(F.col("d") / (F.col("n") + F.col("d")) * F.col("q"))
        at = stored(joined.select("key", F.col("c").cast("double").alias("c"), F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("d", F.lit(0.0)).alias("d"), "q", f.alias("f")), f"ppm-at{k}")
    return at.select("key", F.log10("f").alias("v"))


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, learn: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every whole text.

    ``score`` is the log10 probability that the byte model of the documents with
    ``learn`` true gives to the lower-cased text and its end; ``base_score`` that of
    the smoothed word unigram.  Every task counts byte contexts and words of its
    block; counts are added up, turned into code lengths by
    joins, and each block gets back the entries it uses, which its size bounds.
    So the model is never in one place and grows with the corpus.

    Null texts are empty; an empty text is its end alone.  A null id is scored like
    any other; whether it is learned from is up to ``learn`` (null: no).  Repeated
    rows are scored (and counted) each.  Without training text every symbol has
    1/256.  An empty table gives an empty result; further columns are ignored.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be from 1 to 6")
    rows = need(docs, (id_col, text_col)).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    table = stored(blocks(rows, F.coalesce(learn, F.lit(False)), order), "ppm-blocks", compression="zstd", measures={"n": F.count_if(F.col("kind") == GRAMS)})
    grams, found, n_blocks = table.where(F.col("kind") == GRAMS), table.where(F.col("kind") == WORDS), table._measured.get("n", 0)
    total, contexts = counted(totals(grams), "ppm-grams")
    seen = stored(totals(found), "ppm-words", measures={"n": F.count(F.lit(1)), "tokens": F.sum("c"), "distinct": F.count_if(F.col("c") > 0)})
    tokens, distinct = (int(seen._measured.get(k) or 0) for k in ("tokens", "distinct"))
    codes = answers(grams, code_table(total, order), contexts, n_blocks)
    counts = answers(found, seen.where("c > 0").select("key", F.col("c").cast("double").alias("v")), seen._measured.get("n", 0), n_blocks)
    entries = codes.select(F.lit(GRAMS).alias("kind"), "block", "keys", "v").unionAll(counts.select(F.lit(WORDS), "block", "keys", "v"))

    def score(texts: pa.Table, model: pa.Table) -> pa.Table:
        kinds = model.column("kind").to_numpy()
        one = lambda kind: [[f(x.as_py()) for x in model.column(c).filter(pa.array(kinds == kind))] for c, f in (("keys", _undelta), ("v", np.frombuffer))]
        keys, logp = map(np.concatenate, one(GRAMS))
        by = np.argsort(keys)
        keys, logp = keys[by], logp[by]
        ks, vs = one(WORDS)
        counts = dict(zip(np.concatenate(ks).tolist(), np.concatenate(vs).tolist(), strict=True)) if ks else {}
        logs: dict[bytes, float | None] = {}
        out = []
        for payload, marks in zip(texts.column("keys"), texts.column("n"), strict=True):
            ids, part = unpack_texts(payload.as_py(), marks.as_py())
            k, n = context_keys(part, order)
            scores = np.add.reduceat(logp[np.searchsorted(keys, k)], np.cumsum(n) - n)
            for i, t, s in zip(ids, part, scores.tolist(), strict=True):
                w = t[:-1].split()
                w.append(END_WORD)
                for x in w:
                    if x not in logs:
                        c = counts.get(word_hash(x))
                        logs[x] = math.log10(c + 0.1) if c else None
                got = [v for v in map(logs.__getitem__, w) if v is not None]
                out.append((i, len(w), len(got), math.fsum(got) + (len(w) - len(got)) * math.log10(0.1), s))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), OUT, strict=True)], schema=OUT) if out else OUT.empty_table()

    packed = table.where(F.col("kind") == TEXTS).select("block", "keys", "n")
    scored = packed.groupBy("block").cogroup(entries.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, base double, score double")
    bottom = math.log10(tokens + 0.1 * (distinct + 1))
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(bottom)).alias("base_score"), "score")


ENTRY = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("v", pa.binary())])
ENTRY_DDL = "block long, keys binary, v binary"


class Trie:
    """The same model for one sequence, learning as it codes; plain Python, for adaptive code lengths."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.levels: list[dict[bytes, dict[int, int]]] = [defaultdict(dict) for _ in range(order + 1)]

    def probability(self, context: bytes, symbol: int) -> float:
        p, out = 1.0, {}
        for k in range(self.order, -1, -1):
            seen = self.levels[k].get(context[len(context) - k :])
            if not seen:
                continue
            n = sum(c for s, c in seen.items() if s not in out)
            d = len(seen) - len(out)
            if symbol in seen:
                return p * seen[symbol] / (n + d)
            if n + d:
                p *= d / (n + d)
            out = seen
        return p / (SYMBOLS - len(out))

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            level = self.levels[k][context[len(context) - k :]]
            level[symbol] = level.get(symbol, 0) + 1

    def code(self, text: str | None, adapt: bool = True) -> float:
        """log10 probability of a text, learning each symbol after coding it if ``adapt``."""
        s = bytes([START]) * self.order + symbols(text)
        total = 0.0
        for k in range(self.order, len(s)):
            context = s[k - self.order : k]
            total += math.log10(self.probability(context, s[k]))
            if adapt:
                self.learn(context, s[k])
        return total


def adaptive_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``: log10 probability of each text under a trie that starts empty and learns only that text.

    A null text is empty; an empty one is its end alone.  Repeated rows and null ids are
    scored each; an empty table gives an empty result.  The time of a text is in
    proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([Trie(order).code(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return need(docs, (id_col, text_col)).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rest = bucket("doc_id", 10)
    return score_documents(docs, bucket("doc_id", 10) != 0).select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
