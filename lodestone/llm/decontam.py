"""Benchmark decontamination by latent semantic retrieval, with exact checks of what it finds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, discard, give_back, marked, need, read, stored, trimmed
from .wordscan import Splitter, Vocabulary, Words

#: Words of a passage, and between the beginnings of two; those of items shorter than a stride.
PASSAGE, STRIDE = 32, 16
SHORT_PASSAGE, SHORT_STRIDE = 8, 4
#: Binary logarithm of the bins of the document-frequency table (words are hashed).
BITS = 20
BINS = 1 << BITS
#: Latent dimensions, oversampling and power iterations of the randomised SVD.  A block of the
#: benchmark has at most RANK passages.
RANK, OVER, POWER = 256, 16, 2
#: Share of an item passage's length that the axes may leave out; passages they represent worse add axes.
LOST = 0.01
#: Benchmark items handled in one pass over the documents (several blocks, each with its own space).
ITEMS = 2_000
#: Passages of items in one pass, so that items of many words make more passes and not larger ones.
PASSAGES = 16 * RANK
#: Slices in which the documents' sums of a block's words by its axes are added up, each in a task, and documents multiplied at once.
FIT_TASKS, FIT_ROWS = 4, 256
#: Projected cosine of a candidate; share of an item's (and its answer's) words found in order.
COSINE, LCS, ANSWER = 0.3, 0.6, 0.5
#: Passages whose gains are added up at once: of each some 32 rows of a block's width are copied.
AT_ONCE = 256
#: Slack on bounds, above the rounding of single precision.
EPS = 1e-3
PUNCTUATION = b".,;:!?\"'()[]{}<>-*_`|/\\"


def tokens(text: str | None) -> list[bytes]:
    """Words lower-cased (A-Z) and without punctuation; what was punctuation only is no word."""
    return text.encode().lower().translate(None, PUNCTUATION).split() if text else []


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents in which each word bin occurs, and the number of documents: all of them count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, splitter = np.zeros(BINS, np.int32), 0, Splitter(PUNCTUATION)
        for b in batches:
            n += b.num_rows
            for _, words in splitter.each(b.column(0)):
                bins = (words.keys()[1] >> np.uint64(64 - BITS)).astype(np.int64)
                text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
                total += np.bincount(np.unique(text << BITS | bins) & (BINS - 1), minlength=BINS).astype(np.int32)
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(got, -1).astype(np.int32)), pa.array(np.append(total[got], n).astype(np.int64))], ["bin", "n"])

    out, docs_n = np.zeros(BINS, np.int64), 0
    rows = docs.select("text").mapInArrow(trimmed(run), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # BINS + 1 rows at most
    for b in rows.to_batches():
        k, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        out[k[k >= 0]] = v[k >= 0]
        docs_n += int(v[k < 0].sum())
    return out, docs_n


def starts(n: int, passage: int = PASSAGE, stride: int = STRIDE) -> np.ndarray:
    """First words of the passages that cover ``n`` words."""
    if n <= passage:
        return np.zeros(1 if n else 0, np.int64)
    s = np.arange(0, n - passage + 1, stride)
    return s if s[-1] == n - passage else np.append(s, n - passage)


def all_starts(first: np.ndarray, passage: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the passages of texts that stand side by side (``first``: their first words and the end), and each one's text."""
    n = np.diff(first)
    whole = np.maximum(0, n - passage) // stride + 1
    rest = (n > passage) & ((n - passage) % stride > 0)
    each = np.where(n > 0, whole + rest, 0)
    text = np.repeat(np.arange(len(n)), each)
    k = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    return first[text] + np.minimum(k * stride, np.maximum(0, n - passage)[text]), text


@dataclass
class Item:
    """A benchmark item.  Positions of its words (and its answer's) are bits, by the words' numbers."""

    item_id: int
    words: list[bytes]
    answer: list[bytes]
    masks: dict[int, int]
    answer_masks: dict[int, int]

    @property
    def short(self) -> bool:
        return len(self.words) < SHORT_PASSAGE


def make_item(item_id: int, text: str | None) -> Item | None:
    """The answer of an item is its last line, or its last sentence if it has one line."""
    w = tokens(text)
    if not w:
        return None
    parts = [p for p in text.split("\n") if tokens(p)]
    if len(parts) == 1:
        parts = [p for p in re.split(r"(?<=[.!?])\s+", parts[0]) if tokens(p)]
    return Item(item_id, w, tokens(parts[-1]), {}, {})


def _masks(w: list) -> dict:
    out: dict = {}
    for k, x in enumerate(w):
        out[x] = out.get(x, 0) | 1 << k
    return out


def lcs(masks: dict, n: int, other: list) -> int:
    """Length of the longest common subsequence, all rows of a column at once as bits of one integer."""
    full = (1 << n) - 1
    v = full
    for w in other:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


@dataclass
class Block:
    """Some item passages: their words' numbers, and what each word adds to the dot products with them."""

    words: np.ndarray  # row -> number of the word
    gain: np.ndarray  # row -> its scaled latent row times the unit latent item passages
    owner: np.ndarray  # passage -> place of its item
    passage: int
    stride: int


@dataclass
class Benchmark:
    """Items of a pass, the numbers of their words, and the blocks of their passages."""

    vocab: list[bytes]
    items: list[Item]
    blocks: list[Block]


def item_terms(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """``(n, tf)`` of every whole text that has any of ``words``: their numbers, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, splitter = Vocabulary(words, BITS), Splitter(PUNCTUATION)
        for b in batches:
            for _, w in splitter.each(b.column(0)):
                keys, mixed = w.keys()
                numbers = vocab.numbers(w, keys, (mixed >> vocab.shift).astype(np.int64))
                text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
                pairs, tf = np.unique((text * len(words) + numbers)[numbers >= 0], return_counts=True)
                if len(pairs):
                    ends = np.append(np.flatnonzero(np.diff(pairs // len(words))) + 1, len(pairs))
                    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(x.astype(np.int32))) for x in (pairs % len(words), tf)]
                    yield pa.RecordBatch.from_arrays(lists, ["n", "tf"])

    return docs.select("text").mapInArrow(trimmed(run), "n array<int>, tf array<int>")


def latent_axes(terms: DataFrame, docs_n: int, unit: np.ndarray, row: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Leading axes (columns) of all documents and of the item passages ``unit``, by randomised SVD.

    A row of the matrix is a document, its whole text as TF-IDF of a block's words, of
    length 1; the item passages' rows have together the squared length of all documents',
    so that their directions are found however many documents there are.  ``row`` is the
    block's row of each word's number, -1 for others.  Each task adds up its share of
    A'(A Q), slices of the sums are added up by tasks, and only one matrix of the size
    of Q reaches the driver, where Q is made orthonormal again.
    """
    wide = len(weight)
    lead, rank = max(1.0, docs_n / len(unit)), min(RANK + OVER, wide)

    def rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        n, tf = batch.column(0), batch.column(1)
        text = np.repeat(np.arange(len(n)), n.value_lengths().to_numpy(zero_copy_only=False))
        at = row[n.flatten().to_numpy()]
        x = tf.flatten().to_numpy() * weight[at]
        text, at, x = text[at >= 0], at[at >= 0], x[at >= 0]
        x /= np.sqrt(np.bincount(text, x * x, len(n)))[text]
        for k in range(0, len(n), FIT_ROWS):
            lo, hi = np.searchsorted(text, (k, k + FIT_ROWS))
            if lo < hi:
                a = np.zeros((min(FIT_ROWS, len(n) - k), wide), np.float32)
                a[text[lo:hi] - k, at[lo:hi]] = x[lo:hi]
                yield a

    def times(q: np.ndarray, gram: bool) -> np.ndarray:
        own, shape = q.astype(np.float32), (q.shape[1] if gram else wide, q.shape[1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in batches:
                for a in rows(b):
                    y = a @ own
                    total += y.T @ y if gram else a.T @ y
            for k, part in enumerate(np.array_split(total, FIT_TASKS)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["k", "m"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    sums[k] = sums.get(k, 0) + np.frombuffer(m.as_buffer(), np.float32).astype(np.float64)
            for k, m in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["k", "m"])

        parts = terms.mapInArrow(trimmed(run), "k int, m binary").repartitionById(FIT_TASKS, F.col("k")).mapInArrow(trimmed(added), "k int, m binary")
        got = {r["k"]: np.frombuffer(r["m"]) for r in parts.toLocalIterator()}  # FIT_TASKS slices of one matrix
        y = unit @ q
        return lead * (y.T @ y if gram else unit.T @ y) + (np.concatenate([got[k] for k in sorted(got)]).reshape(shape) if got else 0)

    q = np.linalg.qr(np.random.default_rng(11).standard_normal((wide, rank)))[0]
    for _ in range(POWER + 1):
        q = np.linalg.qr(times(q, False))[0]
    values, turn = np.linalg.eigh(times(q, True))
    order = np.argsort(-values)[:RANK]
    return q @ turn[:, order[values[order] > 1e-9 * values.max()]]


def fit_block(terms: DataFrame, docs_n: int, own: list[tuple[int, list[bytes]]], number: dict[bytes, int], idf: np.ndarray, passage: int, stride: int) -> Block:
    """The latent space of all documents and of the item passages ``own``, all of a block, and the passages in it.

    Columns are the words of the passages, which their number bounds.  What the axes
    found leave out of an item passage gives further axes, so that no item is out of reach.
    """
    vocab: dict[bytes, int] = {}
    for _, words in own:
        for w in words:
            vocab.setdefault(w, len(vocab))
    weight, numbers = idf[Vocabulary(list(vocab), BITS).bins].astype(np.float64), np.array([number[w] for w in vocab], np.int64)
    unit = np.zeros((len(own), len(vocab)))
    for k, (_, words) in enumerate(own):
        unit[k] = np.bincount([vocab[w] for w in words], minlength=len(vocab)) * weight
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    row = np.full(len(number), -1, np.int32)
    row[numbers] = np.arange(len(vocab))
    v = complete(latent_axes(terms, docs_n, unit, row, weight), unit)
    near = unit @ v
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    return Block(numbers, (v * weight[:, None] @ near.T).astype(np.float32), np.array([k for k, _ in own], np.int64), passage, stride)


def complete(v: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Orthonormal axes ``v`` with those added that the passages (unit rows) need to keep their length."""
    rest = passages - (passages @ v) @ v.T
    rest = rest[np.linalg.norm(rest, axis=1) > LOST]
    if not len(rest):
        return v
    rest -= (rest @ v) @ v.T
    _, size, axes = np.linalg.svd(rest, full_matrices=False)
    return np.hstack([v, axes[size > 1e-6 * size[0]].T])


class Searcher:
    """Candidates of many texts by projected cosine, then exact checks."""

    def __init__(self, benchmark: Benchmark, idf: np.ndarray):
        self.items, self.blocks, self.idf = benchmark.items, benchmark.blocks, idf
        self.vocab, self.splitter = Vocabulary(benchmark.vocab, BITS), Splitter(PUNCTUATION)
        self.rows = []
        for x in self.blocks:  # number -> row of the block's gains; the last, which -1 finds, stands for words that are in none
            row = np.full(len(benchmark.vocab) + 1, -1, np.int32)
            row[x.words] = np.arange(len(x.words))
            self.rows.append(row)
        # What a word can add to any dot product, by its number; nothing for the others.
        self.most = []
        for x in self.blocks:
            most = np.zeros(len(benchmark.vocab) + 1)
            most[x.words] = np.maximum(0, x.gain.max(1))
            self.most.append(most)

    def candidates(self, words: Words, numbers: np.ndarray, upto: np.ndarray, x: Block, row: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, item, first word, projected cosine) of every passage that comes near an item passage; ``upto``: sums of squared weights."""
        at, text = all_starts(words.first, x.passage, x.stride)
        ends = np.minimum(at + x.passage, words.first[text + 1])
        norm = np.sqrt(upto[ends] - upto[at])
        # No dot product exceeds the sum of what the words can add to any, so nothing above the threshold is lost.
        bound = np.concatenate([[0], np.cumsum(most[numbers])])
        keep = (norm > 0) & (bound[ends] - bound[at] >= (COSINE - EPS) * norm)
        rows = row[numbers]
        places = np.flatnonzero(rows >= 0)
        rows = rows[places]
        at, ends, norm, text = at[keep], ends[keep], norm[keep], text[keep]
        lo, hi = np.searchsorted(places, at), np.searchsorted(places, ends)
        for a in range(0, len(at), AT_ONCE):
            first, n = lo[a : a + AT_ONCE], (hi - lo)[a : a + AT_ONCE]
            offsets = np.cumsum(n) - n
            each = np.repeat(first - offsets, n) + np.arange(n.sum())
            dots = np.add.reduceat(x.gain[rows[each]], offsets, axis=0)  # a passage that is kept has a word of the items
            cos = dots / norm[a : a + AT_ONCE].astype(np.float32)[:, None]
            for k, p in zip(*np.nonzero(cos >= COSINE), strict=True):
                yield int(text[a + k]), int(x.owner[p]), int(at[a + k]), float(cos[k, p])

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
        """(place of the text, item id, cosine, share of its words, share of its answer) of each item found."""
        for begin, words in self.splitter.each(texts):
            keys, mixed = words.keys()
            bins = (mixed >> self.vocab.shift).astype(np.int64)
            numbers = self.vocab.numbers(words, keys, bins)
            upto = np.concatenate([[0], np.cumsum(self.idf[bins].astype(np.float64) ** 2)])
            near: dict[tuple[int, int], list[tuple[int, float, int]]] = {}
            for x, row, most in zip(self.blocks, self.rows, self.most, strict=True):
                for text, item, s, c in self.candidates(words, numbers, upto, x, row, most):
                    near.setdefault((text, item), []).append((s, c, x.passage))
            for (text, item), places in sorted(near.items()):
                found = self._checked(numbers, int(words.first[text]), int(words.first[text + 1]), self.items[item], places)
                if found:
                    yield begin + text, self.items[item].item_id, max(c for _, c, _ in places), *found

    @staticmethod
    def _checked(numbers: np.ndarray, lo: int, hi: int, item: Item, places: list[tuple[int, float, int]]) -> tuple[float, float] | None:
        """The best (share of the item's words, share of its answer's) around the places, if both are enough."""
        n, m, done, best = len(item.words), len(item.answer), -1, None
        for s, _, passage in sorted(places):
            a, z = max(lo, s - n), min(hi, s + passage + n)
            if z <= done:
                continue  # inside a stretch already compared
            done = z
            # Words that the item does not have change no common subsequence; those it has bound its length.
            part = [y for y in numbers[a:z].tolist() if y in item.masks]
            if sum(item.masks[y].bit_count() for y in set(part)) < LCS * n:
                continue
            share = lcs(item.masks, n, part) / n
            if share >= LCS:
                answer = lcs(item.answer_masks, m, part) / m
                if answer >= ANSWER and (best is None or (share, answer) > best):
                    best = (share, answer)
        return best


def dealt(items: list[Item], short: bool) -> list[list[tuple[int, list[bytes]]]]:
    """(place of the item, words) of the passages of the items, in blocks of at most RANK, so that a latent space has room for each."""
    own = [(k, i.words[s : s + PASSAGE]) for k, i in enumerate(items) if i.short == short for s in starts(len(i.words))]
    return [own[k : k + RANK] for k in range(0, len(own), RANK)]


def _each_pass(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Benchmark, np.ndarray]]:
    """The benchmark in passes of about ``ITEMS`` items and ``PASSAGES`` passages, in blocks with their own latent spaces, and the weights by bin."""
    items = need(benchmark, ("item_id", "text")).where("text IS NOT NULL")
    passages = F.greatest(F.lit(1), F.ceil((F.regexp_count("text", F.lit(WORD)) - PASSAGE) / STRIDE) + 1)
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(passages), F.lit(0)).alias("passages")).first()
    if not size["n"]:
        return
    df, total = document_frequencies(docs)
    idf = (np.log((1 + total) / (1 + df)) + 0.01).astype(np.float32)
    del df
    passes = max(-(-size["n"] // ITEMS), -(-size["passages"] // PASSAGES))
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        made = [i for r in part if (i := make_item(r["item_id"], r["text"]))]
        if not made:
            continue
        number: dict[bytes, int] = {}
        for i in made:
            for w in i.words:
                number.setdefault(w, len(number))
            i.masks, i.answer_masks = _masks([number[w] for w in i.words]), _masks([number[w] for w in i.answer])
        mark = marked()
        terms = stored(item_terms(docs, list(number)), "lsa-terms")
        blocks = [fit_block(terms, total, own, number, idf, passage, stride) for short, passage, stride in ((False, PASSAGE, STRIDE), (True, SHORT_PASSAGE, SHORT_STRIDE)) for own in dealt(made, short)]
        discard(spark, mark)
        yield Benchmark(list(number), made, blocks), idf


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, cosine, lcs, answer)``: documents that hold a benchmark item, word for word or paraphrased.

    Every passage of 32 words of every whole text is projected into a latent space
    and compared with all item passages of a block of the benchmark (passages of 8
    words for items of fewer than 8); where the projected cosine is 0.3 or more, the
    text around the passage must have 60% of the item's words in the item's order, and
    half of its answer's.  Document frequencies are those of all documents; latent
    spaces are fitted to all documents, whole, and to all items.

    Null and empty texts hold nothing, nor do items without words; an item repeated
    in the benchmark is reported for each of its rows, a repeated document likewise.
    Null ids are returned as they are.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = need(docs, (id_col, text_col)).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double"
    out = spark.createDataFrame([], schema)
    for index in _each_pass(spark, rows, benchmark):
        shared = spark.sparkContext.broadcast(index)  # bounded by the passages of a pass, its largest item and the bins

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*shared.value)
            for b in batches:
                found = [(b.column(0)[k].as_py(), *hit) for k, *hit in searcher.search(b.column(1))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "cosine", "lcs", "answer"])

        out = out.unionAll(rows.mapInArrow(trimmed(run), schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark item (see ``find_leaks``); all columns stay.

    Rows are judged by their text alone, so ids may repeat or be null; null and empty
    texts stay, and an empty table on either side changes nothing.  Beyond one pass (2,000 items,
    4,096 passages) what each pass keeps is written before the next.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    whole, more = docs.select(F.col(f"`{text_col}`").alias("text")), False
    for index in _each_pass(spark, whole, benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*shared.value)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[k for k, *_ in searcher.search(b.column(at))]] = False
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns], schema=b.schema)

        docs = (stored(docs, "clean") if more else docs).mapInArrow(trimmed(run), docs.schema)
        more = True
    give_back()
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
