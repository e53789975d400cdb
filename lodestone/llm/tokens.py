"""Token ids of documents, Huffman-coded in blocks that decode independently."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import huffman
from .common import need, note, read, shared_dir, stored, trimmed
from .wordscan import KEY_BYTES, keys_of

#: Longest code in bits; a window of that many bits indexes the decoding table.
CODE_LIMIT = 18
#: A block is closed at the first document end after this many ids.
BLOCK_IDS = 1 << 16
#: Ids between two bit-offset checkpoints.
CHECKPOINT_IDS = 128
#: Slots of a worker's table of pieces, and the most ids of a piece that is kept there.
SLOTS, KEPT_IDS = 1 << 19, 8
#: Bytes of text that are cut and looked up at once.
WINDOW = 1 << 20

_encoders: dict[str, Encoder] = {}


def byte_symbols() -> str:
    """The characters by which byte-level BPE writes bytes: printable ones themselves, the others from U+0100 on."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in set(same) else chr(next(others)) for b in range(256))


def _spans(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of ``n`` elements from each start, one span after the other."""
    return np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)


class Pieces:
    """A table of bounded size from pieces of text to their ids, looked up for many pieces at once.

    A piece of up to 24 bytes is its own key (three words and its length), so no two
    are ever taken for one another.  Each has one slot; what comes later takes it over.
    """

    def __init__(self, dtype: str, slots: int = SLOTS):
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.keys = np.zeros((KEY_BYTES // 8, slots), np.uint64)
        self.size = np.zeros(slots, np.uint8)
        self.n = np.zeros(slots, np.uint8)
        self.ids = np.zeros((slots, KEPT_IDS), dtype)

    def keys_of(self, x: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key of each piece and its slot; ``x`` has 32 bytes after its end."""
        keys, mixed = keys_of(x, starts, size)
        return keys, (mixed >> self.shift).astype(np.int64)

    def holds(self, keys: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        found = (self.size[slot] == size) & (size <= KEY_BYTES)
        for own, key in zip(self.keys, keys, strict=True):
            found &= own[slot] == key
        return found

    def put(self, keys: np.ndarray, size: np.ndarray, slot: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """``ids`` of all pieces one after the other, ``n`` of each; those that fit are kept."""
        keep = np.flatnonzero((size <= KEY_BYTES) & (n <= KEPT_IDS))
        slot, first = np.unique(slot[keep], return_index=True)
        keep = keep[first]
        for own, key in zip(self.keys, keys, strict=True):
            own[slot] = key[keep]
        self.size[slot], self.n[slot] = size[keep], n[keep]
        rows = np.zeros((len(keep), KEPT_IDS), self.ids.dtype)
        rows[np.arange(KEPT_IDS) < n[keep, None]] = ids[_spans((np.cumsum(n) - n)[keep], n[keep])]
        self.ids[slot] = rows


class Encoder:
    """A tokenizer that encodes each distinct piece of text once.

    A byte-level BPE with the usual pattern never joins text at these places, so a
    text is cut there and the pieces' ids are remembered: before a space that a
    non-space follows, on both sides of line feeds beside what is no white space,
    and between a letter and an ASCII mark that no added token has.  New pieces of
    letters, a space before them or not, are one word of the pattern, so the library's BPE model gets
    them side by side; their ids are told apart by the bytes that each id stands
    for.  Other new pieces, and texts of tokenizers of other kinds, go through the
    whole library.
    """

    def __init__(self, path: str, slots: int = SLOTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, model, added = spec.get("pre_tokenizer") or {}, spec.get("model") or {}, spec.get("added_tokens", [])
        self.by_piece = (
            not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        )
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = id_type(max(vocab.values()))
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        if not self.by_piece:
            return
        for token, k in vocab.items():
            self.width[k] = len(token)  # a byte-level token has one character for each byte
        for t in added:
            self.width[t["id"]] = len(t["content"].encode())
        self.pieces = Pieces(self.dtype, slots)
        self.symbols = dict(enumerate(byte_symbols())) | {0xFF: " "}  # no UTF-8 has the byte FF
        self.word = Tokenizer(self.tokenizer.model)
        self.word.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        # The pattern's alternatives begin with contractions, which have an apostrophe; letters up to U+024F are letters in every version of Unicode.
        own = "".join(t["content"] for t in added)
        self.plain = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+").fullmatch if all(re.search(r"[^\w\s]", t["content"]) for t in added) else re.compile(r"(?!)").fullmatch
        byte = np.arange(256)
        self.letter = ((byte | 32) >= 97) & ((byte | 32) <= 122)
        self.printable = (byte > 32) & (byte < 127)
        # First bytes of characters that are no white space: C2 and E1 to E3 begin some that are.
        self.visible = self.printable | ((byte >= 0xC3) & (byte <= 0xE0)) | (byte >= 0xE4)
        self.visible[[t["content"].encode()[0] for t in added if t["content"]]] = False  # white space before an added token stays together
        self.mark = self.printable & ~self.letter & ~np.isin(byte, [ord(c) for c in "0123456789'" + own if c.isascii()])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of letters, a space before them or not, and how many each has."""
        out, counts = [], []
        for k in range(0, len(pieces), 4096):
            part = pieces[k : k + 4096]
            shown = "\xff".join([p.decode("latin-1") for p in part]).translate(self.symbols)
            ids = np.array(self.word.encode_batch_fast([shown], add_special_tokens=False)[0].ids, self.dtype)
            ends, stops = np.cumsum(self.width[ids]), np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            at = np.searchsorted(ends, stops)
            if len(ids) and at[-1] == len(ids) - 1 and (ends[at] == stops).all():
                out.append(ids)
                counts.append(np.diff(at, prepend=-1))
            else:
                one = self._ids([p.decode() for p in part])
                out += one
                counts.append(np.fromiter(map(len, one), np.int64, len(one)))
        return np.concatenate([np.zeros(0, self.dtype), *out]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        text = [p.decode() for p in pieces]
        plain = np.fromiter((self.plain(t) is not None for t in text), bool, len(text))
        ids, n = self._words(list(compress(pieces, plain)))
        odd = list(compress(text, ~plain))
        more = [x for a in range(0, len(odd), 4096) for x in self._ids(odd[a : a + 4096])]
        counts = np.zeros(len(pieces), np.int64)
        counts[plain], counts[~plain] = n, np.fromiter(map(len, more), np.int64, len(more))
        out, own = np.zeros(int(counts.sum()), self.dtype), np.repeat(plain, counts)
        out[own] = ids
        if more:
            out[~own] = np.concatenate(more)
        return out, counts

    def _starts(self, x: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """First bytes of the pieces of texts that stand side by side in ``x``; no piece is in two texts."""
        cut = np.zeros(len(x), bool)
        feed = x == 10
        cut[:-1] = (feed | (x == 32))[:-1] & self.visible[x[1:]]  # the last of several white spaces is a word of the pattern
        letter = self.letter[x]
        letter[1:] |= (x[:-1] == 0xC3) & (x[1:] != 0x97) & (x[1:] != 0xB7)  # U+00C0 to U+00FF but the signs of times and division
        cut[1:] |= (feed[1:] & (letter | self.printable[x])[:-1]) | (feed[:-1] & self.visible[x[1:]]) | (letter[:-1] & self.mark[x[1:]])
        some = ends > begins
        last = ends[some] - 1
        cut[last[(x[last] == 32) | feed[last]]] = False  # what follows is another text
        after_letter = last[feed[last] & (last > begins[some])]
        cut[after_letter] = (letter | self.printable[x])[after_letter - 1]
        cut[begins[some]] = True
        return np.flatnonzero(cut)

    def _window(self, x: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self._starts(x, begins, ends)
        size = np.diff(starts, append=len(x))
        keys, slot = self.pieces.keys_of(np.concatenate([x, np.zeros(32, np.uint8)]), starts, size)
        known = self.pieces.holds(keys, size, slot)
        n = self.pieces.n[slot].astype(np.int64)
        kept = self.pieces.ids[slot[known]][np.arange(KEPT_IDS) < n[known, None]]
        missing = np.flatnonzero(~known)
        raw = x.tobytes()
        seen: dict[bytes, int] = {}
        which = [seen.setdefault(raw[a : a + z], len(seen)) for a, z in zip(starts[missing].tolist(), size[missing].tolist(), strict=True)]
        made, counts = self._new(list(seen))
        which = np.array(which, np.int64)
        n[missing] = counts[which]
        old = np.repeat(known, n)
        out = np.empty(len(old), self.dtype)
        out[old] = kept
        out[~old] = made[_spans((np.cumsum(counts) - counts)[which], counts[which])]
        first = missing[np.unique(which, return_index=True)[1]]  # pieces are numbered as they come
        self.pieces.put(keys[:, first], size[first], slot[first], made, counts)
        upto = np.concatenate([[0], np.cumsum(n)])
        return out, upto[np.searchsorted(starts, ends)] - upto[np.searchsorted(starts, begins)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other in ``dtype``, and how many each has.  The texts are not null."""
        if not self.by_piece:
            ids = self._ids(texts.to_pylist())
            return np.concatenate([np.zeros(0, self.dtype), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        x = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        out, counts, a = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)], 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(at, at[a] + WINDOW, "right")) - 1)  # a longer text is alone
            ids, n = self._window(x[at[a] : at[z]], at[a:z] - at[a], at[a + 1 : z + 1] - at[a])
            out.append(ids)
            counts.append(n)
            a = z
        return np.concatenate(out), np.concatenate(counts)


def largest_id(path: str) -> int:
    """The largest id of a tokenizer file, found without building the tokenizer (the driver needs no more)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    most = max(vocab.values(), default=0) if isinstance(vocab, dict) else len(vocab) - 1
    return max([most, *(t["id"] for t in spec.get("added_tokens", []))])


def id_type(largest: int) -> str:
    """Two bytes an id where the vocabulary allows it, else four."""
    return "<u2" if largest < 1 << 16 else "<u4"


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, counts)``: ids as a binary of little-endian integers of two or four bytes (``id_type``), ``end_id`` appended.

    Each task ends with one row that has only ``counts``: its ids and how often each
    occurred, so that counting need not read the ids again.  A null or empty text has no ids
    but ``end_id``; null ids stay, repeated rows are encoded each; other columns are ignored.
    """
    rows = need(docs, (id_col, text_col)).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dtype = id_type(largest_id(tokenizer_path))
    end = end_id is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        total = np.zeros(max(len(enc.width), (end_id or 0) + 1), np.int64)
        for b in batches:
            for a in range(0, b.num_rows, 256):  # bounds what is held beside the batch
                part = b.slice(a, 256)
                ids, n = enc.encode(part.column(1))
                ends = np.cumsum(n + bool(end))
                if end:
                    own = np.ones(len(ids) + len(n), bool)
                    own[ends - 1] = False
                    with_end = np.full(len(own), end_id, dtype)
                    with_end[own] = ids
                    ids = with_end
                total += np.bincount(ids, minlength=len(total))
                at = np.concatenate([[0], ends]) * ids.itemsize
                column = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), column, pa.nulls(len(n), pa.binary())], schema=ENCODED)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pylist([{"counts": np.stack([found, total[found]]).tobytes()}], ENCODED)

    return rows.mapInArrow(trimmed(run), "doc_id long, ids binary, counts binary")


def id_counts(encoded: DataFrame) -> DataFrame:
    """``(id, n)`` over all documents, from the sums that the tasks wrote."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                ids, n = np.frombuffer(x, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "n"])

    return encoded.select("counts").where("counts IS NOT NULL").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCK = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("n_bits", pa.int64()), ("checkpoints", pa.binary()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64()))])
BLOCK_DDL = "shard long, block long, first long, n_ids long, n_bits long, checkpoints binary, payload binary, doc_ids array<long>, doc_lens array<long>"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = CODE_LIMIT) -> None:
    """Tokenize whole documents and write ``path/codebook`` and ``path/blocks``.

    Documents are in ascending order of id over the shards (null first; equal ids
    by content), and a block holds whole documents, so any block can be decoded
    alone with the code book: ``checkpoints`` has the bit offset of every 128th id.
    Shards are range partitions of (id, digest of content), so an id shared by a
    third of the rows spreads over several.  The code book holds one length for
    each id up to the largest used, which the vocabulary bounds; nothing else comes
    to the driver.  A null or empty text is an empty document (plus ``end_id``);
    repeated rows stay; an empty table gives a code book without codes and no blocks.
    """
    spark = docs.sparkSession
    encoded = stored(encode_documents(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    dtype = id_type(largest_id(tokenizer_path))
    found = id_counts(encoded).collect()  # at most a row for each id of the vocabulary
    counts = np.zeros(max((r["id"] for r in found), default=-1) + 1, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    lengths = huffman.code_lengths(counts, max(limit, int(np.ceil(np.log2(max(2, np.count_nonzero(counts)))))))
    spark.createDataFrame([(bytearray(lengths.tobytes()), CHECKPOINT_IDS)], "lengths binary, every int").coalesce(1).write.parquet(f"{path}/codebook")
    codes = huffman.canonical_codes(lengths)
    bytes_each = np.dtype(dtype).itemsize

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype).astype(np.int64)
            payload, marks, bits = huffman.pack(ids, codes, lengths, CHECKPOINT_IDS)
            row = {"shard": shard, "block": block, "first": first, "n_ids": len(ids), "n_bits": bits, "checkpoints": marks.astype("<i8").tobytes(), "payload": payload, "doc_ids": names, "doc_lens": [len(x) // bytes_each for x in held]}
            return pa.RecordBatch.from_pylist([row], BLOCK)

        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names.append(name)
                held.append(x)
                size += len(x) // bytes_each
                if size >= BLOCK_IDS:
                    yield close()
                    block, first = block + 1, first + size
                    held, names, size = [], [], 0
        if names:
            yield close()

    tie = F.xxhash64("ids")
    dealt = encoded.where("ids IS NOT NULL").withColumn("tie", tie).repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("tie")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "ids")
    dealt.select("doc_id", "ids").mapInArrow(trimmed(blocks), BLOCK_DDL).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document, decoded from the files at ``path``.

    ``start`` counts the ids of all documents before it.  Tasks read blocks in any order.
    Documents without ids have an empty binary, those without an id of their own a null
    one; files of an empty table give no rows.
    """
    book = spark.read.parquet(f"{path}/codebook").first()
    lengths, every = np.frombuffer(bytes(book["lengths"]), np.uint8), book["every"]
    blocks = spark.read.schema(BLOCK_DDL).parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = huffman.decode_table(lengths)
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in b.schema.names}
                ids = huffman.unpack(row["payload"], np.frombuffer(row["checkpoints"], "<i8"), row["n_ids"], every, table, width).astype("<u4")
                ends = np.cumsum(row["doc_lens"])
                starts = ends - row["doc_lens"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(ends), pa.int64()), pa.array(starts + row["first"], pa.int64()), pa.array(row["doc_lens"], pa.int64()), pa.array([ids[a:z].tobytes() for a, z in zip(starts, ends, strict=True)], pa.binary())],
                    ["doc_id", "shard", "start", "n_tokens", "ids"],
                )

    before = F.expr("sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    docs = blocks.mapInArrow(trimmed(decode), "doc_id long, shard long, start long, n_tokens long, ids binary")
    # One row a shard, and a shard is an output partition: that bounds what is broadcast.
    return docs.join(F.broadcast(shards), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` in the token format, read the files back, and digest each document."""
    path = f"{shared_dir(docs.sparkSession)}/lodestone/token-files-{uuid.uuid4().hex}"
    note(path)
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(read(spark, sf_dir, "documents"), public_tokenizer(), end_id=2)
