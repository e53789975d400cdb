"""Exact encoding and decoding with merge-type SentencePiece models, by backtracking.

A list of pieces is the model's answer for a text if every piece is what merging makes
of its own characters, and if merging the characters of each two neighbours anew never
joins across their border: a first join across a border would also be made with the
two neighbours alone, as the order of joins (score, then place) is the same there.  So
it is enough to search for a list whose neighbours are compatible: take the longest
piece that fits, a shorter one where it does not, and step back where none does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, read, trimmed

#: How SentencePiece writes a space.
SPACE = "▁"
#: What the library decodes the unknown piece to.
UNKNOWN = " ⁇ "
#: Chunks of text, and pairs of pieces, that a worker remembers before it starts over; longer chunks are not kept.
KEPT_CHUNKS, KEPT_PAIRS, KEPT_LENGTH = 1 << 18, 1 << 18, 64
#: Rows that are encoded before their ids leave Python.
ROWS = 128
_PROBE = "  It's 12 o'clock,\tÉtion über 日本語 \U0001f600\n\nthe   end "

_models: dict[str, Model] = {}


class Model:
    """The pieces of one model file; the library reads the file and does not encode.

    Models must have a piece for each byte, a single-character piece for each character
    in a piece, and leave texts as they are but for spaces and one in front; others are
    refused.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if sp.normalize(" a  ﬁ ") != SPACE + SPACE + "a" + 2 * SPACE + "ﬁ" + SPACE:
            raise ValueError("the model normalises texts")
        names = [sp.id_to_piece(k) for k in range(n)]
        special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) for k in range(n)]
        self.ids = {p: k for k, p in enumerate(names) if not special[k] and not sp.is_unused(k)}
        self.rank = {p: -sp.get_score(k) for p, k in self.ids.items()}
        self.bytes = {int(names[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
        chars = set("".join(self.ids))
        if len(self.bytes) < 256 or not chars <= self.ids.keys():
            raise ValueError("the model has no piece for some byte or character")
        self.raw = [b"" if sp.is_control(k) else UNKNOWN.encode() if sp.is_unknown(k) else bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(names)]
        self.is_byte = [sp.is_byte(k) for k in range(n)]
        self.opens = [p.startswith(SPACE) and not special[k] for k, p in enumerate(names)]
        self.controls = {k for k in range(n) if sp.is_control(k)}

        self.names = names
        self.size = list(map(len, names))
        self.finder = ahocorasick.Automaton()
        for p, k in self.ids.items():
            self.finder.add_word(p, k)
        self.finder.make_automaton()
        #: The longest piece that begins a piece and is shorter, by id; -1 where there is none.
        self.shorter = [-1] * n
        for p, k in self.ids.items():
            self.shorter[k] = next((self.ids[p[:z]] for z in range(len(p) - 1, 0, -1) if p[:z] in self.ids), -1)

        # No piece goes over these places, so a text may be cut there: before spaces, and around characters of no piece.
        alone = re.escape("".join(c for c in map(chr, range(0x80)) if c not in chars))
        inside = any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:], strict=False))
        word = rf"[^{alone}]+" if inside else rf"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+"
        self.chunks = re.compile(rf"{word}|[{alone}]+" if alone else word).findall
        self.known = _Chunks(self)
        self._whole: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        if self.encode(_PROBE) != sp.encode(_PROBE):
            raise ValueError("the model is not of the merge type")

    def merges_to(self, symbols: list[str], wall: int) -> bool:
        """Join neighbours, best score first, leftmost of equals first.  False once a join crosses ``wall`` (a
        number of symbols; 0 for no wall); True if at the end what the wall parts is whole."""
        rank = self.rank
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = rank.get(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return len(symbols) == (2 if wall else 1)
            if at + 1 == wall:
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if at + 1 < wall:
                wall -= 1

    def whole(self, k: int) -> bool:
        """Merging makes this piece from its characters."""
        if k not in self._whole:
            self._whole[k] = self.merges_to(list(self.names[k]), 0)
        return self._whole[k]

    def compatible(self, a: int, b: int) -> bool:
        """``b`` is whole, and merging the characters of ``a`` (-1: no piece, but a border), which is whole, and ``b`` anew gives those two."""
        pair = a * len(self.names) + b
        found = self._pairs.get(pair)
        if found is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            found = self._pairs[pair] = self.whole(b) and (a < 0 or self.merges_to(list(self.names[a] + self.names[b]), self.size[a]))
        return found

    def search(self, s: str) -> list[int]:
        """Ids of a chunk.  Each place is given up at most once, so the steps are linear in the chunk."""
        n, size, n_names = len(s), self.size, len(self.names)
        longest = [-1] * (n + 1)
        for end, k in self.finder.iter(s):
            longest[end - size[k] + 1] = k  # of the pieces from one place the longest ends last
        failed = bytearray((n >> 3) + 1)  # a bit for each place from which no list goes on
        fails = False
        known, shorter = self._pairs.get, self.shorter
        taken: list[int] = []  # below 0: a character of no piece, which goes with every neighbour
        at, k, before = 0, longest[0], -1
        while at < n:
            if k < 0:
                taken.append(-1)
                at += 1
                before, k = -1, longest[at]
                continue
            end = at + size[k]
            fits = known(before * n_names + k)
            if fits is None:
                fits = self.compatible(before, k)
            if fits and not (fails and failed[end >> 3] >> (end & 7) & 1):
                taken.append(k)
                at, before = end, k
                k = longest[at]
                continue
            k = shorter[k]
            while k < 0:
                failed[at >> 3] |= 1 << (at & 7)
                fails = True
                k = taken.pop()
                at -= size[k]
                before = taken[-1] if taken else -1
                k = shorter[k]
        if -1 not in taken:
            return taken
        out, at = [], 0
        for k in taken:
            if k < 0:
                out += [self.bytes[b] for b in s[at].encode()]
                at += 1
            else:
                out.append(k)
                at += size[k]
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.known.__getitem__, self.chunks(SPACE + text.replace(" ", SPACE)))))

    def decode(self, ids: list[int]) -> str:
        """As the library: one space in front goes, bytes that are no UTF-8 are a replacement character each."""
        first = next((k for k, x in enumerate(ids) if x not in self.controls), None)
        if first is None:
            return ""
        head = self.raw[ids[first]][1:] if self.opens[ids[first]] else self.raw[ids[first]]
        rest = ids[first + 1 :]
        if self.controls.isdisjoint(rest):  # they end runs of bytes
            try:
                return (head + b"".join(map(self.raw.__getitem__, rest))).decode()
            except UnicodeDecodeError:
                pass
        out, run = [], b""
        for x, raw in chain([(ids[first], head)], ((x, self.raw[x]) for x in rest)):
            if self.is_byte[x]:
                run += raw
            else:
                out += [_loose(run), raw.decode()]
                run = b""
        return "".join([*out, _loose(run)])


class _Chunks(dict):
    """Ids by chunk of text; starts over when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> list[int]:
        ids = self.model.search(chunk)
        if len(chunk) <= KEPT_LENGTH:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


def _loose(run: bytes) -> str:
    """UTF-8 where it is valid, else a replacement character for the byte."""
    out = []
    while run:
        width = 1 if run[0] < 0x80 else 2 if run[0] < 0xE0 else 3 if run[0] < 0xF0 else 4
        try:
            out.append(run[:width].decode())
        except UnicodeDecodeError:
            width = 1
            out.append("�")
        run = run[width:]
    return "".join(out)


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the ids of every whole text, one row for each row of ``docs``, without shuffles.

    ``model_path`` is where each machine has the model file.  A null text is an empty
    one and has no ids; ids that are null or repeated stay as they are; an empty table
    stays empty; other columns are ignored.  ``doc_id`` must be a number (long).  A
    task holds some rows at a time, a very long text alone with them.
    """
    rows = need(docs, (id_col, text_col)).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                part = b.slice(a, ROWS)
                ids = [np.array(m.encode(t), np.int32) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([part.column(0), column], schema=ENCODED)

    return rows.mapInArrow(trimmed(run), "doc_id long, ids array<int>")


def _texts(column: pa.Array, m: Model) -> Iterator[tuple[list[int], str]]:
    for x in column:
        ids = x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []
        yield ids, m.decode(ids)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids give the empty text, an id that the model lacks stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                part = b.slice(a, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for _, t in _texts(part.column(1), m)], pa.string())], schema=TEXT)

    return need(encoded, ("doc_id", "ids")).mapInArrow(trimmed(run), "doc_id long, text string")


def piece_digest(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``(doc_id, ids)``, decoding them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        decimal = list(map(str, range(len(m.raw))))
        for b in batches:
            out = []
            for doc_id, (ids, text) in zip(b.column(0).to_pylist(), _texts(b.column(1), m), strict=True):
                shown = ",".join(map(decimal.__getitem__, ids))
                out.append({"doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(shown.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, DIGEST)

    return need(encoded, ("doc_id", "ids")).mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(encode_pieces(read(spark, sf_dir, "documents"), public_model()), public_model())
