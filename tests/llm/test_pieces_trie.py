"""SentencePiece ids against the library, and the prefix trie against brute force, with odd inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F

from lodestone.llm import prefix_trie, sentencepieces

PATH = sentencepieces.public_model()
ALPHABET = ["a", "b", "e", "th", "s", " ", "  ", "\n", "\t", "\r\n", "▁", "é", "日", "本", "😀", "\0", "-", "=", "'", "1", "<0x41>", "<s>", "ing", "�", "　", "\xa0", "ệ", "́", "*", "<unk>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_pieces_equal_the_library(library):
    m, rng = sentencepieces.model(PATH), random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(4000)]
    texts += [x * n + y for n in range(1, 70) for x in (" ", "-", "=", "a", "*", "▁a", "\n", "ha") for y in ("", "x", " the")]
    texts.append("".join(rng.choices("abcdeéthing日", k=50_000)))  # one chunk
    for t in texts:
        ids = library.encode(t)
        assert m.encode(t) == ids, t
        assert m.decode(ids) == library.decode(ids), t


def test_decoding_of_any_ids(library):
    m, rng = sentencepieces.model(PATH), random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 28705, 259, 0, 1, 2]) for _ in range(rng.randrange(8))]
        assert m.decode(ids) == library.decode(ids), ids


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT_CHUNKS", 3)
    monkeypatch.setattr(sentencepieces, "KEPT_PAIRS", 2)
    m, rng = sentencepieces.Model(PATH), random.Random(4)
    for _ in range(200):
        t = "".join(rng.choices(ALPHABET, k=30))
        assert m.encode(t) == library.encode(t)
    assert len(m.known) <= 3 and len(m._pairs) <= 2


def test_pieces_of_documents(spark, library):
    odd = [None, "", " ", "\n", "a", "a", "é 日本 😀", "x" * 9000, "word " * 5000]
    df = spark.createDataFrame([*enumerate(odd), (None, "no id"), (3, "again")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    encoded = sentencepieces.encode_pieces(df, PATH)
    want = sorted(((i, library.encode(t or "")) for i, t in [*enumerate(odd), (None, "no id"), (3, "again")]), key=str)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == want
    texts = {str((r.doc_id, r.text)) for r in sentencepieces.decode_pieces(encoded, PATH).collect()}
    assert texts == {str((i, t or "")) for i, t in [*enumerate(odd), (None, "no id"), (3, "again")]}
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepieces.piece_digest(encoded, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests == {(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, ids in want}
    assert sentencepieces.piece_digest(sentencepieces.encode_pieces(df.limit(0), PATH), PATH).count() == 0


# Prefix trie ---------------------------------------------------------------------


def plain_trie(paths):
    """``paths``: id to list of (role, text).  Nodes by (smallest member, depth)."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
            if d < len(p):
                kids[tuple(p[:d])].add(tuple(p[: d + 1]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for q, who in members.items():
        for d in range(len(q) + 1):
            leaves[q[:d]] += not kids[q]
            saved[q[:d]] += (len(who) - 1) * len(q[-1][1].encode()) if q else 0
    return {
        (min(who), len(q)): (min(members[q[:-1]]) if q else None, len(who), len(kids[q]), leaves[q], saved[q], hashlib.sha256(",".join(map(str, sorted(c for c in who if len(paths[c]) == len(q)))).encode()).hexdigest())
        for q, who in members.items()
    }


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def in_order(rows):
    out = defaultdict(list)
    for c, _, r, x in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda z: (z[0], z[1] is not None, z[1] or 0, z[2], z[3])):
        out[c].append((r, x))
    return out


@pytest.fixture(params=[1, 3, 17])
def parts(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_trie_against_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    monkeypatch.setattr(prefix_trie, "HEAVY", 4)
    rng = random.Random(parts)
    rows = []
    for c in range(-20, 120):
        shape = rng.random()
        deep = 12 if shape < 0.3 else rng.randrange(1, 5)
        for t in range(deep):
            text = "same ü" if shape < 0.5 else rng.choice(["x", "yy", None, "", "same ü"])
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, 1]), rng.choice(["user", "assistant", None]) if shape > 0.8 else "user", text))
    rows += rows[:9] + [(None, 0, "user", "of nobody")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash")).withColumn("key", F.lit(0))
    seqs = prefix_trie.sequences(df)
    paths = in_order(rows)
    assert found(prefix_trie.prefix_trie(seqs)) == plain_trie(paths)

    def head(c):
        return zlib.crc32(str(c).encode()) % 9

    def base(c):
        return c - (c % 5 if c >= 0 else -(-c % 5))

    again = {c: paths.get(base(c), [])[: head(c)] + p[head(c) :] for c, p in paths.items()}
    rebuilt = prefix_trie.rebuilt(seqs, F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9, 8)
    assert found(prefix_trie.prefix_trie(rebuilt)) == plain_trie(again)


def test_trie_of_few_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.sequences(empty)).count() == 0
    turnless = spark.createDataFrame([(5, [], []), (3, [], [])], "conv_id long, path array<string>, sizes array<long>")
    assert found(prefix_trie.prefix_trie(turnless)) == plain_trie({5: [], 3: []})
    one = spark.createDataFrame([(7, 0, None, "ab"), (7, 1, "user", None)], empty.schema)
    assert found(prefix_trie.prefix_trie(prefix_trie.sequences(one))) == plain_trie({7: [("", "ab"), ("user", "")]})
    # Role and text are kept apart.
    two = spark.createDataFrame([(1, 0, "a", "bc"), (2, 0, "ab", "c")], empty.schema)
    assert found(prefix_trie.prefix_trie(prefix_trie.sequences(two))) == plain_trie({1: [("a", "bc")], 2: [("ab", "c")]})
