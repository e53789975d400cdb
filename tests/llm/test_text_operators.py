"""Chat formatting, token files, SimHash and language-model scores against brute force, with odd inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import chat, components, huffman, ppm, simhash, tokens
from lodestone.llm.common import discard, marked, release, stored, tables, words
from lodestone.llm.components import connected_components

DOC = "doc_id long, text string"
ODD = [None, "", " ", "\n\t", "a", "a b", "A B", "é 日本 😀", "x" * 5000, "w " * 3000, "same text here", "same text here"]


def odd_docs(spark, extra=()):
    rows = [(i, t) for i, t in enumerate([*ODD, *extra])] + [(None, "no id"), (4, "a")]
    return spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("size", F.lit("x"))


@pytest.mark.parametrize("few", [components.FEW_EDGES, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500 + i) for i in range(1, 40)] + [(7, None), (3, 3), (1, 2), (2, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    named = connected_components(spark.createDataFrame([("é", "z"), ("z", "a"), ("é", "日")], "u string, v string"))
    assert {tuple(r) for r in named.collect()} == {(x, "a") for x in ("a", "é", "z", "日")}


def test_tables_belong_to_the_call_that_wrote_them(spark):
    mine = stored(spark.range(5), "mine")
    with tables() as own:
        theirs = stored(spark.range(7), "theirs")
        mark = marked()
        discard(spark, mark)
        gone = stored(spark.range(3), "gone")
        discard(spark, mark)
    assert own == [theirs._stored_at]
    assert release(spark, own) == 1 and mine.count() == 5
    with pytest.raises(Exception, match="(?i)exist"):
        gone.count()


# Chat ------------------------------------------------------------------------


def test_chat_round_trip_and_mask(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|<|", "a<", "", None, "\n", "plain % \\ text"]
    rows = [(c, t, r, said[(c + t) % len(said)]) for c in range(9) for t, r in enumerate(("user", "assistant", "user", "assistant"))]
    rows += [(None, 0, "user", "x"), (None, None, "a\nb%0A", "y"), (77, 1, "assistant", "early"), (77, 1, "assistant", "early"), (78, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    chats = chat.format_chats(df)
    template = chat.ChatTemplate()
    turns = {}
    for c, t, r, x in sorted(rows, key=lambda z: (z[0] is None, z[0] or 0, z[1] is not None, z[1] or 0, z[2] or "", z[3] or "")):
        turns.setdefault(c, []).append((r or "", x or ""))
    made = {r.conv_id: r for r in chats.collect()}
    assert made.keys() == turns.keys()
    for c, r in made.items():
        assert list(template.parse(r.formatted)) == turns[c]
        assert [s.start for s in r.segments] == [0, *[s.end for s in r.segments][:-1]] and r.segments[-1].end == len(r.formatted)
    assert made[0].valid and not made[77].valid and "early" in made[77].formatted
    for r in chat.digests(chats).collect():
        loss = "".join(x for role, x in turns[r.conv_id] if role == "assistant")
        assert r.n_turns == len(turns[r.conv_id]) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns[r.conv_id]).encode()).hexdigest()
    assert chat.format_chats(df.where("false")).count() == 0


# Token files -------------------------------------------------------------------


@pytest.mark.parametrize("n, vocab, limit", [(0, 5, 8), (1, 5, 8), (2, 2, 1), (9, 3, 4), (20_000, 5_000, 13), (5_000, 64, 6), (70_000, 300, 18)])
def test_huffman(n, vocab, limit):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % vocab).astype(np.int64)
    counts = np.bincount(ids, minlength=vocab)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max(initial=0) <= limit and (lengths[counts > 0] > 0).all() and (np.exp2(-lengths[lengths > 0].astype(float))).sum() <= 1
    payload, marks, bits = huffman.pack(ids, huffman.canonical_codes(lengths), lengths, 128)
    table, width = huffman.decode_table(lengths)
    assert (huffman.unpack(payload, marks, n, 128, table, width) == ids).all() and bits == int((counts * lengths).sum())


def test_unlimited_lengths_are_optimal():
    import heapq

    counts = np.array([50, 20, 10, 5, 5, 4, 3, 2, 1])
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    total, k = 0, 100
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k := k + 1))
    assert int((counts * huffman.code_lengths(counts, 20)).sum()) == total


def test_token_files(spark):
    path = tokens.public_tokenizer()
    enc = tokens.Encoder(path)
    extra = ["a  b", " a", "a ", "a   b", "a \n b", "x<|endoftext|>y <|endoftext|> z", "it's we'll", "a \n\n  b\t c", "z\u0085y \x1c z"]
    docs = odd_docs(spark, extra)
    got = tokens.token_digest(docs, path, 2).collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    whole = enc.tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want, at = [], 0
    for (i, _), e in zip(rows, whole, strict=True):
        ids = np.array([*e.ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokens.token_digest(docs.where("false"), path, 2).count() == 0


def test_pieces_against_the_whole_library():
    import pyarrow as pa

    enc = tokens.Encoder(tokens.public_tokenizer(), 1 << 10)
    rng = random.Random(3)
    parts = [*"abAZ '\n\t.,<|>#é×÷\u00a0\u2003\u3000\x1c\x85“—日Ñß0179 ", "<|endoftext|>", "'s", "'re", " the", "n't", "\r\n", "😀", "a" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    ids, n = enc.encode(pa.array(texts))
    whole = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert n.tolist() == [len(e.ids) for e in whole] and ids.tolist() == [i for e in whole for i in e.ids]


def test_words_of_many_texts():
    import pyarrow as pa

    from lodestone.llm import decontam, wordscan

    rng = random.Random(4)
    texts = [None, "", *("".join(rng.choice("abC .-\n\té日,") for _ in range(rng.randint(0, 80))) for _ in range(500)), "x" * 40 + " " + "x" * 39 + "y"]
    vocab = sorted({w for t in texts[::3] for w in decontam.tokens(t)} | {b"x" * 40})
    known = wordscan.Vocabulary(vocab, 12)
    for first, words in wordscan.Splitter(decontam.PUNCTUATION).each(pa.array(texts)):
        keys, mixed = words.keys()
        numbers = known.numbers(words, keys, (mixed >> known.shift).astype(np.int64))
        for k, (a, z) in enumerate(zip(words.first, words.first[1:], strict=False)):
            want = decontam.tokens(texts[first + k])
            assert [words.word(i) for i in range(a, z)] == want
            assert numbers[a:z].tolist() == [vocab.index(w) if w in set(vocab) else -1 for w in want]


# SimHash -----------------------------------------------------------------------


def plain_fingerprint(text, size):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_fingerprints():
    rng = random.Random(2)
    for t in [*ODD, " ".join(rng.choice("abcdef") for _ in range(300))]:
        for size in (1, 3, 5):
            assert simhash.fingerprint(t, size) == plain_fingerprint(t, size)


@pytest.mark.parametrize("differing, group", [(2, 2048), (2, 40), (3, 40)])
def test_links_are_complete(spark, differing, group):
    rng = random.Random(differing)
    values = {rng.getrandbits(64) for _ in range(4)}
    for b in list(values):
        for _ in range(25):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    half = rng.getrandbits(32)
    values |= {half | rng.getrandbits(32) << 32 for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= differing}
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), differing, group).collect()}
    assert got == want and want


def test_simhash_of_odd_inputs(spark):
    got = {}
    for r in simhash.simhash_classes(odd_docs(spark), 3, 2).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got[0] == got[1] == got[2] == got[3] == {0} and got[10] == got[11] == {10} and got[None] == {None}
    kept = simhash.simhash_dedup(odd_docs(spark), 3, 2)
    assert kept.columns == odd_docs(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({0, 4, 5, 7, 8, 9, 10}) and ids.count(None) == 1
    assert simhash.simhash_classes(odd_docs(spark).where("false")).count() == 0


# Language model ----------------------------------------------------------------


def test_scores_equal_the_trie(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice(["an", "the", "re", "or", "qu"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    docs = odd_docs(spark, texts)
    order = 3
    learn = F.col("doc_id") % 3 != 0
    rows = docs.collect()
    trie, counts = ppm.Trie(order), Counter()
    for r in rows:
        if r.doc_id is not None and r.doc_id % 3:
            s = bytes([ppm.START]) * order + ppm.symbols(r.text)
            for k in range(order, len(s)):
                trie.learn(s[k - order : k], s[k])
            counts.update([*words(r.text), b"\n"])
    n, v = sum(counts.values()), len(counts)
    got = ppm.score_documents(docs, learn, order).collect()
    want = []
    for r in rows:
        w = [*words(r.text), b"\n"]
        base = sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((r.doc_id, len(w), sum(counts[x] > 0 for x in w), n, base, trie.code(r.text, adapt=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-6)


def test_scores_without_training_and_adaptive(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: r for r in ppm.score_documents(docs, F.lit(False), 2).collect()}
    assert got[1].score == pytest.approx(np.log10(1 / 256)) and got[1].train_tokens == 0 and got[5].n_known == 0
    assert ppm.score_documents(docs.where("false"), F.lit(True)).count() == 0
    few = {r.doc_id: r.score for r in ppm.adaptive_scores(spark.createDataFrame([(1, "abababababababab"), (2, "qwzxcvbnmlkjhgfd"), (3, None)], DOC)).collect()}
    assert few[1] > few[2] and few[3] < 0
