"""Tokens, stores, formats: exact round trips on small fixtures with nulls, ties, repeats, empty and odd texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import byte_bpe, chat, token_store

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "\n", "'", "s", "re", "ll", "é", "1", "!", "  \n", " ", "中", "'ve", "²", "_"]


def odd_texts(n, seed, longest=300):
    rng = random.Random(seed)
    return [None, "", "a", "  \n x's  don't 'r're'll ", "x" * 500, " " * 300, "é　​😀 1234 a_b !!"] + [
        "".join(rng.choice(PIECES) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 12), (64, 4), (1 << 16, 1 << 10)])
def test_chunked_encoding_is_the_plain_one(spark, chunk, overlap):
    texts = odd_texts(60, 1)
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(9, texts[9], "q"), (9, texts[9], "q"), (None, texts[12], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    plain = byte_bpe.encoding(RANKS, PATTERN)
    made = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN, chunk=chunk, overlap=overlap), RANKS)
    got = sorted([(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in made.collect()], key=str)
    want = []
    for i, t, _ in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(docs, RANKS, PATTERN).count() == 0
    store = token_store.write(docs, TOKENIZER)
    assert token_store.lookup(docs, store).count() == token_store.scan(spark, store).count() == 0
    assert chat.format_trees(chat.conversation_trees(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_word_encoder_equals_library():
    library, encode = token_store.tokenizer(TOKENIZER), token_store.Encoder(TOKENIZER)
    texts = [t or "" for t in odd_texts(1500, 2, 60)] + [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(token_store.CLASSED)] + ["<|endoftext|> x", "it's 'sun' \n 'tis"]
    ids, sizes = encode(texts)
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_store_round_trip(spark):
    library = token_store.tokenizer(TOKENIZER)
    texts = odd_texts(150, 3, 80)
    rows = [(i * 7 - 50, t, "k") for i, t in enumerate(texts)] + [(6, "dup b", "x"), (6, "dup a", "x"), (None, "no key", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    want, base = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, base, len(ids), zlib.crc32(ids.tobytes())))
        base += len(ids)
    store = token_store.write(docs, TOKENIZER, shards=5)
    read = lambda df, key: sorted([(r[key], r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in df.collect()], key=str)
    assert read(token_store.lookup(docs, store), "doc_id") == sorted([w for w in want if w[0] is not None], key=str)
    assert read(token_store.scan(spark, store), "key") == sorted(want, key=str)
    assert token_store.lookup(spark.createDataFrame([(10 ** 9,), (None,)], "doc_id long"), store).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    hashes = token_store.key_hash(np.arange(-3000, 9000) * 977)
    arrays, slots = token_store.build_perfect_hash(hashes)
    assert sorted(slots) == list(range(len(hashes)))
    assert (token_store.find_slots(arrays, hashes[::-1]) == slots[::-1]).all()
    assert arrays["sizes"].sum() < 6 * len(hashes)


def test_trees_rank_escape_and_read_back(spark):
    rows = [
        ("t", 1, None, "u", "root <| \\ ", 1.0), ("t", 2, 1, "assistant", "a\\<|im_end|>\n\\|", 0.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 3, "us\ner", None, 1.0),
        ("t", 5, 3, "user", "zz", 1.0), ("t", 9, 8, "u", "circle", 0.0), ("t", 8, 9, "u", "circle", 0.0), (None, 1, None, None, None, None), ("t", 5, 3, "user", "zz", 1.0),
        ("t", 20, 77, "assistant", "x", None), ("t", None, 1, "user", "no id", 9.0)]
    trees = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double").withColumn("leaf", F.lit("clash"))
    made = chat.format_trees(trees, best=5)
    got = {(r.tree, r.leaf): ([tuple(t) for t in r.turns], r.loss, r.rank) for r in made.select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    root, b = ("u", "root <| \\ "), ("assistant", "b")
    a = "a\\<|im_end|>\n\\|"
    assert got == {
        (None, 1): ([("", "")], "", 1), ("t", 4): ([root, b, ("us\ner", "")], "b", 1), ("t", 5): ([root, b, ("user", "zz")], "b", 2),
        ("t", 2): ([root, ("assistant", a)], a, 3), ("t", 20): ([("assistant", "x")], "x", 4)}


def test_long_and_tied_conversations(spark):
    rows = [(1, 7, "user", f"m{k}") for k in range(70)] + [(2, None, None, None)]
    made = chat.format_trees(chat.conversation_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.tree: [t.text for t in r.turns] for r in made.select("tree", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: sorted(f"m{k}" for k in range(70)), 2: [""]}
