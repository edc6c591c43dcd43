"""Ranked search against scores in plain whole numbers."""

import math
import random
import re
from collections import Counter

import numpy as np

from fieldweave.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = ["Alpha", "beta", "gamma", "delta", "é", "ÉÀ", "x1", "中文", "the", "The", "of"]


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, top):
    texts = [(i, plain_terms(t)) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n_docs, n_terms = len(texts), sum(len(t) for _, t in texts)
    df = Counter(w for _, t in texts for w in set(t))
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, words in wanted.items():
        scores = []
        for doc, t in texts:
            tf, m = Counter(t), 50 + (50 * len(t) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 20 * m)) for w in words if w in tf)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        for rank, (s, _, _, doc) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, doc, -s))
    return out


def made(n, seed):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30)))) for i in range(n)]
    docs += [(n + i, docs[0][1]) for i in range(40)] + [(-5, "Alpha-beta_gamma"), (-5, "Alpha-beta_gamma"), (None, "alpha " * 3), (7, None), (8, ""), (9, " .,- "), (10, "beta " * 5000)]
    items = [(1, "alpha, BETA"), (2, "É é the of"), (2, "x1 x1"), (3, None), (4, "nowhere"), (5, "..."), (None, "gamma delta"), (6, " ".join(WORDS))]
    return docs, items


def run(spark, docs, items, top):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    found = ranked_search.search(d, q, top=top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_ranks_are_exact(spark):
    docs, items = made(200, 1)
    for top in (3, 50):
        assert run(spark, docs, items, top) == sorted(plain(docs, items, top), key=str)


def test_small_tiles_and_blocks(spark, monkeypatch):
    """One pair of words a tile, a few documents a tile, a few pairs a block of items: the same ranks."""
    docs, items = made(120, 2)
    monkeypatch.setattr(ranked_search, "TILE_WORDS", 2)
    monkeypatch.setattr(ranked_search, "TILE_DOCS", 16)
    monkeypatch.setattr(ranked_search, "BLOCK_PAIRS", 6)
    assert run(spark, docs, items, 5) == sorted(plain(docs, items, 5), key=str)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")], 5) == run(spark, [(1, "a")], [], 5) == run(spark, [(1, None)], [(1, None)], 5) == []


def test_tile_best_keeps_ties():
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 4, (20, 90))
    row, column = ranked_search.best(scores, 7)
    keep = ranked_search.cut(row, scores[row, column], column, np.zeros(len(row), bool), 7)
    got = sorted(zip(row[keep].tolist(), column[keep].tolist(), strict=True))
    want = sorted((i, j) for i in range(20) for j in sorted(np.flatnonzero(scores[i]), key=lambda j: (-scores[i, j], j))[:7])
    assert got == want
