"""Joins and searches against brute force, on small fixtures with groups of copies, nulls, repeats and clashing columns."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import components, decontaminate, jaccard_join, line_dedup, repeat_spans, vector_graph
from fieldweave.llm.suffix_order import suffix_order

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_order(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


# --- repeated spans

def brute_spans(rows, length):
    count = collections.Counter(b[a:a + length] for _, t in rows for b in [(t or "").encode()] for a in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        hit = np.zeros(len(b) + 2, bool)
        for a in range(len(b) - length + 1):
            if count[b[a:a + length]] > 1:
                hit[a + 1:a + 1 + length] = True
        edges = np.flatnonzero(np.diff(hit.astype(int)))
        out.append((i, bytes(x for x, y in zip(b, hit[1:], strict=False) if not y), edges.reshape(-1, 2).tolist()))
    return sorted(out, key=str)


def span_rows():
    rng = random.Random(7)
    doc = lambda n: " ".join("".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 6))) for _ in range(n))
    passages, rows = [doc(k) for k in (8, 15, 30, 60)], []
    for i in range(70):
        t = doc(rng.randint(0, 50))
        for _ in range(rng.randint(0, 2)):
            t += rng.choice(passages)[rng.randint(0, 8):] + doc(rng.randint(0, 8))
        if i % 7 == 0:
            t += "ab " * rng.randint(5, 60) + doc(3)
        if i % 9 == 0:
            t += "a" * rng.randint(5, 160)
        rows.append((i, t))
    rows += [(100 + i, rows[rng.randrange(70)][1]) for i in range(20)]
    for i in range(15):
        t = list(rows[3][1] + passages[3])
        t[rng.randrange(len(t))] = "Z"
        rows.append((150 + i, "".join(t)))
    return rows + [(200, None), (201, ""), (None, rows[5][1]), (3, rows[3][1])]


@pytest.mark.parametrize(("length", "group"), [(40, 2048), (40, 1)])
def test_repeated_spans(spark, monkeypatch, length, group):
    monkeypatch.setattr(repeat_spans, "GROUP", group)
    rows = span_rows()
    docs = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, k1 string")
    cut = repeat_spans.remove_repeats(docs, length)
    assert cut.columns == ["doc_id", "text", "k1", "kept", "spans"]
    assert sorted([(r.doc_id, bytes(r.kept), r.spans) for r in cut.collect()], key=str) == brute_spans(rows, length)


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeat_spans, "PLACE_BITS", 9)
    rows = span_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([(r.doc_id, bytes(r.kept), r.spans) for r in repeat_spans.remove_repeats(docs, 40).collect()], key=str) == brute_spans(rows, 40)


# --- shingle join

def shingles(text, words):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[a:a + words]) for a in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_groups(rows, words, percent):
    sets = collections.defaultdict(list)
    for i, t in rows:
        sets[i].append(shingles(t, words))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and root(x) != root(y) and any((a | b) and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i)) for i in ids for s in sets[i])


def near_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    doc = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def edited(words, edits):
        words = list(words)
        for _ in range(edits):
            at, kind = rng.randrange(len(words)), rng.random()
            if kind < 0.5:
                words[at] = rng.choice(vocabulary) + "x" + str(rng.randrange(5))
            elif kind < 0.75:
                words.insert(at, rng.choice(vocabulary))
            elif len(words) > 1:
                words.pop(at)
        return words

    texts = []
    for n, copies, edits in ((150, 60, 5), (60, 50, 4), (30, 30, 3), (12, 25, 2), (5, 15, 1), (300, 20, 12)):
        first = doc(n)
        texts += [" ".join(edited(first, rng.randint(0, edits))) for _ in range(copies)]
    texts += [" ".join(doc(rng.randint(0, 80))) for _ in range(80)]
    texts += [texts[rng.randrange(180)].upper() for _ in range(20)] + [None, "", "A b", "a  B"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_near_copies(spark, words, percent):
    rows = near_rows()
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, hub string")
    got = sorted(tuple(r) for r in jaccard_join.near_copies(docs, words, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_groups(rows, words, percent)


def test_near_copies_edges(spark):
    docs = spark.createDataFrame([(1, "a b", ""), (1, "a b", ""), (None, "a b", ""), (2, "a b", ""), (5, None, "")], "doc_id long, text string, x string")
    assert jaccard_join.near_copies(docs.limit(0)).count() == 0
    assert sorted([r.doc_id or 0 for r in jaccard_join.one_of_each(docs).collect()]) == [0, 1, 5]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 70), (70, 90), (90, 100), (5, 5), (200, 1)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in [*range(1, 41), 200]} | {k: 70 for k in (70, 90, 100)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# --- lines

def close(a, b, edits):
    if abs(len(a) - len(b)) > edits:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= edits


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_automaton(spark, edits):
    rng = random.Random(edits)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 12)))
    pairs = [(word(), word()) for _ in range(600)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("chars_a", F.split("a", "")).withColumn("chars_b", F.split("b", ""))
    got = df.select("a", "b", line_dedup.within(F.col("chars_a"), F.col("chars_b"), edits).alias("near"), F.levenshtein("a", "b").alias("d")).collect()
    assert all(r.near == (r.d <= edits) for r in got)


def test_line_dedup(spark):
    rng = random.Random(3)
    line = lambda n: "".join(rng.choice("abc é") for _ in range(n))

    def edited(s, edits):
        s = list(s)
        for _ in range(edits):
            at, kind = rng.randrange(len(s)), rng.random()
            if kind < 0.4:
                s[at] = rng.choice("abcdé")
            elif kind < 0.7:
                s.insert(at, rng.choice("abz"))
            elif len(s) > 1:
                s.pop(at)
        return "".join(s)

    base = [line(rng.randint(5, 40)) for _ in range(50)]
    rows = [(i, "\n".join(edited(rng.choice(base), rng.randint(0, 4)) if rng.random() < 0.8 else line(rng.randint(0, 30)) for _ in range(rng.randint(0, 6))), "x") for i in range(100)]
    rows += [(200, None, "y"), (201, "", "z"), (None, rows[3][1], "n"), (5, rows[5][1], "q"), (5, rows[7][1], "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cell string")
    place = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    edits, least, first = 2, 9, {}
    key = lambda i, t, at: (i is not None, i or 0, place[i, t], at)
    for i, t, _ in rows:
        for at, x in enumerate(t.split("\n") if t is not None else []):
            if len(x) >= least:
                first[x] = min(first.get(x, (True, 10 ** 9)), key(i, t, at))
    order = sorted(first, key=first.get)
    near = {x for n, x in enumerate(order) if any(close(y, x, edits) for y in order[:n])}
    want = []
    for i, t, c in rows:
        if t is None:
            want.append((i, None, c, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for at, x in enumerate(lines) if len(x) < least or (first[x] == key(i, t, at) and x not in near)]
        want.append((i, "\n".join(kept), c, len(lines), len(lines) - len(kept)))
    made = line_dedup.dedup_lines(docs, edits, least)
    assert made.columns == ["doc_id", "text", "cell", "n_lines", "n_removed"]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
    assert near and line_dedup.dedup_lines(docs.limit(0), edits, least).count() == 0


# --- benchmark items

def brute_hits(text, items, window):
    words = decontaminate.words_of((text or "").encode())
    hit, found = set(), set()
    for i, x in items:
        own = decontaminate.words_of((x or "").encode())
        need = min(window, len(own))
        windows = {tuple(own[k:k + need]) for k in range(len(own) - need + 1)} if need else set()
        for k in range(len(words) - need + 1):
            if tuple(words[k:k + need]) in windows:
                hit |= set(range(k, k + need))
                found.add("" if i is None else str(i))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [100_000, 30])
def test_overlaps(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(["a", "B", "c", "dé", "e1", "f"]) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 4, 6, 9]))) for i in range(1, 30)] + [(77, None), (78, "  "), (None, text(5)), (3, text(8))]
    rows = [(i, text(rng.randint(0, 60)), "x") for i in range(120)] + [(500, None, "q"), (501, "", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.h, r.item_ids) for r in decontaminate.overlaps(docs, bench, 5).withColumn("h", decontaminate.hit_words()).collect()}
    assert got == {i: brute_hits(t, items, 5) for i, t, _ in rows}


def test_one_word_items_and_removal(spark):
    items = spark.createDataFrame([(1, "Zebra"), (2, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "é a ZEBRA, b", 7), (2, "x one two three four five y z q r s t u", 8), (3, "clean", 9), (4, None, 1), (5, "zebra zebra a", 2)], "doc_id long, text string, n_words long")
    made = {r.doc_id: (r.text, r.n_words) for r in decontaminate.decontaminate(docs, items, 5).collect()}
    assert made == {1: ("é a , b", 7), 2: ("x  y z q r s t u", 8), 3: ("clean", 9), 4: (None, 1)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none, 5).count() == 5 and decontaminate.decontaminate(docs.limit(0), items, 5).count() == 0


# --- vectors

def test_vector_search(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 24)) * rng.uniform(0.5, 2.0, (900, 1))
    x[:40] = x[0]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = vector_graph.search(vector_graph.build_index(vectors), vectors.where("vec_id % 20 = 0")).toPandas()
    right = 0
    for q, rows in found.groupby("query_id"):
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 21)) and np.allclose(rows.score, score[rows.vec_id])
        right += len(set(order) & set(rows.vec_id))
    assert right >= 0.97 * 20 * found.query_id.nunique() and found.query_id.nunique() == 45


def test_vector_edges(spark):
    rows = [(i, [1.0, float(i % 3), 0.5]) for i in range(60)] + [
        (100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 2.0, 1.0]), (None, [1.0, 1.0, 1.0]), (20, [1.0, 2.0, 0.5])]
    vectors = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, shard string")
    found = vector_graph.search(vector_graph.build_index(vectors), vectors.where("vec_id in (0, 20, 100, 101)")).toPandas().sort_values("rank")
    got = {q: g.vec_id.tolist() for q, g in found.groupby("query_id")}
    assert got == {0: list(range(1, 21)), 20: [i for i in range(60) if i % 3 == 2 and i != 20] + [1]}
    few = vectors.where("vec_id < 5")
    assert sorted(r["count"] for r in vector_graph.search(vector_graph.build_index(few), few).groupBy("query_id").count().collect()) == [4] * 5
    assert vector_graph.search(vector_graph.build_index(vectors.limit(0)), vectors).count() == 0
