"""Secret scan: the index loses nothing that a plain scan of every text finds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import secret_scan, trigram_query
from fieldweave.llm.secret_scan import BASE_RULES, MORE_RULES, Rule

BITS = [
    "password", "PassWD = ", "secret:", 'token = "', "api_key='", "API-KEY", "apikey:=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ghp_", "a" * 12, "B7" * 10, " ", "\n", "é", "中文",
    "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "eyJ" + "a" * 12 + ".", "xoxb-1234567890-a", "AIza" + "x" * 35, "sk_live_" + "y" * 24, '"', "'", "=", ":", "tokens", "deadbeef"]


def plain(text, rules):
    found = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), k, m.end()))
    return [(rules[k].kind, a, b) for a, k, b in sorted(found)]


def contract(text):
    """The base kinds as they are stated, with every match looked at before short ones are dropped."""
    rules = [(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16)]
    found = []
    for k, (pattern, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text or "", re.ASCII | (re.IGNORECASE if k == 0 else 0)):
            if len(m.group(group)) >= least:
                found.append((m.start(), k, m.end()))
    return [(BASE_RULES[k].kind, a, b) for a, k, b in sorted(found)]


def made_texts(n, seed):
    rng = random.Random(seed)
    return [None, "", "a", "to", "password=" + "x" * 11, "password=" + "x" * 12, "PASSWORD\"  :  '" + "x=" * 9, "AKIA" + "Z" * 13, "AKIA" + "Z" * 14, "f" * 15, "f" * 16, "secret:token: abcdefghijklmn",
            "x" * 70000 + " token = 0123456789abcdef0 " + "ſecret=" + "q" * 20, "to\x00ken", "pass\nword=abcdefghijkl"] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_spans_are_those_of_a_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "BLOCK_ROWS", 16)
    texts = made_texts(300, 1)
    rows = [(i, t, "s", "k") for i, t in enumerate(texts)] + [(8, texts[8], "s", "k")] * 2 + [(None, texts[5], None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, mask string").repartition(3)
    made = secret_scan.find_secrets(docs)
    assert made.columns == ["doc_id", "text", "mask", "spans"]
    got = sorted(((r.doc_id, r.text, r.mask, [(s["kind"], s["start"], s["end"]) for s in r.spans]) for r in made.collect()), key=str)
    assert got == sorted(((i, t, m, plain(t, BASE_RULES + MORE_RULES)) for i, t, _, m in rows), key=str)
    kinds = {rule.kind for rule in BASE_RULES}
    for _, text, _, spans in got:
        assert [s for s in spans if s[0] in kinds] == contract(text)
    told = made.where("doc_id = 5").select(secret_scan.written(F.col("spans")).alias("w")).first().w
    assert told == "assign:0:21"


def test_candidates_hold_every_match(spark):
    """Rules of many forms: the query of a pattern never leaves out a text that the pattern matches."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", "abc", "cab", "A", "x", "1", "-", "é", "bca", "aaa", "def", "ghi", "jkl", "mno", "pqr", "stu"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    patterns = ["abc", "(abc|cab)a?", "a{3,}", "(ab)+c", "x*abca", "[aA]bc-?1", "(?:abc|x)[0-9]", "éa", "(?i:abc)", "(abc)?", "a.c", "^cab", "(?=abc)a", "[^a]bca", "ab{1,2}c", "(aaa|abc|bca)x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    index = secret_scan.build_index(docs, "key")
    masks = {r.key: r["mask"] for r in secret_scan.candidates(index, patterns).collect()}
    pruned = 0
    for k, pattern in enumerate(patterns):
        full = trigram_query.trigram_query(pattern) is True
        for key, text in enumerate(texts):
            if re.search(pattern, text) and not full:
                assert masks.get(key, 0) >> k & 1, (pattern, text)
        pruned += not full and sum(masks.get(key, 0) >> k & 1 for key in range(len(texts))) < len(texts) / 2
    assert pruned >= 8


def test_queries_of_the_rules():
    need = lambda p: trigram_query.trigram_query(p)
    of = lambda s: {trigram_query.trigram(s[i:i + 3]) for i in range(len(s) - 2)}
    assert need("AKIA[A-Z0-9]{14,}") == ("and", frozenset(of(b"akia")))
    assert need("[0-9a-f]{16,}") is True and need("a|abcd") is True and need(".*") is True
    assert trigram_query.trigrams_of(need(BASE_RULES[0].pattern)) >= of(b"password") | of(b"passwd") | of(b"secret") | of(b"token") | of(b"api_key") | of(b"apikey")
    assert need("abc?d") == ("or", frozenset([("and", frozenset(of(b"abcd"))), trigram_query.trigram(b"abd")]))


def test_empty_table_and_too_many_rules(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.find_secrets(empty).count() == 0
    with pytest.raises(ValueError):
        secret_scan.find_secrets(empty, tuple(Rule(str(k), "abc") for k in range(63)))
