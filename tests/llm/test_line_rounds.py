"""Near lines where many share a key: finer keys and rounds lose no line that has an earlier near one."""

import random

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import line_dedup


def distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def crowd(seed, n):
    """Lines of one form, each with a few changes of letters, words or lengths anywhere."""
    rng = random.Random(seed)
    form = "the quick brown fox jumps over the lazy dog near the old mill"
    lines = {form}
    while len(lines) < n:
        t = list(form)
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(t))
            t[at:at + rng.choice([0, 1, 1, 1])] = rng.choice(["x", "y", "", "é"])
        lines.add("".join(t))
    return sorted(lines, key=lambda _: rng.random())


@pytest.mark.parametrize(("edits", "longest_list"), [(1, 1), (2, 1), (2, 16)])
def test_crowded_keys(spark, monkeypatch, edits, longest_list):
    monkeypatch.setattr(line_dedup, "LIST", longest_list)
    lines = crowd(edits, 90)
    rows = [(k // 3, k % 3, line) for k, line in enumerate(lines)]
    table = spark.createDataFrame(rows, "doc long, at int, line string").select(
        F.xxhash64("line").alias("id"), F.col("doc").alias("order"), F.struct(F.col("doc").alias("id"), F.lit(0).cast("bigint").alias("h")).alias("who"), F.xxhash64("doc").alias("cell"), "at", "line", F.length("line").alias("size"))
    got = {(r.who["id"], r["at"]) for r in line_dedup.near_lines(table, edits).collect()}
    want = {(rows[j][0], rows[j][1]) for j in range(len(lines)) if any(distance(lines[i], lines[j], edits) <= edits for i in range(j))}
    assert got == want and 10 < len(want) < len(lines)


def test_open_meetings_are_marked_once(spark, monkeypatch):
    """What the second round reads four times is read from files: no marking join runs anew in each of its branches."""
    plans, pairs = [], line_dedup.other_pairs

    def seen(met, index, edits):
        plans.append(met._jdf.queryExecution().optimizedPlan().toString())
        return pairs(met, index, edits)

    monkeypatch.setattr(line_dedup, "other_pairs", seen)
    docs = spark.createDataFrame(list(enumerate(crowd(3, 40))), "doc_id long, text string")
    line_dedup.dedup_lines(docs).count()
    assert len(plans) == 2 and "Join" not in plans[0]
