"""Conversation repair against every repair there is."""

import hashlib
import random
import sys
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import conversation_repair as cr

sys.setrecursionlimit(20_000)  # of the brute force
SPACE = " \t\n\x0b\x0c\r"


def facts(rows):
    """(initial, fault) of each row, in order of turn (null first), role and text; counts."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append((role[:1], 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0))
        seen.add((role, text))
    return rows, out


def brute(rows):
    """The least (cost, audit, lines) over all edit sequences with at most three insertions at one place."""
    rows, of = facts(rows)

    @lru_cache(None)
    def best(i, state, inserted):
        """Least (cost, audit, lines) from row i on; ``state``: 0 nothing made, 1 system turn, 2 open pair, 3 closed pairs."""
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        given = "assistant" if state == 2 else "user"
        to = 3 if state == 2 else 2
        if inserted < 3 and (rest := best(i, to, inserted + 1)):
            found.append((rest[0] + 5, "I" + rest[1], (f"{given}:",) + rest[2]))
        if i < len(rows):
            (initial, fault), (_, role, text) = of[i], rows[i]
            moves = [("D", 2, state, None)]
            if fault in (0, 3):
                late = 5 if fault == 3 else 0
                moves.append(("R", 1 + late, to, f"{given}:{text}"))
                if initial == "s" and state == 0:
                    moves.append(("K", late, 1, f"{role}:{text}"))
                if initial == "u" and state != 2 or initial == "a" and state == 2:
                    moves.append(("K", late, to, f"{role}:{text}"))
            for letter, cost, after, line in moves:
                if rest := best(i + 1, after, 0):
                    found.append((rest[0] + cost, letter + rest[1], ((line,) if line is not None else ()) + rest[2]))
        return min(found, default=None)

    cost, audit, lines = best(0, 0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [x[0] for x in of]
    faults = [x[1] for x in of]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit,
        "sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def made_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ünit"]), rng.choice(["a.", "b!", "c", "", " \n", None, "d?  ", "é.", "中"]), "x"))
    return rows


@pytest.mark.parametrize("span", [2, 256])
def test_repairs_are_lightest(spark, monkeypatch, span):
    monkeypatch.setattr(cr, "SPAN", span)
    rows = made_rows(1, 60)
    # One conversation that lies in several parts.
    rows += [(999, k // 2, ("user", "assistant", "tool")[k % 3 if k % 7 == 0 else k % 2], f"{k % 50}{'.' if k % 5 else ''}", "y") for k in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string")
    audits, repaired = cr.repair(turns)
    lines = {r.conv: r.sha256 for r in cr.digests(repaired).collect()}
    got = {r.conv_id: {**{k: r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}, "sha256": lines.get(r.conv_id, hashlib.sha256(b"").hexdigest())} for r in audits.collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = brute([r[1:4] for r in rows if r[0] == conv])
    assert got == want
    kept = repaired.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "role"))).alias("r")).collect()
    for r in kept:
        initials = "".join(x["role"][0] for x in r.r)
        body = initials.removeprefix("s")
        assert len(body) % 2 == 0 and body == "ua" * (len(body) // 2), initials


def test_agenda_equals_joined_halves():
    rng = random.Random(5)
    rows = [cr.edits_of(rng.choice("suat"), rng.randint(0, 3)) for _ in range(60)]
    whole = {q: cr.lightest(rows, q, range(4)) for q in range(4)}
    for cut in (1, 20, 59):
        halves = cr.joined({q: cr.lightest(rows[:cut], q, range(4)) for q in range(4)}, {q: cr.lightest(rows[cut:], q, range(4)) for q in range(4)})
        assert halves == whole


def test_empty_table(spark):
    audits, repaired = cr.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert audits.count() == repaired.count() == cr.digests(repaired).count() == 0
