"""Repair of damaged conversations by Knuth's lightest derivations.

A conversation is repaired if its roles are an optional system turn and then pairs of user and assistant. A repair is derived from items: an edit of one
row, an insertion, a prefix of the rows in one of four states; a prefix and an edit give the next prefix, two neighbouring spans give a longer one. The weight of
an item is (cost, audit), combined by adding costs and joining audits, which never makes it lighter; so the agenda pops items in order of weight, each one's first
weight is its final one, and the work ends with the goal.

Rows are dealt out in order, so a long conversation lies in many tasks. Each task derives the part it has, for every state in which it may begin and end, and the parts
are combined by conversation: only audits meet there, one character a row. The chosen part of the audit then goes back to the rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored
from .line_dedup import may_hold

SPACES = " \t\n\x0b\x0c\r"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Prefixes by what they have made: nothing, a system turn, an open pair, closed pairs.
START, SYSTEM, OPEN, CLOSED = range(4)
ACCEPTED = (START, CLOSED)
#: The turn that may be made next without one of the rows.
NEXT = {START: OPEN, SYSTEM: OPEN, OPEN: CLOSED, CLOSED: OPEN}
KEPT = {"s": {START: SYSTEM}, "u": {START: OPEN, SYSTEM: OPEN, CLOSED: OPEN}, "a": {OPEN: CLOSED}}
LEGAL = {"su", "ua", "au"}
DELETE, RENAME, INSERT, LATE = 2, 1, 5, 5
#: Rows whose derivations are made at once; spans of more are joined from these.
SPAN = 256


def edits_of(initial: str, fault: int) -> dict[str, tuple[int, dict[int, int]]]:
    """Letter to (cost, state before to state after) of what may be done to a row."""
    edits = {"D": (DELETE, {q: q for q in NEXT})}
    if fault in (NO_FAULT, TRUNCATED):
        more = LATE if fault == TRUNCATED else 0
        edits["R"] = (RENAME + more, NEXT)
        if initial in KEPT:
            edits["K"] = (more, KEPT[initial])
    return edits


def lightest(rows: list[dict], start: int, goals: Iterable[int]) -> dict[int, tuple[int, str]]:
    """State at the end to (cost, audit) of the lightest derivation from ``start`` over ``rows`` (of ``edits_of``), for the ``goals`` that can be reached.

    Items: ("p", i, state) for the first i rows, ("e", i, letter) for an edit of row i, ("i", state) for an insertion.
    """
    n = len(rows)
    final: dict[tuple, tuple[int, str]] = {}
    agenda = [((0, ""), ("p", 0, start))]
    agenda += [((cost, letter), ("e", i, letter)) for i, edits in enumerate(rows) for letter, (cost, _) in edits.items()]
    agenda += [((INSERT, "I"), ("i", q)) for q in NEXT]
    heapq.heapify(agenda)
    left = {("p", n, q) for q in goals}
    while agenda and left:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        left.discard(item)
        made = []  # (prefix, other premise, conclusion)
        if item[0] == "p":
            _, i, q = item
            if i < n:
                made = [(item, ("e", i, letter), ("p", i + 1, to[q])) for letter, (_, to) in rows[i].items() if q in to]
            made.append((item, ("i", q), ("p", i, NEXT[q])))
        elif item[0] == "e":
            _, i, letter = item
            made = [(("p", i, q), item, ("p", i + 1, to)) for q, to in rows[i][letter][1].items()]
        else:
            made = [(("p", i, item[1]), item, ("p", i, NEXT[item[1]])) for i in range(n + 1)]
        for prefix, other, head in made:
            if head not in final and prefix in final and other in final:
                (a, x), (b, y) = final[prefix], final[other]
                heapq.heappush(agenda, ((a + b, x + y), head))
    return {q: final["p", n, q] for q in goals if ("p", n, q) in final}


Spans = dict[int, dict[int, tuple[int, str]]]


def joined(a: Spans, b: Spans) -> Spans:
    """Of two neighbouring spans: state before to state after to the lightest weight."""
    out: Spans = {}
    for q, ends in a.items():
        best: dict[int, tuple[int, str]] = {}
        for middle, (cost, audit) in ends.items():
            for to, (more, rest) in b.get(middle, {}).items():
                if to not in best or cost + more <= best[to][0]:
                    best[to] = min(best.get(to, (cost + more + 1, "")), (cost + more, audit + rest))
        out[q] = best
    return out


def spans_of(rows: list[dict], starts: Iterable[int], goals: Iterable[int] = tuple(NEXT)) -> Spans:
    """The lightest derivations over all ``rows``; halves are joined, so audits are copied a few times only."""
    if len(rows) <= SPAN:
        return {q: lightest(rows, q, goals) for q in starts}
    half = len(rows) // 2 // SPAN * SPAN or SPAN
    return joined(spans_of(rows[:half], starts), spans_of(rows[half:], NEXT, goals))


def ordered_turns(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) in order, kept in the shared folder: with ``part`` and ``at``, the first letter of the role, and the row's first fault.

    Rows are dealt by ranges of (conv, turn, role, beginning of the text), which the full order agrees with: only equal rows must be together.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    known = rows.select(
        "*", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2"), F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), NO_FAULT).otherwise(TRUNCATED).alias("fault"),
        F.struct(F.col("turn").isNotNull().alias("numbered"), "turn").alias("when")).withColumn("cell", F.xxhash64("conv", "h1", "h2"))
    said = stored(known.groupBy("conv", "h1", "h2", "cell").agg(F.min("when").alias("first"), F.max("when").alias("last")).where("first <> last"), "said-again")
    marked = may_hold(known, "cell", said, "cell")
    on = (F.col("k.cell") == F.col("s.cell")) & F.col("k.conv").eqNullSafe(F.col("s.conv")) & (F.col("k.h1") == F.col("s.h1")) & (F.col("k.h2") == F.col("s.h2"))
    met = marked.where("maybe").alias("k").join(said.alias("s"), on, "left").select("k.*", F.coalesce(F.col("k.when") > F.col("s.first"), F.lit(False)).alias("later"))
    names = ["conv", "turn", "role", "text", "h1", "h2", "fault", "later"]
    every = met.select(*names).unionByName(marked.where("not maybe").withColumn("later", F.lit(False)).select(*names))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = ["conv", "turn", "role", "text"]
    dealt = every.repartitionByRange(n, "conv", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions(*sort)
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), *rows.select(*sort).schema, T.StructField("initial", T.StringType()), T.StructField("fault", T.IntegerType())])

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = len(batch)
            faults, later = batch.column("fault").to_pylist(), batch.column("later").to_pylist()
            keys = zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "h1", "h2")), strict=True)
            for k, key in enumerate(keys):
                if faults[k] != BLANK and (later[k] or key == before):
                    faults[k] = DUPLICATE
                before = key
            initials = [role[:1] for role in batch.column("role").to_pylist()]
            columns = [pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), *(batch.column(c) for c in sort), pa.array(initials), pa.array(faults, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)
            at += n

    return stored(dealt.mapInArrow(number, schema), "ordered-turns")


def segments(ordered: DataFrame) -> DataFrame:
    """One row for what each part has of a conversation: counts, ends, whether other parts may have more of it, and its lightest derivations as (before, after, cost, audit)."""
    conv, turn = ordered.schema["conv"].dataType, T.LongType()
    span = T.StructType([T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    counts = ["blank", "duplicate", "truncated", "illegal", "turns"]
    schema = T.StructType([
        T.StructField("conv", conv), T.StructField("part", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in counts), *(T.StructField(c, turn) for c in ("low", "high")),
        *(T.StructField(c, T.StringType()) for c in ("head", "tail")), T.StructField("shared", T.BooleanType()), T.StructField("spans", T.ArrayType(span))])
    arrow = to_arrow_schema(schema)
    light = ordered.select("part", "at", "conv", F.col("turn").cast("bigint").alias("turn"), "initial", "fault")
    n = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def summary(name, part: int, rows: list[tuple], first: bool, last: bool) -> dict:
        initials = [x[3] for x in rows]
        turns = [x[2] for x in rows if x[2] is not None]
        edits = [edits_of(x[3], x[4]) for x in rows]
        # The first conversation of a part may have begun before it, and the last one may go on.
        spans = spans_of(edits, NEXT if first else (START,), NEXT if last else ACCEPTED)
        faults = [x[4] for x in rows]
        return {
            "conv": name, "part": part, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
            "head": initials[0], "tail": initials[-1], "shared": first or last, "spans": [{"before": q, "after": to, "cost": cost, "audit": audit} for q, ends in spans.items() for to, (cost, audit) in ends.items()]}

    def derive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("part", "conv", "turn", "initial", "fault")), strict=True)

        found: list[dict] = []
        for part, of_part in groupby(rows(), key=lambda x: x[0]):
            waiting = None
            for k, (name, own) in enumerate(groupby(of_part, key=lambda x: x[1])):
                if waiting:
                    found.append(summary(*waiting, False))
                waiting = (name, part, list(own), k == 0)
                if len(found) >= 256:
                    yield pa.RecordBatch.from_pylist(found, arrow)
                    found = []
            found.append(summary(*waiting, True))
        if found:
            yield pa.RecordBatch.from_pylist(found, arrow)

    return stored(light.repartition(n, "part").sortWithinPartitions("part", "at").mapInArrow(derive, schema), "turn-segments")


def chosen(parts: DataFrame) -> DataFrame:
    """For each conversation a row with ``part`` null: counts, cost, audit; and a row for each part: the state before it and its part of the audit.

    Nearly all conversations lie in one part and are done; only the first and the last one of a part meet others.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([
        T.StructField("conv", parts.schema["conv"].dataType), T.StructField("part", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("audit", T.StringType()),
        *(T.StructField(c, T.LongType()) for c in names)])
    arrow = to_arrow_schema(schema)

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["part"])
        total = dict.fromkeys(names, 0)
        low, high, turns, tail, reached = None, None, 0, None, {START: (0, "", ())}
        for row in rows:
            for c in ("blank", "duplicate", "truncated", "illegal"):
                total[c] += row[c]
            total["illegal"] += tail is not None and tail + row["head"] not in LEGAL
            if row["low"] is not None:
                turns += row["turns"] - (high is not None and high == row["low"])
                low, high = row["low"] if low is None else low, row["high"]
            tail = row["tail"]
            after: dict[int, tuple] = {}
            for s in row["spans"]:
                if s["before"] in reached:
                    cost, audit, path = reached[s["before"]]
                    weight = (cost + s["cost"], audit + s["audit"])
                    if s["after"] not in after or weight < after[s["after"]][:2]:
                        after[s["after"]] = (*weight, (path, s["before"], s["audit"]))
            reached = after
        cost, audit, path = min((reached[q] for q in ACCEPTED if q in reached), key=lambda x: x[:2])
        total["cost"], total["gaps"] = cost, high - low + 1 - turns if low is not None else 0
        made = [{"conv": rows[0]["conv"], "part": None, "before": None, "audit": audit, **total}]
        for row in reversed(rows):
            path, before, own = path
            made.append({"conv": row["conv"], "part": row["part"], "before": before, "audit": own, **dict.fromkeys(names)})
        return pa.Table.from_pylist(made, arrow)

    goal = F.array_min(F.transform(F.filter("spans", lambda s: s["after"].isin(*ACCEPTED)), lambda s: F.struct(s["cost"], s["audit"])))
    alone = parts.where("not shared").withColumn("goal", goal).withColumn("gaps", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))).select("*", "goal.*")
    counts = [F.col(c) for c in names]
    totals = alone.select("conv", F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("before"), "audit", *counts)
    own = alone.select("conv", "part", F.lit(START).alias("before"), "audit", *(F.lit(None).cast("bigint").alias(c) for c in names))
    return stored(totals.unionByName(own).unionByName(parts.where("shared").groupBy("conv").applyInArrow(combine, schema)), "turn-edits")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns) of ``turns``.

    Audits, one row a conversation: ``conv``, gaps, blank, duplicate, truncated, illegal, cost, audit (a letter an edit: K keep, R other role, D delete, I insert).
    Repaired turns: ``conv``, position (ascending, with gaps), edit, ``role``, ``text``; what is deleted has no row.

    Rows stand in order of turn (null first), then role and text. Null roles and texts are one space; a null conversation is one. Turns are whole numbers. A row's first
    fault counts: blank, then repeated (same role and text before), then truncated (its last character but spaces is none of ``.!?``). Of equally cheap audits the least in ASCII is
    taken. Repeated rows are duplicates. A role may be empty or unknown: it cannot be kept. Other columns are not read; an empty table gives two empty tables.
    """
    space = F.lit(" ")
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))
    ordered = ordered_turns(rows)
    edits = chosen(segments(ordered))
    audits = edits.where("part is null").select(F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    # Each part's edits come before its rows, and are carried out in one pass.
    none, number = F.lit(None).cast("string"), int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = edits.where("part is not null").select("part", "conv", F.lit(-1).cast("bigint").alias("at"), "before", "audit", none.alias("role"), none.alias("text"), none.alias("initial"))
    rest = ordered.select("part", "conv", "at", F.lit(None).cast("int").alias("before"), none.alias("audit"), "role", "text", "initial")
    both = first.unionByName(rest).repartition(number, "part", "conv").sortWithinPartitions("part", "conv", "at")
    schema = T.StructType([T.StructField("conv", ordered.schema["conv"].dataType), *(T.StructField(c, k) for c, k in (("position", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())))])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, letters, spot, name = START, iter(""), 0, None
        for batch in batches:
            source, out = [], []
            columns = [batch.column(c).to_pylist() for c in ("part", "before", "audit", "role", "text", "initial")]
            for k, (part, before, audit, own, body, initial) in enumerate(zip(*columns, strict=True)):
                if audit is not None:
                    state, letters, spot, name = before, iter(audit), part << 32, 0
                    rows_left = len(audit) - audit.count("I")
                else:
                    name += 1
                # Insertions before the next row; after a part's last row, all that are left.
                while not (audit is not None and rows_left):
                    letter = next(letters, None)
                    if letter is None:
                        break
                    if letter != "D":
                        to = KEPT[initial][state] if letter == "K" else NEXT[state]
                        given = own if letter == "K" else "assistant" if to == CLOSED else "user"
                        source.append(k)
                        out.append((spot, letter, given, "" if letter == "I" else body))
                        spot, state = spot + 1, to
                    if letter != "I" and name < rows_left:
                        break
            spots, done, roles, texts = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv").take(pa.array(source, pa.int64())), pa.array(spots, pa.int64()), pa.array(done, pa.string()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], schema.names)

    made = both.mapInArrow(apply, schema)
    return audits, made.select(F.col("conv").alias(conv), "position", "edit", F.col("role").alias(role), F.col("text").alias(text))


def digests(repaired: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, sha256 of its ``role:text`` lines in order), read as a stream: no conversation is held."""
    schema = T.StructType([T.StructField("conv", repaired.schema[conv].dataType), T.StructField("sha256", T.StringType())])
    lines = repaired.select(F.col(conv).alias("conv"), "position", F.concat(F.col(role), F.lit(":"), F.col(text)).alias("line"))

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k, line in enumerate(batch.column("line").to_pylist()):
                    yield batch.column("conv").slice(k, 1), line

        def told(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x[0] for x in found]), pa.array([x[1] for x in found])], ["conv", "sha256"])

        name, state, found = None, None, []
        for key, line in rows():
            if state is None or key != name:
                if state is not None:
                    found.append((name, state.hexdigest()))
                    if len(found) == 1024:
                        yield told(found)
                        found = []
                name, state = key, hashlib.sha256(line.encode())
            else:
                state.update(b"\n" + line.encode())
        if state is not None:
            yield told([*found, (name, state.hexdigest())])

    n = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(n, "conv").sortWithinPartitions("conv", "position").mapInArrow(digest, schema)
