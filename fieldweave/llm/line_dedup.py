"""Near-duplicate lines by a segment-partition edit join, with column functions only.

Of ``edits`` + 1 segments of a line, an edit distance of at most ``edits`` leaves one whole. So each line is indexed by its segments, with its
length, and probes the few substrings of itself that could be a segment of a line that is up to ``edits`` characters shorter
(the windows that any alignment of the whole segment allows). Candidates are verified by a banded bit-parallel automaton. A line goes if any earlier one is near, so
lines meet the first line of a key before all others, and keys that many lines share are cut finer by the same argument.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Bits of the filters that are sent to every task, as rows of 64 bits: at most 2 ** 19 for segment keys, 2 ** 16 for others, whatever the input.
KEY_BITS, FILTER_BITS = 25, 22


def cell_of(column: str, size: int) -> tuple[Column, Column]:
    """(word, bit) of a hash in a filter."""
    cell = F.col(column).bitwiseAND((1 << size) - 1)
    return F.shiftright(cell, 6), cell.bitwiseAND(63).cast("int")


def hash_filter(keys: DataFrame, column: str, size: int) -> DataFrame:
    """(filter_word, filter_bits): a bit for each cell that a key falls in."""
    word, bit = cell_of(column, size)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    return keys.groupBy(word.alias("filter_word")).agg(F.bit_or(one).alias("filter_bits"))


def may_hold(rows: DataFrame, column: str, keys: DataFrame, key: str, size: int = FILTER_BITS) -> DataFrame:
    """``rows`` with ``maybe``: false only where no key has the value; some others share its cell. The filter has a fixed bound, so it is broadcast."""
    word, bit = cell_of(column, size)
    met = rows.withColumn("filter_word", word).join(F.broadcast(hash_filter(keys, key, size)), "filter_word", "left")
    found = F.call_function("shiftright", F.col("filter_bits"), bit).bitwiseAND(1) == 1
    return met.withColumn("maybe", F.coalesce(found, F.lit(False))).drop("filter_word", "filter_bits")


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two lines is at most ``edits``.

    State e is a word with one bit for each of the 2 * edits + 1 diagonals next to the main one: the cells of the current column that e edits reach.
    A character of b moves all diagonals at once: match, substitution, insertion, and deletion within the column. Once no cell is left,
    the rest of b is passed over.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    first = F.array(*(F.lit(sum(1 << (edits + i) for i in range(e + 1))) for e in range(edits + 1)))

    def step(state: Column, j: Column) -> Column:
        char = F.get("chars_b", j)
        same = reduce(lambda x, y: x.bitwiseOR(y), (
            F.when(F.get("chars_a", j + (d - edits)) == char, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)))
        rows = [F.get(state, F.lit(0)).bitwiseAND(same)]
        for e in range(1, edits + 1):
            old = F.get(state, F.lit(e - 1))
            rows.append(
                F.get(state, F.lit(e)).bitwiseAND(same).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(rows[-1], 1)).bitwiseAND(F.lit(mask)))
        return F.array(*rows)

    n_a, n_b = F.size("chars_a"), F.size("chars_b")
    living = lambda state, j: F.when(F.get(state, F.lit(edits)) == 0, state).otherwise(step(state, j))
    last = F.aggregate(F.sequence(F.lit(0), n_b - 1), first, living)
    return (F.abs(n_a - n_b) <= edits) & (F.shiftright(F.get(last, F.lit(edits)), 0).bitwiseAND(F.expr(f"shiftleft(1, cast(size(chars_a) - size(chars_b) + {edits} as int))")) != 0)


#: Characters that a line's profile counts, up to 255 each, eight to a number.
PROFILED = "eantiors", "hdlucmgp"


def profile(line: Column) -> Column:
    """How often a line has each of PROFILED, a byte each."""
    def counts(letters: str) -> Column:
        parts = [F.shiftleft(F.least(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))), F.lit(255)).cast("bigint"), 8 * k) for k, c in enumerate(letters)]
        return reduce(lambda x, y: x.bitwiseOR(y), parts)

    return F.struct(*(counts(letters).alias(f"p{n}") for n, letters in enumerate(PROFILED)))


def profiles_near(a: Column, b: Column, edits: int) -> Column:
    """False only for lines more than ``edits`` apart: an edit changes two counts by one at most."""
    part = lambda x, n, k: F.shiftright(x[f"p{n}"], 8 * k).bitwiseAND(255)
    return reduce(lambda x, y: x + y, (F.abs(part(a, n, k) - part(b, n, k)) for n in range(len(PROFILED)) for k in range(8))) <= 2 * edits


def windows(edits: int, longer: int) -> list[tuple[int, int]]:
    """(segment number, shift) at which a text that is ``longer`` (or shorter) than its partner may hold one of the partner's ``edits`` + 1 segments whole: i edits at
    most before segment i, the others after it. Without edits there is nothing to look for: (-1, 0)."""
    if not edits:
        return [(-1, 0)]
    return [(i, shift) for i in range(edits + 1) for shift in range(max(-i, longer - (edits - i)), min(i, longer + (edits - i)) + 1)]


def own_windows(edits: int) -> list[tuple[int, int]]:
    return [(i, 0) for i in range(edits + 1)] if edits else [(-1, 0)]


def segment(size: Column, parts, number) -> tuple[Column, Column]:
    """(start, length) of a segment: whole numbers, the last segments one character longer where need be."""
    base, rest = F.floor(size / parts).cast("int"), size % parts
    return base * number + F.greatest(F.lit(0), rest + (number - parts)), base + (rest + number - parts >= 0).cast("int")


#: A key's kind: segment number, how much shorter the partner is, and the shift at which the segment is looked for; a line's own segments have no shift.
KIND = ["i", "shorter", "shift"]


def segment_rows(lines: DataFrame, edits: int, own: bool) -> DataFrame:
    """(id, order, key, KIND) of ``lines``: the line's own segments, or its other substrings that could be a segment of a line of its length or up to ``edits`` shorter.
    Keys are hashes of (segment number, partner's length, substring)."""
    kinds = [(i, k, shift) for k in range(1 if own else edits + 1) for i, shift in (own_windows(edits) if own else windows(edits, k)) if own or k or shift]
    rows = lines.select("id", "order", "line", "size", F.inline(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(kind, KIND, strict=True))) for kind in kinds))))
    partner = F.col("size") - F.col("shorter")
    start, length = segment(partner, edits + 1, F.col("i"))
    return rows.select("id", "order", F.xxhash64("i", partner, F.substring("line", start + F.col("shift") + 1, length)).alias("key"), *KIND)


def finer_rows(rows: DataFrame, lines: DataFrame, edits: int, own: bool) -> DataFrame:
    """(id, order, key, profile) of ``rows`` (id, order, key, KIND) whose keys hold too many lines: what is left of the line on both sides of the segment is cut again. Segment i leaves
    i edits on its left and the others on its right, so each side is looked at with fewer edits; the finer key adds one segment of either side."""
    kinds = []
    for i, shorter, shift in {(i, k, s) for k in range(edits + 1) for i, s in windows(edits, k)}:
        if not own or not (shorter or shift):
            left = own_windows(i) if own else windows(i, shift)
            right = own_windows(edits - i) if own else windows(edits - i, shorter - shift)
            kinds += [(i, shorter, shift, jl, sl, jr, sr) for jl, sl in left for jr, sr in right]
    names = [*KIND, "left", "left_shift", "right", "right_shift"]
    table = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(kind, names, strict=True))) for kind in sorted(kinds)))
    mine = F.filter(table, lambda t: (t["i"] == F.col("i")) & (t["shorter"] == F.col("shorter")) & (t["shift"] == F.col("shift")))
    texts = may_hold(lines.select("id", "line", "size"), "id", rows, "id").where("maybe").select("id", "line", "size", profile(F.col("line")).alias("profile"))
    each = rows.join(texts, "id").select("id", "order", "key", "line", "size", "profile", F.explode(mine).alias("t")).select("id", "order", "key", "line", "size", "profile", "t.*")
    partner = F.col("size") - F.col("shorter")
    start, length = segment(partner, edits + 1, F.col("i"))
    left_start, left_length = segment(start, F.greatest(F.col("i") + 1, F.lit(1)), F.col("left"))
    after = start + length
    right_start, right_length = segment(partner - after, F.greatest(edits + 1 - F.col("i"), F.lit(1)), F.col("right"))
    piece = lambda number, at, long: F.when(number >= 0, F.substring("line", at + 1, long)).otherwise("")
    return each.select("id", "order", "profile", F.xxhash64(
        "key", "left", piece(F.col("left"), left_start + F.col("left_shift"), left_length), "right", piece(F.col("right"), after + F.col("shift") + right_start + F.col("right_shift"), right_length)).alias("key"))


#: Lines of one key that are compared without finer keys.
LIST = 16


def later_lines(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """(id, who, cell, at) of the later line of each of the ``pairs`` (a, b) within ``edits`` edits."""
    pairs = stored(pairs.distinct(), "line-pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    texts = may_hold(lines, "id", named, "name").where("maybe")
    texts = stored(texts.select("id", "line", profile(F.col("line")).alias("profile"), F.struct("who", "at", "cell").alias("place")), "pair-lines")
    side = lambda s: texts.select(F.col("id").alias(s), F.split("line", "").alias(f"chars_{s}"), F.col("profile").alias(f"profile_{s}"), F.col("place").alias(f"place_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(profiles_near(F.col("profile_a"), F.col("profile_b"), edits))
    near = both.where(within(F.col("chars_a"), F.col("chars_b"), edits))
    later = F.when(F.col("place_a") < F.col("place_b"), F.struct(F.col("b").alias("id"), F.col("place_b").alias("p"))).otherwise(F.struct(F.col("a").alias("id"), F.col("place_a").alias("p")))
    return stored(near.select(later.alias("x")).select("x.id", "x.p.who", "x.p.cell", "x.p.at").distinct(), "later-lines")


def first_pairs(met: DataFrame) -> DataFrame:
    """(a, b) of each row with the first line of its key."""
    return met.where(F.col("id") != F.col("head.id")).select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b"))


def still_open(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``rows`` with ``open``: whether the line is not among the ``done`` ones."""
    return rows.join(done.select("id", F.lit(False).alias("open")).distinct(), "id", "left").withColumn("open", F.coalesce("open", F.lit(True)))


def undecided(met: DataFrame) -> DataFrame:
    """Rows of ``met`` (with ``open``) of keys that more than their first line keeps open; the first line has met all others of its key."""
    return met.join(met.where(F.col("open") & (F.col("id") != F.col("head.id"))).select("key").distinct(), "key", "left_semi")


def other_pairs(met: DataFrame, index: DataFrame, edits: int) -> DataFrame:
    """(a, b) of each row with the lines of its key in ``index``, but the first one and itself, where the later line is open and the profiles, if there are some, are not too far off.

    A line looks for shorter ones, so the later line of a pair may be on either side.
    """
    known = "profile" in met.columns
    side = lambda t, s: t.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "order", "open", *(["profile"] if known else []))), *([F.col("head.id").alias("head")] if s == "y" else []))
    col = F.col
    asked = (col("y_open") & (col("x_order") <= col("y_order"))) | (col("x_open") & (col("y_order") <= col("x_order")))
    found = side(index, "x").join(side(met, "y"), "key").where((col("x_id") != col("y_id")) & (col("x_id") != col("head")) & (col("y_id") != col("head")) & asked)
    if known:
        found = found.where(profiles_near(col("x_profile"), col("y_profile"), edits))
    return found.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))


def with_heads(rows: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """``rows`` whose key is in ``index``, with the key's first line and number of lines."""
    heads = stored(index.groupBy("key").agg(F.min(F.struct("order", "id")).alias("head"), F.count(F.lit(1)).alias("n")), name)
    return rows.join(heads, "key")


def near_lines(lines: DataFrame, edits: int) -> DataFrame:
    """(id, who, cell, at) of the ``lines`` (id, order, who, cell, at, line, size; distinct) that have an earlier one within ``edits`` edits. ``order`` agrees with (who, at).

    What is asked is whether there is one, not which ones there are. So each line meets the first line of each of its keys; the ones that are near it are done. The others meet the rest
    of a key that few lines share; where many share it, finer keys take its place, again first lines first.
    """
    own = segment_rows(lines, edits, own=True)
    heads = stored(own.groupBy("key").agg(F.min(F.struct("order", "id")).alias("head"), F.count(F.lit(1)).alias("n")), "line-heads")
    # Most substrings are no line's segment, and most segments no other line's: both are left out before the shuffle.
    probes = may_hold(segment_rows(lines, edits, own=False), "key", heads, "key", KEY_BITS).where("maybe")
    shared = may_hold(own, "key", heads.where("n > 1"), "key").where("maybe")
    columns = ["id", "order", "key", *KIND]
    met = stored(probes.select(*columns).unionByName(shared.select(*columns)).join(heads, "key"), "line-meetings")
    done = later_lines(first_pairs(met), lines, edits)

    # Read four times below, so it is written once; the marks would be joined anew for each.
    several = stored(undecided(still_open(met.where("n > 1"), done)), "open-meetings")
    index = several.where("shorter = 0 and shift = 0")
    few, many = F.col("n") <= LIST, F.col("n") > LIST
    finer_index = stored(finer_rows(index.where(many).select(*columns), lines, edits, own=True), "finer-index")
    finer = stored(with_heads(finer_rows(several.where(many).select(*columns), lines, edits, own=False), finer_index, "finer-heads"), "finer-meetings")
    first = first_pairs(still_open(finer, done).where(F.col("open") | (F.col("order") <= F.col("head.order"))))
    second = later_lines(first.unionByName(other_pairs(several.where(few), index.where(few), edits)), lines, edits)
    both = done.unionByName(second)
    rest = undecided(still_open(finer.where("n > 1"), both))
    third = later_lines(other_pairs(rest, still_open(finer_index, both), edits), lines, edits)
    return both.unionByName(third).distinct()


def dedup_lines(docs: DataFrame, edits: int = 2, least: int = 32, doc_id: str = "doc_id", text: str = "text", least_equal: int | None = None) -> DataFrame:
    """``docs`` with the repeated lines of ``text`` taken out, and ``n_lines`` and ``n_removed``.

    Lines end at line feeds. Of equal lines of at least ``least_equal`` characters (``least`` if not given) the first stays: the order is by document id
    (null first), text hash and line number. A distinct line of at least ``least`` characters also goes, wherever it stands, if such a line with an earlier
    first place is within ``edits`` edits of it. Shorter lines always stay. Null text stays null and has no lines; a text that loses all its lines is empty. Rows with equal ids and texts are
    one document and keep the same lines. Columns named ``n_lines`` or ``n_removed`` are replaced; the others pass through.
    """
    if least <= 2 * edits + 1:
        raise ValueError("lines must be longer than their segments")
    least_equal = least if least_equal is None else least_equal
    if least_equal > least:
        raise ValueError("near lines must be distinct")
    plain = docs.drop("n_lines", "n_removed")
    rows = plain.select(
        F.struct(*(F.col(c) for c in plain.columns if c != text)).alias("doc"), F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h")).alias("who"),
        F.xxhash64(F.col(doc_id), F.xxhash64(text)).alias("cell"), F.split(text, "\n").alias("lines"))
    each = rows.select("who", F.posexplode("lines").alias("at", "line")).where(F.length("line") >= least_equal)
    marks = each.select("who", "at", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(7), "line").alias("l2"))

    # Equal lines: all places but the first.
    again = stored(marks.groupBy("l1", "l2").agg(F.min(F.struct("who", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "equal-lines")
    late = may_hold(marks, "l1", again, "l1").where("maybe").join(again.select("l1", "l2", "first"), ["l1", "l2"])
    late = late.where(F.struct("who", "at") != F.col("first"))
    once = stored(without(rows, late.select("who", F.xxhash64("who.id", "who.h").alias("cell"), "at")), "lines-once")

    # Near lines: every line left of this length is distinct.
    left = once.select("who", "cell", F.posexplode("kept").alias("at", "line")).where("line is not null").withColumn("size", F.length("line")).where(F.col("size") >= least)
    # Whole-number ids also stand for the order, as far as they tell lines apart.
    order = F.coalesce(F.col("who.id").cast("bigint"), F.lit(-(1 << 63))) if isinstance(docs.schema[doc_id].dataType, T.IntegralType) else F.lit(0).cast("bigint")
    gone = near_lines(left.withColumn("id", F.xxhash64("line")).withColumn("order", order), edits)
    done = without(once.withColumn("lines", F.col("kept")), gone.select("who", "cell", "at"))
    stay = F.filter("kept", lambda line: line.isNotNull())
    body = F.when(F.col("kept").isNotNull(), F.array_join(stay, "\n"))
    n_lines = F.coalesce(F.size("kept"), F.lit(0))
    n_lines = F.when(F.col("kept").isNull(), 0).otherwise(n_lines)
    kept_lines = F.when(F.col("kept").isNull(), 0).otherwise(F.size(stay))
    return done.select(
        *((body if c == text else F.col("doc").getField(c)).alias(c) for c in plain.columns), n_lines.cast("bigint").alias("n_lines"), (n_lines - kept_lines).cast("bigint").alias("n_removed"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (doc, who, cell, lines) with ``kept``: the lines, null where (who, at) is in ``gone``. Only documents that may lose a line are shuffled."""
    lost = stored(gone.groupBy("cell", "who").agg(F.collect_set("at").alias("ats")), "lost-lines")
    marked = may_hold(rows.select("doc", "who", "cell", "lines"), "cell", lost, "cell")
    same = (F.col("r.cell") == F.col("g.cell")) & F.col("r.who.id").eqNullSafe(F.col("g.who.id")) & (F.col("r.who.h") == F.col("g.who.h"))
    met = marked.where("maybe").alias("r").join(lost.alias("g"), same, "left").select("r.doc", "r.who", "r.cell", "r.lines", "g.ats")
    none = marked.where("not maybe").select("doc", "who", "cell", "lines", F.lit(None).cast("array<int>").alias("ats"))
    kept = F.when(F.col("ats").isNull(), F.col("lines")).otherwise(F.expr("transform(lines, (line, at) -> if(array_contains(ats, at), null, line))"))
    return met.unionByName(none).select("doc", "who", "cell", kept.alias("kept"))
