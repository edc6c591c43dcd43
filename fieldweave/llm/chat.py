"""Reply trees to chat text, with column functions only.

Pointer jumping: after round k every message knows its ancestor 2 ** k hops up, so depth and score sums need
log2(depth) self-joins; the same tables, joined once more, list every message of the chosen root-to-leaf paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Marks of a turn. Fixed values of the template.
START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


def escaped(text: Column) -> Column:
    """Without the two characters that begin every mark; ``unescaped`` gives the text back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def header(role: Column) -> Column:
    """A role may hold line ends; inside a header they are a mark."""
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))


def conversation_trees(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees of one branch: (tree, id, parent, role, text, score).

    Rows go by turn, then role and text; equal and null turns are rows of their own (null first). Null role and text are empty. Null conversations are one tree.
    """
    in_tree = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    plain = rows.select(
        F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = plain.withColumn("id", F.row_number().over(in_tree).cast("bigint"))
    return numbered.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def jump_tables(messages: DataFrame) -> list[DataFrame]:
    """Table k: (tree, id, up, hops, total): the ancestor 2 ** k hops up or null, hops and score sum as far as that or the root."""
    known = messages.select(F.col("tree").alias("t"), F.col("id").alias("p"))
    links = messages.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left")
    tables = [stored(links.select("tree", "id", F.col("p").alias("up"), F.col("p").isNotNull().cast("bigint").alias("hops"), F.col("score").alias("total")), "jumps")]
    # Jumps double; no path is longer than its tree has messages.
    most = messages.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while 1 << (len(tables) - 1) < most:
        # Only rows that have not met their root jump on; the rest stay as they are.
        a, b = tables[-1].where(F.col("up").isNotNull()).alias("a"), tables[-1].alias("b")
        on = F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.id"))
        further = a.join(b, on).select("a.tree", "a.id", "b.up", (F.col("a.hops") + F.col("b.hops")).alias("hops"), (F.col("a.total") + F.col("b.total")).alias("total"))
        tables.append(stored(tables[-1].where(F.col("up").isNull()).unionByName(further), "jumps"))
    return tables


def best_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, depth, position, id): the messages of each tree's ``best`` root-to-leaf paths, root first.

    A branch's score is the mean score of its messages; ties go to the smaller leaf id. A parent that the tree lacks makes a root.
    Messages whose parents run in a circle have no root and are on no path.
    """
    tables = jump_tables(messages)
    parents = tables[0].where(F.col("up").isNotNull()).select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    ends = tables[-1].where(F.col("up").isNull())  # reached a root
    leaves = ends.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / (F.col("hops") + 1)), "id")
    ranked = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    paths = stored(ranked.select("tree", F.col("id").alias("leaf"), "rank", F.col("hops").alias("depth"), F.col("hops").alias("position"), "id"), "paths")
    for k, jumps in enumerate(tables):
        a, b = paths.alias("a"), jumps.where(F.col("up").isNotNull()).alias("b")
        above = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.id") == F.col("b.id"))).select(
            "a.tree", "leaf", "rank", "depth", (F.col("position") - (1 << k)).alias("position"), F.col("b.up").alias("id"))
        paths = stored(paths.unionByName(above), "paths")
    return paths


def format_trees(messages: DataFrame, best: int = 1, learn_from: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, rank, ``formatted`` and ``loss_mask``.

    ``messages``: tree, id, parent, role, text, score; null role or text is empty, a null score 0, other columns are not read. Of rows
    with equal tree and id the least (parent, role, text) stays; a null id is no message. ``loss_mask`` holds the start (from 0) and length, in
    code points of ``formatted``, of each escaped text by ``learn_from``. A path is one row, as any formatted conversation must be.
    """
    content = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    unique = stored(messages.where(F.col("id").isNotNull()).groupBy("tree", "id").agg(F.min(content).alias("m")).select("tree", "id", "m.*"), "messages")
    paths = best_paths(unique.select("tree", "id", "parent", "score"), best).alias("p")
    texts = unique.select("tree", "id", F.col("role") .alias("role"), header(F.col("role")).alias("head"), escaped(F.col("text")).alias("body")).alias("m")
    turns = paths.join(texts, F.col("p.tree").eqNullSafe(F.col("m.tree")) & (F.col("p.id") == F.col("m.id")))
    size = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy("tree", "leaf", "rank").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.select("p.tree", "leaf", "rank", "position", "role", "head", "body").withColumn(
        "start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("position", F.concat("head", "body", F.lit(END)).alias("piece"), (F.col("role") == learn_from).alias("learn"), "start", F.length("body").alias("length"))
    whole = placed.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.expr("transform(filter(turns, t -> t.learn), t -> struct(t.start as start, t.length as length))").alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    body = lambda part: F.substring(part, len(START) + 1, 2147483647)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1), lambda part: F.struct(
            unescaped(F.replace(F.substring_index(body(part), "\n", 1), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            unescaped(F.substring(part, F.instr(part, "\n") + 1, F.lit(2147483647))).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda span: unescaped(F.substring(formatted, (span["start"] + 1).cast("int"), span["length"].cast("int")))), "")

