"""Picking, numbering and ranking rows without pulling a hot group into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import _c, hash_key
from ..session import settled, stored


def first_per_key(df: DataFrame, keys: Sequence, order: Sequence, n: int = 1, rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows of each key.

    ``row_number() <= n`` with a literal bound becomes a window group limit: each
    map task keeps n rows per key before the shuffle, so a key that holds a third
    of the table costs n rows per task, not the whole group.
    """
    rn = rank_col or "__rn"
    w = Window.partitionBy(*[_c(k) for k in keys]).orderBy(*order)
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


def losers(df: DataFrame, keys: Sequence, order: Sequence, row_id: str) -> DataFrame:
    """All rows ``first_per_key`` drops: an anti join on the row id, so no group is sorted whole."""
    winners = first_per_key(df, keys, order).select(row_id)
    return df.join(winners, row_id, "left_anti")


def by_priority(col, table: Mapping[str, int], missing: int = 1_000_000) -> Column:
    """Sort value of a labeler; unknown labelers last."""
    expr = None
    for name, rank in table.items():
        cond = _c(col) == name
        expr = F.when(cond, rank) if expr is None else expr.when(cond, rank)
    return expr.otherwise(missing)


def numbered(df: DataFrame, order: Sequence[str], id_col: str = "unique_id", start: int = 1) -> DataFrame:
    """Row ids start..n in the given order.

    A range shuffle on the whole order key spreads even one hot leading value.
    The sorted rows are written because the ids need two passes (count per
    range, then offset) over the very same ranges. Only the count per range, one
    row per partition, goes through a single task.
    """
    laid = stored(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("__row", F.monotonically_increasing_id())
    )
    laid = laid.withColumns({
        "__range": F.shiftright("__row", 33),
        "__pos": F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    sizes = laid.groupBy("__range").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    return (
        laid.join(F.broadcast(offsets), "__range")
        .withColumn(id_col, F.col("__before") + F.col("__pos") + F.lit(start))
        .drop("__range", "__row", "__pos", "__before")
    )


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], id_col: str, start: int = 0, whole: str | None = None) -> DataFrame:
    """Row ids start..n within each key, in the given order, and if asked ids of all rows (from 0) as ``whole``.

    All rows are numbered together, so a hot key is spread over many ranges; a key's ids are the differences to its first one. Keys are not null.
    They are few against the rows, which stay where they are: only the keys' first ids are sent.
    """
    rows = numbered(df, [*keys, *order], "__all", 0)
    first = rows.groupBy(*keys).agg(F.min("__all").alias("__first"))
    out = rows.join(F.broadcast(first), list(keys)).withColumn(id_col, F.col("__all") - F.col("__first") + F.lit(start)).drop("__first")
    return out.withColumnRenamed("__all", whole) if whole else out.drop("__all")


def hashed_sample(
    df: DataFrame, keys: Sequence[str], quota, seed: int, ids: Sequence[str], prefixes: Sequence[int] = (3, 7)
) -> DataFrame:
    """Exactly the ``quota`` rows of each key with the smallest hash.

    ``quota`` is a number or a column of ``df`` that is constant per key. Rows are
    counted per hash prefix; whole prefixes below the cut are kept by a filter
    alone, and the one prefix that crosses the cut is cut again by the next, longer
    prefix. Only rows that share the longest one, 7 hex digits or one row in 268
    million, are ranked, so neither a hot key nor a whole table is ever sorted in one task.
    """
    q = F.lit(quota) if isinstance(quota, int) else _c(quota)
    marked = df.withColumn("__h", hash_key(seed, *ids)).withColumn("__q", q.cast("long"))
    return _cut_sample(marked, keys, ids, list(prefixes)).drop("__h", "__q")


def _cut_sample(marked: DataFrame, keys: Sequence[str], ids: Sequence[str], prefixes: list[int]) -> DataFrame:
    if not prefixes:
        rank = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__h", *ids))
        return marked.withColumn("__rn", rank).filter(F.col("__rn") <= F.col("__q")).drop("__rn")
    marked = marked.withColumn("__b", F.substring("__h", 1, prefixes[0]))
    counts = marked.groupBy(*keys, "__b").agg(F.count("*").alias("__n"), F.max("__q").alias("__most"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__b")
    cut_at = F.min(F.when(F.col("__cum") > F.col("__most"), F.struct(
        F.col("__b").alias("b"), (F.col("__most") - F.col("__cum") + F.col("__n")).alias("left"))))
    edge = counts.withColumn("__cum", F.sum("__n").over(w)).groupBy(*keys).agg(cut_at.alias("__cut"))
    if keys:
        edge = edge.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__cut")
        cond = [marked[k].eqNullSafe(edge[f"__k_{k}"]) for k in keys]
        near = marked.join(edge, cond).drop(*[f"__k_{k}" for k in keys])
    else:
        near = marked.withColumn("__cut", edge.scalar())
    whole = near.filter(F.col("__cut").isNull() | (F.col("__b") < F.col("__cut.b"))).drop("__b", "__cut")
    part = near.filter((F.col("__b") == F.col("__cut.b")) & (F.col("__cut.left") > 0)).withColumn("__q", F.col("__cut.left")).drop("__b", "__cut")
    return whole.unionByName(_cut_sample(part, keys, ids, prefixes[1:]))


def hashed_first(df: DataFrame, n: int, seed: int, ids: Sequence[str]) -> DataFrame:
    """``n`` rows of the whole table by smallest hash (top-n per task, then one merge of n rows each)."""
    return df.orderBy(hash_key(seed, *ids), *ids).limit(n)


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, str], descending: bool = False,
) -> DataFrame:
    """Running sums along any number within each key.

    ``sums`` maps output name to input column. Rows are dealt by ranges of (keys, ``order``), whose bounds come from the data; a row's total is (ranges of its key before) + (rows before within
    the range). Each window therefore sees one row a range, or the rows of one range, never a whole key. Equal numbers of a key are in one range; they should be one row.
    """
    direction = F.col(order).desc() if descending else F.col(order).asc()
    laid = settled(df.repartitionByRange(*[F.col(k) for k in keys], direction).withColumn("__range", F.spark_partition_id()))
    parts = laid.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys) if keys else Window.partitionBy()
    earlier = earlier.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums])
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    w = Window.partitionBy(*keys, "__range").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    out = laid.join(offsets, same).withColumns({n: F.sum(c).over(w) + F.col(f"__o_{n}") for n, c in sums.items()})
    return out.select(*df.columns, *[n for n in sums if n not in df.columns])


def group_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float], accuracy: int = 10_000, cells: int = 1024
) -> DataFrame:
    """Exact linear percentiles of unbounded groups.

    The built-in exact percentile keeps every distinct value of a group in one buffer. Here each wanted rank is bracketed: the values of a bracket are counted in ``cells``
    cells of equal width, and the cell that holds the rank is the next bracket, from its least to its largest value. That is repeated until no bracket of different values holds more
    than ``accuracy`` rows. A bracket is then ranked on its own, so no window sees more than ``accuracy`` rows, whatever the group. A group of at most
    ``accuracy`` rows is one bracket from the start. Missing values and NaN take no part; infinite ones are an error.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("__v"))
    rows = settled(rows)
    whole = rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__n"))
    finite = (F.abs("__lo") < float("inf")) & (F.abs("__hi") < float("inf"))
    whole = settled(whole.filter("__n > 0").withColumn("__lo", F.when(finite, F.col("__lo")).otherwise(F.raise_error(F.lit("percentiles of infinite values")).cast("double"))))
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(float(p)) * (F.col("__n") - 1)).alias("rank")) for n, p in points.items()])
    targets = (
        whole.select(*keys, F.explode(ranks).alias("__t")).select(*keys, "__t.*")
        .select(*keys, "name", "rank", F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("at")).distinct())
    brackets = whole.select(*keys, "__lo", "__hi", F.lit(0).cast("long").alias("__below"), "__n")
    while (brackets.filter("__lo < __hi").agg(F.max("__n")).first()[0] or 0) > accuracy:
        inside = _in_brackets(rows, brackets, keys)
        width = (F.col("__b.hi") - F.col("__b.lo")) / cells
        # Values may be closer to each other than a cell is wide: then the bracket is split at its least value.
        cell = F.when(F.col("__b.lo") + width > F.col("__b.lo"), F.least(F.lit(cells - 1), F.floor((F.col("__v") - F.col("__b.lo")) / width).cast("int"))).otherwise((F.col("__v") > F.col("__b.lo")).cast("int"))
        counts = inside.groupBy(*keys, F.col("__b.lo").alias("__from"), F.col("__b.below").alias("__start"), cell.alias("__cell")).agg(
            F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        before = Window.partitionBy(*keys, "__from").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        spans = counts.select(*keys, "__lo", "__hi", (F.col("__start") + F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__below"), "__n")
        brackets = settled(_holding(targets, spans, keys).select(*keys, "__lo", "__hi", "__below", "__n").distinct())
    merged = _in_brackets(rows, brackets, keys).groupBy(*keys, F.col("__b.lo").alias("__from"), F.col("__b.below").alias("__start"), F.col("__v").alias("__lo")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys, "__from").orderBy("__lo").rowsBetween(Window.unboundedPreceding, -1)
    ranked = merged.select(*keys, "__lo", (F.col("__start") + F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__below"), "__n")
    found = _holding(targets, ranked, keys)
    pick = lambda n, side: F.max(F.when((F.col("name") == n) & (F.col("at") == side("rank")), F.col("__lo")))
    cols = []
    for n in points:
        part = F.max(F.when(F.col("name") == n, F.col("rank") - F.floor("rank")))
        cols.append((pick(n, F.floor) + (pick(n, F.ceil) - pick(n, F.floor)) * part).alias(n))
    return found.groupBy(*keys).agg(*cols)


def _in_brackets(rows: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the bracket (``__b``: lo, hi, below) that holds their value; the others are left out. A key has few brackets, which do not overlap."""
    own = brackets.groupBy(*keys).agg(F.collect_list(F.struct(F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), F.col("__below").alias("below"))).alias("__all"))
    met = _with_own(rows, own, keys, "__all")
    hit = F.get(F.filter("__all", lambda b: F.col("__v").between(b["lo"], b["hi"])), F.lit(0))
    return met.withColumn("__b", hit).filter(F.col("__b").isNotNull()).drop("__all")


def _holding(targets: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each target with the span of ranks (from ``__below`` on, ``__n`` of them) that holds it."""
    own = targets.groupBy(*keys).agg(F.collect_list(F.struct("name", "rank", "at")).alias("__t"))
    hit = F.filter("__t", lambda t: (t["at"] >= F.col("__below")) & (t["at"] < F.col("__below") + F.col("__n")))
    met = _with_own(spans, own, keys, "__t").withColumn("__t", F.explode(hit))
    return met.select(*spans.columns, "__t.*")


def _with_own(rows: DataFrame, own: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``rows`` with the ``column`` that ``own`` has for their key; without keys ``own`` is one row."""
    if not keys:
        return rows.withColumn(column, own.scalar())
    named = own.select(*[F.col(c).alias(f"__k_{c}") for c in keys], column)
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys]).drop(*[f"__k_{c}" for c in keys])
