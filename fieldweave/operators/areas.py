"""Exact areas of unions and intersections of rings, by slabs.

The plane of a group is cut by horizontal lines through every vertex and every crossing of two edges. Between two such lines no edges cross, so what lies between neighbouring
edges is a trapezoid, and its area is its height times its width half way up: nothing is sampled, and slivers of any width count. A group is a site, or a cell of one where a site has many rings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch

#: Rings of a cell, on average, before a site is cut into more cells; cells a side at most (a cell is a task's smallest share, not a limit on rings).
CELL_RINGS, MOST_CELLS = 64, 1024
#: Tasks of a shuffle of rings, as a multiple of the session's number: rings are wide, so a task gets fewer of them.
PARTS_A_SHUFFLE = 4
#: Pairs of edges that one numpy step looks at.
STEP_PAIRS = 1 << 21


def ragged(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def stacked(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers that order (group, value) of both lists, so that one search serves all groups; exact, as only ranks of values are used."""
    values = np.unique(np.r_[a, b])
    return group_a * len(values) + np.searchsorted(values, a), group_b * len(values) + np.searchsorted(values, b)


def crossing_heights(group: np.ndarray, x1, y1, x2, y2) -> tuple[np.ndarray, np.ndarray]:
    """(group, y) of the crossings of edges (y1 < y2) of one group. Edges come sorted by (group, y1): an edge meets those that begin below its upper end."""
    rank = np.arange(len(group))
    begin, end = stacked(group, y1, group, y2)
    last = np.searchsorted(begin, end, "left")
    counts = np.maximum(last - rank - 1, 0)
    found_group, found_y = [], []
    at = 0
    total = np.cumsum(counts)
    while at < len(rank):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + STEP_PAIRS, "right")))
        n = counts[at:end]
        a = np.repeat(rank[at:end], n)
        b = a + 1 + ragged(n)
        near = (np.minimum(x1[a], x2[a]) <= np.maximum(x1[b], x2[b])) & (np.minimum(x1[b], x2[b]) <= np.maximum(x1[a], x2[a]))
        a, b = a[near], b[near]
        ka, kb = (x2[a] - x1[a]) / (y2[a] - y1[a]), (x2[b] - x1[b]) / (y2[b] - y1[b])
        with np.errstate(divide="ignore", invalid="ignore"):
            y = ((x1[b] - kb * y1[b]) - (x1[a] - ka * y1[a])) / (ka - kb)
        inside = (y > np.maximum(y1[a], y1[b])) & (y < np.minimum(y2[a], y2[b]))
        found_group.append(group[a[inside]])
        found_y.append(y[inside])
        at = end
    return (np.concatenate(found_group), np.concatenate(found_y)) if found_group else (group[:0], y1[:0])


def group_areas(group: np.ndarray, ring: np.ndarray, edges: np.ndarray, layers: np.ndarray, boxes: np.ndarray, measures: Sequence[tuple[str, list[int]]]) -> np.ndarray:
    """Area of each measure in the box of each group. ``edges``: x1, y1, x2, y2 by row, with their group and ring (0, 1, ..); ``layers``: a flag for each ring and layer.

    A ring that crosses itself fills by the even-odd rule. A measure is ``any`` or ``all`` of some layers.
    """
    out = np.zeros((len(boxes), len(measures)))
    x1, y1, x2, y2 = edges.T
    swap = y1 > y2
    x1, y1, x2, y2 = np.where(swap, x2, x1), np.where(swap, y2, y1), np.where(swap, x1, x2), np.where(swap, y1, y2)
    west, south, east, north = boxes[group].T
    keep = (y1 < y2) & (y2 > south) & (y1 < north) & (np.minimum(x1, x2) < east)
    group, ring, x1, y1, x2, y2 = (v[keep] for v in (group, ring, x1, y1, x2, y2))
    if not len(group):
        return out
    order = np.lexsort((y1, group))
    group, ring, x1, y1, x2, y2 = (v[order] for v in (group, ring, x1, y1, x2, y2))
    west, south, east, north = boxes[group].T
    cut_group, cut_y = [group, group, np.arange(len(boxes)), np.arange(len(boxes))], [y1, y2, boxes[:, 1], boxes[:, 3]]
    more = crossing_heights(group, x1, y1, x2, y2)
    cut_group.append(more[0])
    cut_y.append(more[1])
    slope = (x2 - x1) / (y2 - y1)
    for side in (west, east):
        with np.errstate(divide="ignore", invalid="ignore"):
            y = y1 + (side - x1) / slope
        hit = (y > y1) & (y < y2)
        cut_group.append(group[hit])
        cut_y.append(y[hit])
    cg, cy = np.concatenate(cut_group), np.concatenate(cut_y)
    inside = (cy >= boxes[cg, 1]) & (cy <= boxes[cg, 3])
    order = np.lexsort((cy[inside], cg[inside]))
    cg, cy = cg[inside][order], cy[inside][order]
    fresh = np.r_[True, (cg[1:] != cg[:-1]) | (cy[1:] != cy[:-1])]
    cg, cy = cg[fresh], cy[fresh]

    # Slab k lies between cuts k and k + 1 of one group.
    def slab_at(g, y):
        """Number of the first cut of the group at or above y, or of the box's edge beyond it."""
        cuts, asked = stacked(cg, cy, g, np.clip(y, boxes[g, 1], boxes[g, 3]))
        return np.searchsorted(cuts, asked, "left")

    a, b = slab_at(group, y1), slab_at(group, y2)
    n = b - a
    edge = np.repeat(np.arange(len(group)), n)
    slab = np.repeat(a, n) + ragged(n)
    height = cy[slab + 1] - cy[slab]
    x = x1[edge] + ((cy[slab] + cy[slab + 1]) / 2 - y1[edge]) * slope[edge]
    of = ring[edge]
    # Along a slab a ring is entered at its first crossing, left at its second, and so on.
    order = np.lexsort((x, of, slab))
    slab, of, x, height, edge = (v[order] for v in (slab, of, x, height, edge))
    head = np.flatnonzero(np.r_[True, (slab[1:] != slab[:-1]) | (of[1:] != of[:-1])])
    place = np.arange(len(slab)) - np.repeat(head, np.diff(np.r_[head, len(slab)]))
    sign = 1 - 2 * (place % 2)
    order = np.lexsort((x, slab))
    slab, of, x, height, sign, g = slab[order], of[order], x[order], height[order], sign[order], group[edge[order]]
    x = np.clip(x, boxes[g, 0], boxes[g, 2])
    # What is open after the last edge of a slab goes on to the box's side: edges beyond it were left out.
    last = np.r_[slab[1:] != slab[:-1], True]
    wide = (np.where(last, boxes[g, 2], np.r_[x[1:], 0.0]) - x) * height
    depth = np.cumsum(layers[of] * sign[:, None], axis=0)
    # Depths start anew with each slab.
    start = np.flatnonzero(np.r_[True, last[:-1]])
    base = np.vstack([np.zeros((1, depth.shape[1]), depth.dtype), depth[start[1:] - 1]])
    depth = depth - np.repeat(base, np.diff(np.r_[start, len(slab)]), axis=0) > 0
    for k, (kind, some) in enumerate(measures):
        flag = depth[:, some].any(axis=1) if kind == "any" else depth[:, some].all(axis=1)
        out[:, k] = np.bincount(g, weights=np.where(flag, wide, 0.0), minlength=len(boxes))
    return out


def exact_areas(rings: DataFrame, keys: Sequence[str], layers: Sequence[str], measures: Mapping[str, tuple[str, Sequence[str]]], box: str | None = None) -> DataFrame:
    """Area of each measure for each key that has rings: ``measures`` maps a name to ("any" | "all", layers).

    ``rings``: keys, ``xy`` (array of x, y), layers (0 or 1) and, if given, ``box`` (west, south, east, north; one for each key), in which areas are counted. Equal rings of a key are one. Keys with
    many rings are cut into cells, each with the rings that reach it, so a site that holds a large part of all rings is many groups.
    """
    # Rings travel as plain numbers and layers as bits. They are dealt before equal ones are looked for: done in the tasks that read them, that would hold each task's whole share of the input.
    tasks = PARTS_A_SHUFFLE * int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = F.flatten(F.transform("xy", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    bits = reduce(Column.__add__, (F.shiftleft(F.col(c).cast("int"), k) for k, c in enumerate(layers)))
    sides = {k: F.col(box)[c].cast("double").alias(f"__box_{k}") for k, c in zip("wsen", ("west", "south", "east", "north"), strict=True)} if box else {}
    xs, ys = F.transform("xy", lambda p: p["x"].cast("double")), F.transform("xy", lambda p: p["y"].cast("double"))
    at = {"w": F.array_min(xs), "s": F.array_min(ys), "e": F.array_max(xs), "n": F.array_max(ys)}
    one = rings.filter(F.size("xy") > 2).select(*keys, flat.alias("__ring"), bits.alias("__on"), *[c.alias(f"__at_{k}") for k, c in at.items()], *sides.values())
    # Read twice below, so they are written once: what the rings come from would be worked out anew for each.
    folder = scratch(rings.sparkSession, "rings")
    one.repartition(tasks, *keys, "__ring").distinct().write.parquet(folder)
    one = rings.sparkSession.read.schema(one.schema).parquet(folder)
    area = {k: (F.min(f"__box_{k}") if box else agg(f"__at_{k}")).alias(f"__area_{k}") for k, agg in zip("wsen", (F.min, F.min, F.max, F.max), strict=True)}
    site = one.groupBy(*keys).agg(F.count("*").alias("__rings"), *area.values()).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(*[F.col(f"__area_{k}").alias(k) for k in "wsen"]).alias("__area"),
        F.least(F.lit(MOST_CELLS), F.ceil(F.sqrt(F.col("__rings") / CELL_RINGS))).cast("int").alias("__side"))
    met = one.join(site, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])

    def cells(low: str, high: str):
        a, b = F.col("__area")[low], F.col("__area")[high]
        cell = lambda v: F.greatest(F.lit(0), F.least(F.col("__side") - 1, F.floor(F.coalesce(F.try_divide(v - a, b - a), F.lit(0.0)) * F.col("__side")).cast("int")))
        return F.sequence(cell(F.col(f"__at_{low}")), cell(F.col(f"__at_{high}")))

    def edge(low: str, high: str, cell: str, upper: int):
        a, b = F.col("__area")[low], F.col("__area")[high]
        return F.when(F.col(cell) + upper == F.col("__side"), b).otherwise(a + (b - a) * (F.col(cell) + upper) / F.col("__side"))

    # What lies left of a cell does not reach it; what lies right of it is left out when its edges are looked at.
    apart = (F.col("__at_e") < F.col("__area.w")) | (F.col("__at_w") > F.col("__area.e")) | (F.col("__at_n") < F.col("__area.s")) | (F.col("__at_s") > F.col("__area.n"))
    dealt = met.filter(~apart).withColumn("__cx", F.explode(cells("w", "e"))).withColumn("__cy", F.explode(cells("s", "n"))).select(
        *keys, "__cx", "__cy", "__ring", "__on",
        F.array(edge("w", "e", "__cx", 0), edge("s", "n", "__cy", 0), edge("w", "e", "__cx", 1), edge("s", "n", "__cy", 1)).alias("__b"))
    names = list(measures)
    index = {c: k for k, c in enumerate(layers)}
    wanted = [(kind, [index[c] for c in some]) for kind, some in measures.values()]
    schema = T.StructType([*rings.select(*keys).schema, *[T.StructField(n, T.DoubleType()) for n in names]])
    group_keys = [*keys, "__cx", "__cy"]

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _group_starts(table, group_keys)
            # The last group of a batch may go on in the next one.
            if starts[-1]:
                yield _measured(table.slice(0, starts[-1]), starts[:-1], keys, len(layers), names, wanted)
                held = table.slice(starts[-1]).combine_chunks().to_batches()
            else:
                held = table.to_batches()
        if held and held[0].num_rows:
            table = pa.Table.from_batches(held).combine_chunks()
            yield _measured(table, _group_starts(table, group_keys), keys, len(layers), names, wanted)

    parts = dealt.repartition(tasks, *group_keys).sortWithinPartitions(*group_keys).mapInArrow(measure, schema)
    return parts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def _group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows at which a group begins; nulls are equal."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = _flat(table.column(k))
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _measured(table: pa.Table, starts: np.ndarray, keys: Sequence[str], n_layers: int, names: Sequence[str], wanted: Sequence[tuple[str, list[int]]]) -> pa.RecordBatch:
    rings = _flat(table.column("__ring"))
    sizes = np.diff(rings.offsets.to_numpy()) // 2
    x, y = rings.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2).T
    ring = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    after = np.arange(1, len(x) + 1)
    after[ends - 1] = ends - sizes  # the last edge closes the ring
    group = np.searchsorted(starts, np.arange(len(sizes)), "right") - 1
    layers = table.column("__on").to_numpy()[:, None].astype(np.int64) >> np.arange(n_layers) & 1
    boxes = np.array(table.column("__b").take(pa.array(starts)).to_pylist(), float)
    found = group_areas(group[ring], ring, np.c_[x, y, x[after], y[after]], layers, boxes, wanted)
    heads = table.take(pa.array(starts))
    return pa.RecordBatch.from_arrays([*(_flat(heads.column(k)) for k in keys), *(pa.array(found[:, k]) for k in range(len(names)))], [*keys, *names])


def _flat(column: pa.ChunkedArray) -> pa.Array:
    """One array; slices of it start at 0."""
    return pa.concat_arrays(column.chunks)
