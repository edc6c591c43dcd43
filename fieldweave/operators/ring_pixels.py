"""Pixels under rings, band by band of an image.

Rings, not their spans or cells, are shuffled: a ring goes to every band of rows that it meets, and a task turns the rings of a band into spans, merges them and hands on pixels. What is kept of a
band between batches is its merged spans and its pixels, so an image with any number of rings needs no more than its grid.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .areas import _flat, _group_starts, ragged

#: Pixel rows of a band.
BAND_ROWS = 32


def ring_spans(ring: np.ndarray, x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(ring, row, a, b): cells a .. b - 1 of a row, whose centres lie inside, from edges (with their ring); rows ``low`` .. ``high`` - 1 of each edge count. Paired crossings: even-odd."""
    y, y2 = y - 0.5, y2 - 0.5
    keep = np.isfinite(x) & np.isfinite(x2) & np.isfinite(y) & np.isfinite(y2) & (y != y2)
    ring, x, y, x2, y2, low, high = (v[keep] for v in (ring, x, y, x2, y2, low, high))
    slope = (x2 - x) / (y2 - y)
    first = np.clip(np.ceil(np.minimum(y, y2)), low, high).astype(np.int64)
    count = np.clip(np.ceil(np.maximum(y, y2)), low, high).astype(np.int64) - first
    edge = np.repeat(np.arange(len(ring)), count)
    row = np.repeat(first, count) + ragged(count)
    at = x[edge] + (row - y[edge]) * slope[edge]
    of = ring[edge]
    order = np.lexsort((at, of * (int(row.max(initial=0)) + 1) + row))
    of, row, at = of[order], row[order], at[order]
    head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (row[1:] != row[:-1])][:len(of)])
    place = np.arange(len(of)) - np.repeat(head, np.diff(np.r_[head, len(of)]))
    enter = np.flatnonzero(place % 2 == 0)
    enter = enter[enter + 1 < len(of)]
    enter = enter[place[enter + 1] == place[enter] + 1]
    of, row, xa, xb = of[enter], row[enter], at[enter], at[enter + 1]
    a, b = np.clip(np.ceil(xa - 0.5), 0, width).astype(np.int64), np.clip(np.ceil(xb - 0.5), 0, width).astype(np.int64)
    some = (xb > xa) & (a < b)
    return of[some], row[some], a[some], b[some]


def merged_spans(line: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each line without overlaps, in order."""
    if not len(line):
        return line, a, b
    shift = int(b.max()) + 1
    order = np.argsort(line * shift + a)
    line, a, b = line[order], a[order], b[order]
    dense = np.cumsum(np.r_[0, line[1:] != line[:-1]])
    reach = np.maximum.accumulate(b + dense * shift) - dense * shift
    new = np.r_[True, (line[1:] != line[:-1]) | (a[1:] > reach[:-1])]
    heads = np.flatnonzero(new)
    return line[heads], a[heads], reach[np.r_[heads[1:] - 1, len(line) - 1]]


def pixel_counts(line: np.ndarray, a: np.ndarray, b: np.ndarray, fine: int, lines: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(pixel, sub-cells under its merged spans); a line is group * lines + fine row, a pixel is (group * rows + row) * width + column."""
    first, last = a // fine, (b - 1) // fine
    n = last - first + 1
    span = np.repeat(np.arange(len(a)), n)
    col = first[span] + ragged(n)
    cells = np.minimum(b[span], (col + 1) * fine) - np.maximum(a[span], col * fine)
    pixel = (line[span] // lines * (lines // fine) + line[span] % lines // fine) * width + col
    keys, at = np.unique(pixel, return_inverse=True)
    return keys, np.bincount(at, weights=cells, minlength=len(keys)).astype(np.int64)


def ring_pixels(rings: DataFrame, keys: Sequence[str], height: int, width: int, fine: int, covers: Column, order: Column | None = None, marks: Sequence[Column] = (), flags: Sequence[Column] = (),
                xy: str = "xy") -> DataFrame:
    """One row (keys, row, col, n, mark_0 .., flag_0 ..) for each pixel that rings touch.

    ``n``: sub-cells (``fine`` x ``fine`` of a pixel) under the union of the rings for which ``covers`` holds. With ``order``, rings whose inside holds the pixel's centre count as well: a mark is that of
    the ring last in order among those with such a mark and an order, NULL without any; a flag is 1 if it is set on any. Marks are whole numbers.
    """
    xs, ys = F.transform(xy, lambda p: p["x"].cast("double")), F.transform(xy, lambda p: p["y"].cast("double"))
    names, tags = [f"mark_{i}" for i in range(len(marks))], [f"flag_{i}" for i in range(len(flags))]
    dealt = rings.select(
        *keys, xs.alias("__x"), ys.alias("__y"), F.coalesce(covers, F.lit(False)).alias("__covers"), (F.lit(None).cast("int") if order is None else order).alias("__order"),
        *[m.cast("long").alias(n) for m, n in zip(marks, names)], *[F.coalesce(f.cast("int"), F.lit(0)).alias(n) for f, n in zip(flags, tags)])
    if order is None:
        dealt = dealt.filter("__covers")
    centres = order is not None
    band = lambda y: F.floor(F.least(F.lit(height - 1.0), F.greatest(F.lit(0.0), y)) / BAND_ROWS).cast("int")
    met = (F.array_max("__y") >= 0) & (F.array_min("__y") <= height)
    dealt = dealt.filter(met).withColumn("__band", F.explode(F.sequence(band(F.array_min("__y")), band(F.array_max("__y")))))
    by = [*keys, "__band"]
    schema = T.StructType([*rings.select(*keys).schema, *[T.StructField(c, T.IntegerType()) for c in ("row", "col", "n")], *[T.StructField(c, T.LongType()) for c in names],
                           *[T.StructField(c, T.IntegerType()) for c in tags]])

    def spans(table: pa.Table, group: np.ndarray, base: np.ndarray, scale: int, chosen: np.ndarray):
        """Spans (ring, row in the band, a, b) of the chosen rings on a grid with ``scale`` lines a pixel row."""
        xs, ys = (_flat(table.column(c)) for c in ("__x", "__y"))
        sizes = np.diff(xs.offsets.to_numpy())
        x, y = (v.flatten().to_numpy(zero_copy_only=False).astype(float) * scale for v in (xs, ys))
        ring = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        after = np.arange(1, len(x) + 1)
        after[(ends - 1)[sizes > 0]] = (ends - sizes)[sizes > 0]
        use = chosen[ring]
        ring, after, x1, y1 = ring[use], after[use], x[use], y[use]
        low = base[ring] * scale
        of, row, a, b = ring_spans(ring, x1, y1, x[after], y[after], low, np.minimum(low + BAND_ROWS * scale, height * scale), width * scale)
        return of, row - base[of] * scale, a, b

    lines, pixels = BAND_ROWS * fine, BAND_ROWS * width

    def found(table: pa.Table, starts: np.ndarray, state):
        """Merged spans and pixels of all groups of a table, what was kept of its first group included."""
        group = np.searchsorted(starts, np.arange(table.num_rows), "right") - 1
        base = table.column("__band").to_numpy().astype(np.int64) * BAND_ROWS
        of, row, a, b = spans(table, group, base, fine, table.column("__covers").to_numpy().astype(bool))
        line = group[of] * lines + row
        merged = merged_spans(*(np.r_[old, new] for old, new in zip(state[0], (line, a, b))))
        if not centres:
            return merged, state[1]
        of, row, a, b = spans(table, group, base, 1, np.ones(table.num_rows, bool))
        n = b - a
        span = np.repeat(np.arange(len(a)), n)
        cell = group[of[span]] * pixels + row[span] * width + a[span] + ragged(n)
        ring = of[span]
        old, old_marks, old_flags = state[1]
        pixel, at = np.unique(np.r_[old, cell], return_inverse=True)
        kept, at = at[:len(old)], at[len(old):]
        ordered = table.column("__order").is_valid().to_numpy()
        out_marks, out_flags = [], []
        for name, before in zip(names, old_marks):
            column = table.column(name)
            valid = column.is_valid().to_numpy() & ordered
            best = np.full(len(pixel), -1)
            some = valid[ring]
            np.maximum.at(best, at[some], ring[some])  # rings come in order
            value, has = np.zeros(len(pixel), np.int64), best >= 0
            values = column.fill_null(0).to_numpy()
            value[has] = values[best[has]]
            earlier = ~has[kept] & before[1]
            value[kept[earlier]], has[kept[earlier]] = before[0][earlier], True
            out_marks.append((value, has))
        for name, before in zip(tags, old_flags):
            flag = np.zeros(len(pixel), np.int64)
            flag[at[table.column(name).to_numpy()[ring] > 0]] = 1
            flag[kept[before > 0]] = 1
            out_flags.append(flag)
        return merged, (pixel, out_marks, out_flags)

    def told(heads: pa.Table, state) -> pa.RecordBatch:
        """Pixels of groups, whose first rows are ``heads``."""
        covered, n = pixel_counts(*state[0], fine, lines, width)
        centre, got_marks, got_flags = state[1]
        pixel = np.union1d(covered, centre)
        count = np.zeros(len(pixel), np.int64)
        count[np.searchsorted(pixel, covered)] = n
        at = np.searchsorted(pixel, centre)
        group = pixel // pixels
        row = heads.column("__band").to_numpy().astype(np.int64)[group] * BAND_ROWS + pixel % pixels // width
        columns = [*(_flat(heads.column(k)).take(pa.array(group)) for k in keys), *(pa.array(v.astype(np.int32)) for v in (row, pixel % width, count))]
        for value, has in got_marks:
            wide, lacking = np.zeros(len(pixel), np.int64), np.ones(len(pixel), bool)
            wide[at], lacking[at] = value, ~has
            columns.append(pa.array(wide, mask=lacking))
        for flag in got_flags:
            wide = np.zeros(len(pixel), np.int32)
            wide[at] = flag
            columns.append(pa.array(wide))
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def part(state, low: int, high: int):
        """The state of groups low .. high - 1, numbered from 0."""
        (line, a, b), (pixel, got_marks, got_flags) = state
        some = (line >= low * lines) & (line < high * lines)
        px = (pixel >= low * pixels) & (pixel < high * pixels)
        return (line[some] - low * lines, a[some], b[some]), (pixel[px] - low * pixels, [(v[px], h[px]) for v, h in got_marks], [f[px] for f in got_flags])

    def paint(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        empty = (none, none, none), (none, [(none, np.zeros(0, bool)) for _ in names], [none for _ in tags])
        state, head = empty, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if head is not None:
                joint = pa.concat_tables([head.select(by), table.slice(0, 1).select(by)]).combine_chunks()
                if len(_group_starts(joint, by)) > 1:
                    yield told(head, state)
                    state = empty
            starts = _group_starts(table, by)
            state = found(table, starts, state)
            if len(starts) > 1:
                yield told(table.take(pa.array(starts[:-1])), part(state, 0, len(starts) - 1))
                state = part(state, len(starts) - 1, len(starts))
            head = table.slice(int(starts[-1]), 1)
        if head is not None:
            yield told(head, state)

    tasks = int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, *by).sortWithinPartitions(*by, "__order").mapInArrow(paint, schema)
