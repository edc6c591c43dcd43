"""Pixel tables: masks, pooling, grids, stretches, outlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spectral as SP
from ..functions.series import bind
from ..functions.values import clamp


def mask_bands(px: DataFrame, bands: Sequence[str], good: Column) -> DataFrame:
    """NULL every band where the pixel is not good."""
    return px.withColumns({b: F.when(good, F.col(b)) for b in bands})


def spread_bad(px: DataFrame, bad: Column, keys: Sequence[str], pixel_m: float = 60.0, block_m: float = 2000.0) -> DataFrame:
    """A block is bad when any of its pixels is: max over fixed blocks (some thousand pixels each)."""
    k = int(block_m // pixel_m)
    block = [F.floor(F.col("row") / k), F.floor(F.col("col") / k)]
    w = Window.partitionBy(*keys, *block)
    return px.withColumn("good", ~F.bool_or(bad).over(w))


def apply_usable_mask(px: DataFrame, mask: DataFrame, keys: Sequence[str], bands: Sequence[str],
                      size: tuple[int, int], mask_size: tuple[int, int]) -> DataFrame:
    """Bands NULL where the usable map is not 1; a mask of another size is read at the nearest cell.

    Nearest keeps the corners aligned: cell i of n maps to round(i * (m - 1) / (n - 1)). A mask is a grid a file, made by explodes whose size Spark takes for
    that of the files, so it is merged and never broadcast.
    """
    def near(c, n, m):
        return F.col(c) if n == m else F.floor(F.col(c) * ((m - 1) / max(n - 1, 1)) + 0.5).cast("int")

    p = px.withColumns({"__r": near("row", size[0], mask_size[0]), "__c": near("col", size[1], mask_size[1])})
    m = mask.select(*keys, F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("clear").alias("__clear"))
    j = p.join(m.hint("merge"), [*keys, "__r", "__c"], "left")
    return mask_bands(j, bands, F.col("__clear") == 1).drop("__r", "__c", "__clear")


def masked_fraction(px: DataFrame, bands: Sequence[str], keys: Sequence[str], cells: int | None = None) -> DataFrame:
    """Share of pixels with any band missing. With ``cells`` absent rows count as missing too."""
    hole = F.coalesce(*[F.when(F.col(b).isNull(), 1.0) for b in bands], F.lit(0.0))
    if cells is None:
        return px.groupBy(*keys).agg(F.avg(hole).alias("masked_fraction"))
    return px.groupBy(*keys).agg((1.0 - F.sum(1.0 - hole) / cells).alias("masked_fraction"))


def with_indices(px: DataFrame) -> DataFrame:
    """Every index variant as a column."""
    return px.withColumns({
        "ndvi": SP.ndvi(), "ndwi_swir": SP.ndwi_swir(), "ndwi_green": SP.ndwi_green(),
        "evi_scaled": SP.evi_scaled(), "evi_clipped": SP.evi_clipped(), "evi_raw": SP.evi_raw(), "ndvi_rounded": SP.ndvi_rounded()})


def spatial_summaries(px: DataFrame, value: str, keys: Sequence[str] = ("file_id", "t"), size: int = 100, centre: int = 50,
                      legacy: bool = False) -> DataFrame:
    """Per window: mean, p90, max, share above half, the same for the centre, and 20 m and 30 m pooling.

    Missing pixels are skipped. ``legacy`` keeps the published figures: missing
    counts as -1e9 in p90, stays in the divisor of the share, and the 20 m pool
    joins columns only. All of it is one grouping of pixels and one per pool size;
    an image is at most size x size pixels, so the exact percentile is bounded.
    """
    v = F.col(value)
    lo = (size - centre) // 2
    inner = F.col("row").between(lo, lo + centre - 1) & F.col("col").between(lo, lo + centre - 1)
    low = F.coalesce(v, F.lit(-1e9)) if legacy else v
    high = (F.coalesce(v > 0.5, F.lit(False)) if legacy else v > 0.5).cast("double")
    some, some_inner = F.count(v) > 0, F.count(F.when(inner, v)) > 0
    whole = px.groupBy(*keys).agg(
        F.avg(v).alias("full_mean"), F.when(some, F.percentile(low, 0.9)).alias("full_p90"), F.max(v).alias("full_max"),
        F.avg(high).alias("full_frac_high"), F.avg(F.when(inner, v)).alias("center_mean"),
        F.when(some_inner, F.percentile(F.when(inner, low), 0.9)).alias("center_p90"))

    def pooled(k: int, name: str, both: bool) -> DataFrame:
        cut = size // k * k
        row = F.floor(F.col("row") / k) if both else F.col("row")
        p = px.filter((F.col("row") < cut) & (F.col("col") < cut)) if cut < size else px
        small = p.groupBy(*keys, row.alias("__r"), F.floor(F.col("col") / k).alias("__c")).agg(F.avg(v).alias("__v"))
        return small.groupBy(*keys).agg(F.avg("__v").alias(name))

    d20 = pooled(2, "d20m_mean", not legacy)
    d30 = pooled(3, "d30m_mean", True)
    return whole.join(d20, list(keys), "left").join(d30, list(keys), "left")


def trajectories(px: DataFrame, keys: Sequence[str] = ("file_id", "t"), least: int = 20) -> DataFrame:
    """NDVI mean and p90, NDWI and EVI mean per window; NULL under ``least`` valid pixels."""
    ok = px.filter((F.col("b4") > 0) & (F.col("b8") > 0))
    nd = SP.ndvi()
    g = ok.groupBy(*keys).agg(
        F.count("*").alias("n_valid"), F.avg(nd).alias("ndvi"), F.percentile(nd, 0.9).alias("ndvi_p90"),
        F.avg(SP.ndwi_swir()).alias("ndwi"), F.avg(SP.evi_scaled()).alias("evi"))
    enough = F.col("n_valid") >= least
    return g.select(*keys, "n_valid", *[F.when(enough, F.col(c)).alias(c) for c in ("ndvi", "ndvi_p90", "ndwi", "evi")])


def stretch(px: DataFrame, band: str, keys: Sequence[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """2 to 98 percent stretch to 0..1 per image and band; a flat image keeps its reflectance."""
    x = F.col(band) / 10_000.0
    q = px.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("__q"))
    lo, hi = F.col("__q")[0], F.col("__q")[1]
    out = F.when(hi <= lo + 1e-6, clamp(x, 0.0, 1.0)).otherwise(clamp((x - lo) / (hi - lo), 0.0, 1.0))
    return px.join(q, list(keys)).withColumn(f"{band}_01", out).drop("__q")


def fixed_rgb(px: DataFrame, red: str = "b4", green: str = "b3", blue: str = "b2", scale: float = 3000.0, sentinel: int = -9999) -> DataFrame:
    """Bands / scale in 0..1; a missing band is 0, and a sentinel in any band blackens the pixel."""
    hole = F.lit(False)
    for b in (red, green, blue):
        hole = hole | F.coalesce(F.col(b) == sentinel, F.lit(False))
    return px.withColumns({
        n: F.when(hole, 0.0).otherwise(clamp(F.coalesce(F.col(b), F.lit(0)) / scale, 0.0, 1.0)) for n, b in (("r", red), ("g", green), ("b", blue))})


def outline(cells: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Unit edges (x1, y1, x2, y2) around the marked pixels: sides met by one pixel only.

    Edges are dealt before they are counted: a side meets two pixels at most, so counts in the tasks that make them would save nothing and hold all their edges.
    """
    tasks = 4 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r, c = F.col("row").cast("double"), F.col("col").cast("double")

    def edge(x1, y1, x2, y2):
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    sides = F.array(
        edge(c - 0.5, r - 0.5, c + 0.5, r - 0.5), edge(c - 0.5, r + 0.5, c + 0.5, r + 0.5),
        edge(c - 0.5, r - 0.5, c - 0.5, r + 0.5), edge(c + 0.5, r - 0.5, c + 0.5, r + 0.5))
    e = cells.select(*keys, "row", "col").distinct().select(*keys, F.explode(sides).alias("e")).select(*keys, "e.*")
    return e.repartition(tasks, *keys, "x1", "y1", "x2", "y2").groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.count("*").alias("__n")).filter("__n = 1").drop("__n")


def full_grid(files: DataFrame, height: int, width: int, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Every cell of every file. A short list of files becomes a large table, so it is spread over all tasks before the explodes, with a number that is not coalesced."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select(*keys).repartition(tasks, *keys).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def rebuild_mask(guesses: DataFrame, files: DataFrame, height: int, width: int, value: str, fill: int = -1,
                 keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Full grid from guesses on valid pixels only; a guess outside the grid is an error."""
    g = full_grid(files, height, width, keys).withColumn("__cell", F.lit(True))
    both = g.join(guesses.select(*keys, "row", "col", value), [*keys, "row", "col"], "full")
    inside = F.when(F.col("__cell").isNull(), F.raise_error(F.lit("a guess lies outside the grid")).cast("int")).otherwise(F.coalesce(value, F.lit(fill)))
    return both.withColumn(value, inside).drop("__cell")


def crop_or_pad(px: DataFrame, height: int, width: int, target: int, bands: Sequence[str], keys: Sequence[str] = ("file_id", "t")) -> DataFrame:
    """Centre crop of a larger image, centred padding (NULL) of a smaller one."""
    dr = max(0, (target - height) // 2) - max(0, (height - target) // 2)
    dc = max(0, (target - width) // 2) - max(0, (width - target) // 2)
    moved = px.withColumns({"row": F.col("row") + dr, "col": F.col("col") + dc}).filter(
        F.col("row").between(0, target - 1) & F.col("col").between(0, target - 1))
    g = full_grid(px, target, target, keys)
    return g.join(moved.select(*keys, "row", "col", *bands), [*keys, "row", "col"], "left")


def regrid_nearest(px: DataFrame, target: DataFrame, bands: Sequence[str], keys: Sequence[str], source_grid: str, target_grid: str) -> DataFrame:
    """Pixels read at the nearest source cell of every target cell.

    ``target`` has one row per key with the two grids, each a struct (x0, y0, cell,
    height, width) with the top left corner. Missing source cells give NULL.
    """
    s, t = F.col(source_grid), F.col(target_grid)
    cells = target.withColumn("row", F.explode(F.sequence(F.lit(0), t["height"] - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), t["width"] - 1)))
    x = t["x0"] + (F.col("col") + 0.5) * t["cell"]
    y = t["y0"] - (F.col("row") + 0.5) * t["cell"]
    cells = cells.select(*keys, "row", "col", F.floor((s["y0"] - y) / s["cell"]).cast("int").alias("__r"), F.floor((x - s["x0"]) / s["cell"]).cast("int").alias("__c"))
    src = px.select(*keys, F.col("row").alias("__r"), F.col("col").alias("__c"), *bands)
    return cells.join(src, [*keys, "__r", "__c"], "left").drop("__r", "__c")


def resample_bilinear(px: DataFrame, value: str, keys: Sequence[str], height: int, width: int, target: int) -> DataFrame:
    """A band of height x width read on a target x target grid over the same area.

    Each target cell needs four source cells at most. An image is a small grid, so its cells are gathered once, by row, and read where they lie: what is shuffled is the
    source pixels alone. Cells past the edge repeat the edge; missing cells have no share.
    """
    tasks = int(px.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = F.col
    cells = px.select(*keys, "row", "col", c(value).cast("double").alias("__v")).repartition(tasks, *keys).groupBy(*keys, "row", "col").agg(F.sum("__v").alias("__v"))
    entry = lambda k, v: F.map_from_entries(F.collect_list(F.when(c(k).isNotNull(), F.struct(k, v))))
    lines = cells.groupBy(*keys, "row").agg(entry("col", "__v").alias("__line"))
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    dense = F.transform(numbers(height), lambda r: bind(F.element_at("__lines", r), lambda line: F.transform(numbers(width), lambda i: F.element_at(line, i))))
    grid = lines.groupBy(*keys).agg(entry("row", "__line").alias("__lines")).withColumn("__grid", dense)

    def place(i, n):
        """(lower cell, upper cell, share of the upper one)"""
        at = (i + 0.5) * (n / target) - 0.5
        low = F.floor(at)
        clip = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
        return clip(low), clip(low + 1), at - low

    each = grid.select(*keys, "__grid", F.explode(numbers(target)).alias("row"))
    y0, y1, wy = place(c("row"), height)
    each = each.select(*keys, "row", F.get("__grid", y0).alias("__low"), F.get("__grid", y1).alias("__high"), wy.alias("__wy"))

    def read(i):
        x0, x1, wx = place(i, width)
        parts = [(1 - c("__wy")) * (1 - wx) * F.get("__low", x0), (1 - c("__wy")) * wx * F.get("__low", x1), c("__wy") * (1 - wx) * F.get("__high", x0), c("__wy") * wx * F.get("__high", x1)]
        some = F.coalesce(*parts).isNotNull()
        zero = [F.coalesce(p, F.lit(0.0)) for p in parts]
        return F.when(some, zero[0] + zero[1] + zero[2] + zero[3])

    return each.select(*keys, "row", F.posexplode(F.transform(numbers(target), read)).alias("col", value))


def class_share_grid(px: DataFrame, cls: str, wanted: int, x: Column, y: Column, cell_m: float, keys: Sequence[str] = ()) -> DataFrame:
    """Share of one class in coarse cells of projected metres, with the cell centre.

    A fine pixel counts for the cell that holds its centre.
    """
    return (
        px.withColumns({"cx": F.floor(x / cell_m), "cy": F.floor(y / cell_m)})
        .groupBy(*keys, "cx", "cy")
        .agg(F.avg((F.col(cls) == wanted).cast("double")).alias("agriculture"), F.count("*").alias("n"))
        .withColumns({"x": (F.col("cx") + 0.5) * cell_m, "y": (F.col("cy") + 0.5) * cell_m})
    )


def label_band(labels: DataFrame, band: str, keys: Sequence[str] = ("file_id", "operator")) -> DataFrame:
    """One label band by name."""
    return labels.select(*keys, "row", "col", F.col(band).alias("value"))
