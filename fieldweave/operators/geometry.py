"""Rings on grids: scan lines, coverage, label pixels, zones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.keys import _c
from ..functions.text import FLAG_PHRASES
from ..functions.values import CATEGORIES
from ..session import settled
from .areas import exact_areas
from .ring_pixels import ring_pixels

# Pixel codes of the categories.
CATEGORY_CODES = {"small-scale": 1, "tree_crop": 2, "industrial": 3, "lawn": 4, "covered": 5}


def scan_lines(rings: DataFrame, xy: str, y0, step, rows: int) -> DataFrame:
    """Inside spans (row, xa, xb) of each ring on the centre lines of a grid.

    Row i lies at ``y0 + (i + 0.5) * step``; step may be negative (rows downward).
    Only rows a ring reaches are exploded. Edges are turned once per ring into line
    units (start row, end row, x, x per row), so a row costs two comparisons and
    one multiplication per edge. Spans come from paired crossings: a ring that
    crosses itself fills by the even-odd rule.
    """
    y0, step = (F.lit(v) if isinstance(v, float) else _c(v) for v in (y0, step))
    rest = [c for c in rings.columns if c != xy]

    def line_edges(r):
        u = F.transform(r, lambda p: F.struct(p["x"].alias("x"), ((p["y"] - y0) / step - 0.5).alias("y")))

        def edges(v):
            nxt = F.concat(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1))
            return F.filter(
                F.zip_with(v, nxt, lambda a, b: F.struct(
                    a["y"].alias("y1"), b["y"].alias("y2"), a["x"].alias("x"), F.try_divide(b["x"] - a["x"], b["y"] - a["y"]).alias("k"))),
                lambda e: e["k"].isNotNull())

        return G.bind(u, edges)

    # a ring becomes many rows: spread the rings first, evenly, whatever image they belong to
    r = rings.repartition(F.xxhash64(xy)).select(*rest, line_edges(F.col(xy)).alias("__edges"))
    lo = F.array_min(F.transform("__edges", lambda e: F.least(e["y1"], e["y2"])))
    hi = F.array_max(F.transform("__edges", lambda e: F.greatest(e["y1"], e["y2"])))
    r = r.withColumns({"__a": F.greatest(F.lit(0), F.ceil(lo).cast("int")), "__z": F.least(F.lit(rows - 1), F.floor(hi).cast("int"))})
    # outer explodes: the inner form adds a filter that repeats these expressions below
    r = r.withColumn("row", F.explode_outer(F.when(F.col("__a") <= F.col("__z"), F.sequence("__a", "__z")))).filter(F.col("row").isNotNull())
    line = F.col("row")
    hit = F.filter("__edges", lambda e: (e["y1"] <= line) != (e["y2"] <= line))
    r = r.select(*rest, "row", F.sort_array(F.transform(hit, lambda e: e["x"] + (line - e["y1"]) * e["k"])).alias("__x"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.expr("size(__x) div 2").cast("int")),
        lambda i: F.struct(F.get("__x", 2 * i).alias("xa"), F.get("__x", 2 * i + 1).alias("xb")))
    return r.select(*rest, "row", F.explode_outer(pairs).alias("__p")).filter(F.col("__p.xb") > F.col("__p.xa")).select(*rest, "row", "__p.xa", "__p.xb")


def site_coverage(images: DataFrame, polygons: DataFrame, key: str, cutoff: int = 3) -> DataFrame:
    """Percent of the site box under the union of its polygons: all, certain ones, and each category. Exact.

    ``images``: key, box (struct south, west, north, east). ``polygons``: key, ring,
    certainty, category. Images without polygons get zeros.
    """
    p = polygons.join(images.select(key, "box"), key).withColumn("xy", G.ring_xy("ring"))
    sure = F.coalesce(F.col("certainty") >= cutoff, F.lit(False))
    names = {f"cat_{i}": c for i, c in enumerate(CATEGORIES)}
    p = p.withColumns({
        "any": F.lit(1), "sure": sure.cast("int"),
        **{n: F.coalesce((sure & F.lower("category").contains(c)).cast("int"), F.lit(0)) for n, c in names.items()}})
    layers = ["any", "sure", *names]
    area = exact_areas(p.select(key, "xy", "box", *layers), [key], layers, {n: ("any", [n]) for n in layers}, box="box")
    out = images.join(area, key, "left")
    whole = (F.col("box.east") - F.col("box.west")) * (F.col("box.north") - F.col("box.south"))

    def pct(c):
        return F.coalesce(F.col(c) / whole * 100.0, F.lit(0.0))

    return out.select(
        *images.columns, pct("any").alias("percent_coverage"), pct("sure").alias("percent_coverage_hc"),
        *[pct(n).alias(f"percent_coverage_hc_{c}") for n, c in names.items()])


def box_overlaps(images: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """Every polygon with whether it touches its site box."""
    p = polygons.join(images.select(key, "box"), key)
    b = F.col("box")
    return p.withColumn("overlaps", G.overlaps_box(G.ring_xy("ring"), b["west"], b["south"], b["east"], b["north"])).drop("box")


def match_areas(matches: DataFrame, polygons: DataFrame, reference: str, keys: Sequence[str] = ("comp_op", "site_id", "gt_date", "comp_date")) -> DataFrame:
    """Truth, guess, intersection and union area of every match, all labelers in one pass. Exact, in square degrees."""
    p = polygons.select("site_id", "image_date", "operator_initials", G.ring_xy("ring").alias("xy"))
    gt = matches.join(p.filter(F.col("operator_initials") == reference).withColumnRenamed("image_date", "gt_date").drop("operator_initials"), ["site_id", "gt_date"])
    comp = matches.join(p.withColumnsRenamed({"image_date": "comp_date", "operator_initials": "comp_op"}), ["site_id", "comp_date", "comp_op"])
    both = gt.select(*keys, "xy", F.lit(1).alias("gt"), F.lit(0).alias("comp")).unionByName(comp.select(*keys, "xy", F.lit(0).alias("gt"), F.lit(1).alias("comp")))
    areas = exact_areas(both, keys, ["gt", "comp"], {
        "gt_area": ("any", ["gt"]), "comp_area": ("any", ["comp"]), "intersection_area": ("all", ["gt", "comp"]), "union_area": ("any", ["gt", "comp"])})
    return matches.join(areas, list(keys), "left").fillna(0.0, ["gt_area", "comp_area", "intersection_area", "union_area"])


def to_grid(rings: DataFrame, ring: str, grid: str) -> DataFrame:
    """Metre ring (x, y) to pixel units of its image grid: column right, row down."""
    g = F.col(grid)
    return rings.withColumn("xy", F.transform(ring, lambda p: F.struct(
        ((p["x"] - g["x0"]) / g["cell"]).alias("x"), ((g["y0"] - p["y"]) / g["cell"]).alias("y"))))


def burn(rings: DataFrame, height: int, width: int, xy: str = "xy") -> DataFrame:
    """Pixels whose centre lies in each ring: one row per ring and pixel."""
    s = scan_lines(rings, xy, 0.0, 1.0, height)
    s = s.withColumns({"__c0": F.greatest(F.lit(0), F.ceil(F.col("xa") - 0.5).cast("int")),
                       "__c1": F.least(F.lit(width - 1), (F.ceil(F.col("xb") - 0.5) - 1).cast("int"))}).drop("xa", "xb")
    cells = F.when(F.col("__c0") <= F.col("__c1"), F.sequence("__c0", "__c1"))
    return s.withColumn("col", F.explode_outer(cells)).filter(F.col("col").isNotNull()).drop("__c0", "__c1")


def coverage_percent(rings: DataFrame, keys: Sequence[str], height: int, width: int, fine: int = 10, xy: str = "xy") -> DataFrame:
    """Percent of each pixel under the union of its rings, from fine x fine sub-cells, whole percents.

    Rings are shuffled, sub-cells stay runs inside a task (``ring_pixels``).
    """
    s = ring_pixels(rings, keys, height, width, fine, F.lit(True), xy=xy)
    return s.select(*keys, "row", "col", F.expr(f"n * 100 div {fine * fine}").cast("int").alias("coverage"), (F.col("n") * 2 >= fine * fine).alias("half"))


def category_code(category: str = "category") -> Column:
    """Code of the first category in the list; empty and unknown ones count as small-scale."""
    first = F.element_at(F.split(F.coalesce(category, F.lit("")), ";"), 1)
    out = F.lit(1)
    for name, code in CATEGORY_CODES.items():
        out = F.when(first == name, code).otherwise(out)
    return out


def label_pixels(rings: DataFrame, keys: Sequence[str], height: int, width: int, cutoff: int = 3, fine: int = 10) -> DataFrame:
    """The nine label columns of every touched pixel.

    ``rings``: keys, poly_order, xy (pixel units), certainty, category,
    uncertainty_explanation. A later ring overwrites an earlier one. A pixel is
    irrigated from half coverage on, its category also needs the pixel centre.
    """
    sure = F.col("certainty") >= cutoff
    px = ring_pixels(
        rings, keys, height, width, fine, sure, F.col("poly_order"), [F.when(F.col("certainty") > 0, F.col("certainty")), F.when(sure, category_code())],
        [F.col("uncertainty_explanation").contains(p) for p in FLAG_PHRASES.values()])
    half = F.col("n") * 2 >= fine * fine

    def num(c):
        return F.coalesce(c, F.lit(0)).cast("int")

    return px.select(
        *keys, "row", "col", num(F.when(half, F.col("mark_1"))).alias("category"), half.cast("int").alias("irrigated"),
        *[F.col(f"flag_{i}").alias(n) for i, n in enumerate(FLAG_PHRASES)], num(F.col("mark_0")).alias("certainty"), F.expr(f"n * 100 div {fine * fine}").cast("int").alias("coverage"))


LABEL_COLUMNS = ["category", "irrigated", *FLAG_PHRASES, "certainty", "coverage"]


def label_rasters(touched: DataFrame, pairs: DataFrame, height: int, width: int, keys: Sequence[str] = ("file_id", "operator")) -> DataFrame:
    """Full grids of every (file, labeler) pair, zeros where nothing was drawn."""
    from .raster import full_grid

    g = full_grid(pairs, height, width, keys)
    return g.join(touched, [*keys, "row", "col"], "left").fillna(0, LABEL_COLUMNS)


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def zone_cells(zones: DataFrame, cell: float = 0.25, most: int = 8, deepest: int = 10) -> tuple[DataFrame, list[DataFrame]]:
    """Zones repeated into the cells that their bounding box meets (level, cx, cy), and for each level the cells that are split.

    Cells of ``cell`` degrees are level 0. A cell that more than ``most`` zones meet is split into four of half its size, as long as that leaves fewer zones in some of them, down to
    level ``deepest``: a tree that is deep only where zones are dense. One small count a level goes to the driver.
    """
    xs, ys = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    box = F.struct(F.array_min(xs).alias("w"), F.array_min(ys).alias("s"), F.array_max(xs).alias("e"), F.array_max(ys).alias("n"))
    boxed = zones.withColumn("xy", G.ring_xy("ring")).withColumn("__b", box)
    level = boxed.withColumn("cx", F.explode(_cells(F.col("__b.w"), F.col("__b.e"), cell))).withColumn("cy", F.explode(_cells(F.col("__b.s"), F.col("__b.n"), cell)))
    leaves, splits, size = [], [], cell
    for depth in range(deepest + 1):
        level = settled(level)
        full = level.groupBy("cx", "cy").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("cx", "cy")
        full = settled(full) if depth < deepest else full.limit(0)
        if full.isEmpty():
            leaves.append(level.withColumn("level", F.lit(depth)))
            break
        leaves.append(level.join(full, ["cx", "cy"], "left_anti").withColumn("level", F.lit(depth)))
        splits.append(full)
        size /= 2

        def half(c: str, low: str, high: str, size=size):
            """The one or two halves of a cell that the zone meets."""
            return F.sequence(F.greatest(F.col(c) * 2, F.floor(F.col("__b")[low] / size)), F.least(F.col(c) * 2 + 1, F.floor(F.col("__b")[high] / size)))

        level = level.join(full, ["cx", "cy"]).withColumns({"__x": half("cx", "w", "e"), "__y": half("cy", "s", "n")})
        level = level.withColumn("cx", F.explode("__x")).withColumn("cy", F.explode("__y")).drop("__x", "__y")
    return reduce(DataFrame.unionByName, leaves).drop("__b"), splits


def join_zones(points: DataFrame, zones: DataFrame, lon: str, lat: str, columns: Sequence[str], cell: float = 0.25, most: int = 8) -> DataFrame:
    """Zone columns of every point, NULL outside all zones.

    The join is an equality on cells, small ones where zones are dense (``zone_cells``), so a point is tested against few zones wherever it lies; the exact ring test is the join's extra
    condition. Which cell holds a point follows from the split cells alone, level by level; they are fewer than the zones.
    """
    z, splits = zone_cells(zones, cell, most)
    z = z.select("level", "cx", "cy", "xy", *columns)
    p = points.withColumn("__level", F.lit(0))
    for depth, full in enumerate(splits):
        at = [F.floor(F.col(c) / (cell / 2**depth)) for c in (lon, lat)]
        named = full.select(F.col("cx").alias("__sx"), F.col("cy").alias("__sy"), F.lit(True).alias("__split"))
        p = p.join(named, (at[0] == F.col("__sx")) & (at[1] == F.col("__sy")) & (F.col("__level") == depth), "left")
        p = p.withColumn("__level", F.when(F.col("__split"), depth + 1).otherwise(F.col("__level"))).drop("__sx", "__sy", "__split")
    size = F.lit(cell) / F.pow(F.lit(2.0), F.col("__level"))
    p = p.withColumns({"__cx": F.floor(F.col(lon) / size), "__cy": F.floor(F.col(lat) / size)})
    cond = (p["__level"] == z["level"]) & (p["__cx"] == z["cx"]) & (p["__cy"] == z["cy"]) & G.contains(z["xy"], p[lon], p[lat])
    return p.join(z, cond, "left").drop("__level", "__cx", "__cy", "level", "cx", "cy", "xy")


def footprint_share(rows: DataFrame, ring: str = "footprint", box: str = "box") -> Column:
    """Percent of a box inside a footprint ring, exactly: the ring is clipped by the four sides of the box, within the row.

    Rings do not cross themselves. A missing footprint covers the box.
    """
    b = F.col(box)
    part = G.clipped_to_box(G.ring_xy(ring), b["west"], b["south"], b["east"], b["north"])
    area = G.bind(part, lambda r: F.when(F.size(r) > 2, G.shoelace(r)).otherwise(0.0))
    return F.when(F.col(ring).isNull(), F.lit(100.0)).otherwise(area / ((b["east"] - b["west"]) * (b["north"] - b["south"])) * 100.0)
