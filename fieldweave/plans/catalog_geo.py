"""Registered queries: earth geometry, rings, label pixels, zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import agreement as A
from ..operators import geometry as GE
from ..operators import raster as RA
from .catalog_labels import match_sql, points, rounded
from .registry import IMAGES_SQL, POLYGONS_SQL, images, polygons, query, table

PTS_SQL = "pts AS (SELECT c_custkey, 22 + (c_custkey % 1100) / 100.0::DOUBLE AS x, -18 + (c_custkey * 7 % 1000) / 100.0::DOUBLE AS y FROM customer)"


@query("G1_geodesic_box", "WITH " + PTS_SQL + f""", u AS (SELECT *, radians(y) AS phi, 1 - {G.E2!r} * sin(radians(y)) ** 2 AS w FROM pts),
m AS (SELECT *, {G.A!r} * (1 - {G.E2!r}) / (w * sqrt(w)) AS rm, {G.A!r} / sqrt(w) AS rn FROM u)
SELECT c_custkey, round(degrees(phi - 500 / rm - (500 / rm) ** 2 * 1.5 * {G.E2!r} * sin(phi) * cos(phi) / w), 9) AS south, round(x - degrees(500 / rn / cos(phi) * (1 - (500 / rn * tan(phi)) ** 2 / 3)), 9) AS west,
 round(degrees(phi + 500 / rm - (500 / rm) ** 2 * 1.5 * {G.E2!r} * sin(phi) * cos(phi) / w), 9) AS north, round(x + degrees(500 / rn / cos(phi) * (1 - (500 / rn * tan(phi)) ** 2 / 3)), 9) AS east FROM m""")
def _(spark, d):
    return rounded(points(spark, d).withColumn("b", G.geodesic_box("y", "x")).select("c_custkey", "b.*"), 9)


@query("G2_box_ring", "WITH " + PTS_SQL + """ SELECT c_custkey, '{"type":"Polygon","coordinates":[[[' || string_agg(CAST(px AS VARCHAR) || ',' || CAST(py AS VARCHAR), '],[' ORDER BY k) || ']]]}' AS aoi
 FROM (SELECT c_custkey, k, CASE WHEN k IN (1, 2) THEN x::DOUBLE + 0.5 ELSE x::DOUBLE - 0.5 END AS px, CASE WHEN k IN (2, 3) THEN y::DOUBLE + 0.5 ELSE y::DOUBLE - 0.5 END AS py FROM (SELECT c_custkey, floor(x) AS x, floor(y) AS y FROM pts), (SELECT unnest(range(0, 5)) AS k)) GROUP BY c_custkey""")
def _(spark, d):
    p = points(spark, d).withColumns({"x": F.floor("x").cast("double"), "y": F.floor("y").cast("double")})
    b = F.struct((F.col("y") - 0.5).alias("south"), (F.col("x") - 0.5).alias("west"), (F.col("y") + 0.5).alias("north"), (F.col("x") + 0.5).alias("east"))
    return p.withColumn("b", b).select("c_custkey", G.ring_geojson(G.box_ring("b")).alias("aoi"))


@query("G3_utm_zone", "WITH " + PTS_SQL + " SELECT c_custkey, CAST(floor((x + 180) / 6) + 1 AS INTEGER) AS zone, CAST(CASE WHEN y >= 0 THEN 32600 ELSE 32700 END + floor((x + 180) / 6) + 1 AS INTEGER) AS epsg FROM pts")
def _(spark, d):
    return points(spark, d).select("c_custkey", G.utm_zone("x").alias("zone"), G.utm_epsg("x", "y").alias("epsg"))


def _utm_sql():
    f = " + ".join(f"({a!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(G._FWD, 1))
    g = " + ".join(f"({a!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(G._FWD, 1))
    return PTS_SQL + f""", z AS (SELECT *, floor((x + 180) / 6) + 1 AS zone, sin(radians(y)) AS sp FROM pts), q AS (SELECT *, radians(x - (zone * 6 - 183)) AS dl, atanh(sp) - {G._ECC!r} * atanh({G._ECC!r} * sp) AS psi FROM z),
 r AS (SELECT *, atan2((exp(psi) - exp(-psi)) / 2, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + ((exp(psi) - exp(-psi)) / 2) ** 2)) AS eta FROM q),
 utm AS (SELECT c_custkey, x, y, {G.K0 * G._RECT!r} * (eta + {f}) + 500000 AS e, {G.K0 * G._RECT!r} * (xi + {g}) + CASE WHEN y < 0 THEN 10000000 ELSE 0 END AS n FROM r)"""


@query("G4_utm_round_trip", "WITH " + _utm_sql() + " SELECT c_custkey, round(e, 3) AS e, round(n, 3) AS n, round(x, 9) AS lon, round(y, 9) AS lat FROM utm")
def _(spark, d):
    p = points(spark, d)
    zone, south = G.utm_zone("x"), F.col("y") < 0
    e, n = G.to_utm("x", "y", zone, south)
    u = p.select("c_custkey", e.alias("e"), n.alias("n"), zone.alias("zone"), south.alias("south"))
    lon, lat = G.from_utm("e", "n", F.col("zone"), F.col("south"))
    return u.select("c_custkey", F.round("e", 3).alias("e"), F.round("n", 3).alias("n"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


def _box_sql():
    """Both corners of a box of 1,000 m, back to degrees by the inverse series."""
    back = lambda f, g: " + ".join(f"({b!r}) * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, b in enumerate(G._INV, 1))
    lat = " + ".join(f"({d!r}) * sin({2 * j} * chi)" for j, d in enumerate(G._LAT, 1))
    scale = G.K0 * G._RECT
    return _utm_sql() + f""", c AS (SELECT c_custkey, x AS lon0, y AS lat0, k, (e + k * 500.0 - 500000) / {scale!r} AS eta, (n + k * 500.0 - CASE WHEN y < 0 THEN 10000000 ELSE 0 END) / {scale!r} AS xi FROM utm, (SELECT unnest([-1, 1]) AS k)),
 d AS (SELECT c_custkey, k, floor((lon0 + 180) / 6) + 1 AS zone, xi - ({back('sin', 'cosh')}) AS xi2, eta - ({back('cos', 'sinh')}) AS eta2 FROM c),
 f AS (SELECT *, asin(sin(xi2) / cosh(eta2)) AS chi FROM d),
 g AS (SELECT c_custkey, k, degrees(atan2((exp(eta2) - exp(-eta2)) / 2, cos(xi2))) + zone * 6 - 183 AS lon, degrees(chi + {lat}) AS lat FROM f)"""


@query("G4_metric_box", "WITH " + _box_sql() + " SELECT c_custkey, round(max(lon) FILTER (k = -1), 8) AS minx, round(max(lat) FILTER (k = -1), 8) AS miny, round(max(lon) FILTER (k = 1), 8) AS maxx, round(max(lat) FILTER (k = 1), 8) AS maxy FROM g GROUP BY 1")
def _(spark, d):
    return rounded(points(spark, d).withColumn("b", G.metric_box("x", "y")).select("c_custkey", "b.*"), 8)


@query("G13_centred_grid", "WITH " + _utm_sql() + " SELECT c_custkey, round(e - 501, 3) AS x0, round(n + 501, 3) AS y0, 3.0::DOUBLE AS cell, CAST(334 AS INTEGER) AS height, CAST(334 AS INTEGER) AS width FROM utm")
def _(spark, d):
    return rounded(points(spark, d).withColumn("g", G.centred_grid("x", "y")).select("c_custkey", "g.*"), 3)


# --- rings: a triangle per lineitem -------------------------------------------

TRI_SQL = """
tri AS (SELECT CAST(l_suppkey AS VARCHAR) AS file_id, l_returnflag AS operator, row_number() OVER () AS rid, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS poly_order, CAST(l_linenumber % 5 + 1 AS INTEGER) AS certainty, CAST(l_partkey % 5 + 1 AS INTEGER) AS cat,
  CAST(l_partkey % 3 AS INTEGER) AS u, (l_orderkey * 37 % 9700) / 100.0::DOUBLE + 0.013101597 AS x1, (l_partkey * 53 % 9700) / 100.0::DOUBLE + 0.017227131 AS y1, l_linenumber * 0.43 + 0.61 AS w, l_quantity * 0.05 + 0.37 AS h FROM lineitem),
t3 AS (SELECT *, x1 + w AS x2, y1 + h * 0.3 AS y2, x1 + w * 0.4 AS x3, y1 + h AS y3 FROM tri)
"""


def triangles(spark, d):
    k = F.col
    t = table(spark, d, "lineitem").select(
        k("l_suppkey").cast("string").alias("file_id"), k("l_returnflag").alias("operator"),
        (k("l_orderkey") * 1000000 + k("l_linenumber") * 100000 + k("l_partkey")).alias("poly_order"),
        (k("l_linenumber") % 5 + 1).cast("int").alias("certainty"),
        F.element_at(F.array(*[F.lit(c) for c in GE.CATEGORY_CODES]), (k("l_partkey") % 5 + 1).cast("int")).alias("category"),
        F.when(k("l_partkey") % 3 == 1, "uneven").when(k("l_partkey") % 3 == 2, "only slightly green;uneven").alias("uncertainty_explanation"),
        ((k("l_orderkey") * 37 % 9700) / 100.0 + 0.013101597).alias("x"), ((k("l_partkey") * 53 % 9700) / 100.0 + 0.017227131).alias("y"),
        (k("l_linenumber") * 0.43 + 0.61).alias("w"), (k("l_quantity") * 0.05 + 0.37).alias("h"))
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    xy = F.array(p(k("x"), k("y")), p(k("x") + k("w"), k("y") + k("h") * 0.3), p(k("x") + k("w") * 0.4, k("y") + k("h")), p(k("x"), k("y")))
    return t.withColumn("xy", xy).drop("x", "y", "w", "h")


def _inside(px, py):
    side = lambda a, b: f"((x{b} - x{a}) * ({py} - y{a}) - (y{b} - y{a}) * ({px} - x{a}) > 0)"
    return f"{side(1, 2)} AND {side(2, 3)} AND {side(3, 1)}"


CELLS_SQL = TRI_SQL + f""", ce AS (SELECT t3.*, CAST(floor(y1) + dr AS INTEGER) AS row, CAST(floor(x1) + dc AS INTEGER) AS col FROM t3, (SELECT unnest(range(0, 5)) AS dr), (SELECT unnest(range(0, 6)) AS dc)),
hit AS (SELECT * FROM ce WHERE row BETWEEN 0 AND 99 AND col BETWEEN 0 AND 99 AND {_inside('col + 0.5', 'row + 0.5')})"""


@query("G5_ring_area", "WITH " + TRI_SQL + " SELECT poly_order, file_id, operator, round(abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2, 6) AS area FROM t3")
def _(spark, d):
    return rounded(triangles(spark, d).select("poly_order", "file_id", "operator", G.shoelace("xy").alias("area")))


def _ring_utm_sql():
    f = " + ".join(f"({a!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(G._FWD, 1))
    g = " + ".join(f"({a!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(G._FWD, 1))
    return TRI_SQL + f""", v AS (SELECT rid, poly_order, file_id, operator, unnest([1, 2, 3]) AS k, unnest([x1, x2, x3]) AS x, unnest([y1, y2, y3]) AS y FROM t3),
 z AS (SELECT *, sin(radians(-15.0 + y / 1000.0)) AS sp, radians(27.0 + x / 1000.0 - ({G.AREA_ZONE} * 6 - 183)) AS dl FROM v), q AS (SELECT *, atanh(sp) - {G._ECC!r} * atanh({G._ECC!r} * sp) AS psi FROM z),
 r AS (SELECT *, atan2((exp(psi) - exp(-psi)) / 2, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + ((exp(psi) - exp(-psi)) / 2) ** 2)) AS eta FROM q),
 m AS (SELECT rid, poly_order, file_id, operator, k, {G.K0 * G._RECT!r} * (eta + {f}) AS e, {G.K0 * G._RECT!r} * (xi + {g}) AS n FROM r),
 w AS (SELECT a.poly_order, a.file_id, a.operator, b.e - a.e AS e2, b.n - a.n AS n2, c.e - a.e AS e3, c.n - a.n AS n3 FROM m a JOIN m b ON a.rid = b.rid AND b.k = 2 JOIN m c ON a.rid = c.rid AND c.k = 3 WHERE a.k = 1)"""


@query("G5_ring_area_m2", "WITH " + _ring_utm_sql() + " SELECT poly_order, file_id, operator, round(abs(e2 * n3 - e3 * n2) / 2, 1) AS area_m2 FROM w")
def _(spark, d):
    ring = F.transform("xy", lambda p: G.point(F.lit(27.0) + p["x"] / 1000.0, F.lit(-15.0) + p["y"] / 1000.0))
    return rounded(triangles(spark, d).select("poly_order", "file_id", "operator", G.shoelace(G.ring_to_utm(ring)).alias("area_m2")), 1)


@query("G9_burn_rings", "WITH " + CELLS_SQL + " SELECT file_id, row, col, max_by(certainty, poly_order) AS certainty, count(*) AS n FROM hit GROUP BY 1, 2, 3")
def _(spark, d):
    px = GE.burn(triangles(spark, d).select("file_id", "poly_order", "certainty", "xy"), 100, 100)
    return px.groupBy("file_id", "row", "col").agg(F.max_by("certainty", "poly_order").alias("certainty"), F.count("*").alias("n"))


def _cov_sql(where):
    return f""", fi AS (SELECT t3.*, CAST(floor(y1 * 10) + dr AS INTEGER) AS fr, CAST(floor(x1 * 10) + dc AS INTEGER) AS fc FROM t3, (SELECT unnest(range(0, 31)) AS dr), (SELECT unnest(range(0, 38)) AS dc) WHERE {where}),
fh AS (SELECT DISTINCT file_id, operator, fr, fc FROM fi WHERE fr BETWEEN 0 AND 999 AND fc BETWEEN 0 AND 999 AND {_inside('(fc + 0.5) / 10.0::DOUBLE', '(fr + 0.5) / 10.0::DOUBLE')}),
cov AS (SELECT file_id, operator, fr // 10 AS row, fc // 10 AS col, count(*) AS n FROM fh GROUP BY 1, 2, 3, 4)"""


@query("G10_coverage_percent", "WITH " + TRI_SQL + _cov_sql("true") + " SELECT file_id, operator, CAST(n AS INTEGER) AS coverage, n >= 50 AS half, count(*) AS pixels, CAST(sum(row) AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols FROM cov GROUP BY 1, 2, 3, 4")
def _(spark, d):
    c = GE.coverage_percent(triangles(spark, d), ["file_id", "operator"], 100, 100)
    return c.groupBy("file_id", "operator", "coverage", "half").agg(F.count("*").alias("pixels"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


@query("G11_label_pixels", "WITH " + CELLS_SQL + _cov_sql("certainty >= 3") + """, ctr AS (SELECT file_id, operator, row, col, max_by(certainty, poly_order) AS cert, max_by(cat, poly_order) FILTER (certainty >= 3) AS cat, max(CAST(u = 2 AS INTEGER)) AS sg, max(CAST(u >= 1 AS INTEGER)) AS un FROM hit GROUP BY 1, 2, 3, 4),
j AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.operator, b.operator) AS operator, coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, cert, cat, sg, un, n FROM ctr a FULL JOIN cov b ON a.file_id = b.file_id AND a.operator = b.operator AND a.row = b.row AND a.col = b.col)
SELECT file_id, operator, count(*) AS pixels, CAST(sum(row) AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols, CAST(CASE WHEN n >= 50 THEN coalesce(cat, 0) ELSE 0 END AS INTEGER) AS category, CAST(coalesce(n >= 50, false) AS INTEGER) AS irrigated, CAST(0 AS INTEGER) AS unclear, coalesce(sg, 0) AS slightly_green, coalesce(un, 0) AS uneven,
 CAST(0 AS INTEGER) AS natural, CAST(0 AS INTEGER) AS fishpond, coalesce(cert, 0) AS certainty, CAST(coalesce(n, 0) AS INTEGER) AS coverage FROM j GROUP BY ALL""")
def _(spark, d):
    px = GE.label_pixels(triangles(spark, d), ["file_id", "operator"], 100, 100)
    return px.groupBy("file_id", "operator", *GE.LABEL_COLUMNS).agg(F.count("*").alias("pixels"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


@query("G12_cropland_share", "WITH " + TRI_SQL + ", p AS (SELECT x1 * 30 AS x, y1 * 30 AS y, cat FROM tri) SELECT CAST(floor(x / 1000) AS BIGINT) AS cx, CAST(floor(y / 1000) AS BIGINT) AS cy, round(avg(CAST(cat = 2 AS INTEGER)), 6) AS agriculture, count(*) AS n, (floor(x / 1000) + 0.5) * 1000 AS x, (floor(y / 1000) + 0.5) * 1000 AS y FROM p GROUP BY ALL")
def _(spark, d):
    k = F.col
    px = table(spark, d, "lineitem").select(
        (((k("l_orderkey") * 37 % 9700) / 100.0 + 0.013101597) * 30).alias("px"), (((k("l_partkey") * 53 % 9700) / 100.0 + 0.017227131) * 30).alias("py"), (k("l_partkey") % 5 + 1).alias("cls"))
    return rounded(RA.class_share_grid(px, "cls", 2, F.col("px"), F.col("py"), 1000.0))


# rectangles per polygon, so that unions and intersections can be counted on whole cells

RECT_SQL = POLYGONS_SQL + """, rc AS (SELECT *, CAST(l_partkey * 7 % 40 AS INTEGER) AS gx, CAST(l_partkey * 11 % 40 AS INTEGER) AS gy, CAST(l_quantity AS INTEGER) % 9 + 2 AS gw, poly_order + 2 AS gh FROM polygons)"""


def rectangles(spark, d):
    p = polygons(spark, d)
    k = F.col
    p = p.withColumns({
        "gx": (k("l_partkey") * 7 % 40).cast("int"), "gy": (k("l_partkey") * 11 % 40).cast("int"),
        "gw": k("l_quantity").cast("int") % 9 + 2, "gh": k("poly_order") + 2})
    x0, y0 = k("gx") * 0.001, k("gy") * 0.001
    x1, y1 = (k("gx") + k("gw")) * 0.001, (k("gy") + k("gh")) * 0.001
    return p.withColumn("ring", F.array(G.point(x0, y0), G.point(x1, y0), G.point(x1, y1), G.point(x0, y1), G.point(x0, y0)))


@query("G6_site_coverage", "WITH " + RECT_SQL + """, ce AS (SELECT unique_id, certainty, category, gx + dx AS cx, gy + dy AS cy FROM rc, (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS dx), (SELECT CAST(unnest(range(0, 9)) AS INTEGER) AS dy) WHERE dx < gw AND dy < gh AND gx + dx < 40 AND gy + dy < 40),
c AS (SELECT unique_id, count(DISTINCT (cx, cy)) AS a, count(DISTINCT (cx, cy)) FILTER (certainty >= 3) AS h, count(DISTINCT (cx, cy)) FILTER (certainty >= 3 AND category = 'lawn') AS l FROM ce GROUP BY 1)
SELECT i.unique_id, round(coalesce(a, 0) / 1600.0::DOUBLE * 100, 6) AS percent_coverage, round(coalesce(h, 0) / 1600.0::DOUBLE * 100, 6) AS percent_coverage_hc, round(coalesce(l, 0) / 1600.0::DOUBLE * 100, 6) AS percent_coverage_hc_lawn FROM images i LEFT JOIN c USING (unique_id)""")
def _(spark, d):
    box = F.struct(F.lit(0.0).alias("south"), F.lit(0.0).alias("west"), F.lit(0.04).alias("north"), F.lit(0.04).alias("east"))
    im = images(spark, d).select("unique_id", box.alias("box"))
    c = GE.site_coverage(im, rectangles(spark, d).select("unique_id", "ring", "certainty", "category"), "unique_id")
    return rounded(c.select("unique_id", "percent_coverage", "percent_coverage_hc", "percent_coverage_hc_lawn"))


# Two right triangles of a site lean against each other; the second one is shifted, so that they meet in a triangle of their own slants.
LEAN_SQL = "lean AS (SELECT o_orderkey AS k, (o_custkey % 90 + 10) / 1017.0::DOUBLE AS a, (o_orderkey % 10) / 10.0::DOUBLE AS f FROM orders), part AS (SELECT *, a * a / 2 AS one, (a - a * f) * (a - a * f) / 4 AS met FROM lean)"


def leaning(spark, d):
    a, f = (F.col("o_custkey") % 90 + 10) / 1017.0, (F.col("o_orderkey") % 10) / 10.0
    zero = F.lit(0.0)
    first = F.array(G.point(zero, zero), G.point(a, zero), G.point(zero, a), G.point(zero, zero))
    second = F.array(G.point(a * f, zero), G.point(a * f + a, zero), G.point(a * f + a, a), G.point(a * f, zero))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), first.alias("first"), second.alias("second"))


@query("G6_slanted_coverage", "WITH " + LEAN_SQL + " SELECT k, round((2 * one - met) / 0.02 * 100, 6) AS percent_coverage, round(one / 0.02 * 100, 6) AS percent_coverage_hc FROM part")
def _(spark, d):
    box = F.struct(F.lit(0.0).alias("south"), F.lit(0.0).alias("west"), F.lit(0.1).alias("north"), F.lit(0.2).alias("east"))
    t = leaning(spark, d)
    rings = t.select("k", F.explode(F.array(F.struct(F.col("first").alias("ring"), F.lit(4).alias("certainty")), F.struct(F.col("second").alias("ring"), F.lit(1).alias("certainty")))).alias("r"))
    c = GE.site_coverage(t.select("k", box.alias("box")), rings.select("k", "r.*", F.lit("lawn").alias("category")), "k")
    return rounded(c.select("k", "percent_coverage", "percent_coverage_hc"))


@query("A3_slanted_areas", "WITH " + LEAN_SQL + " SELECT k, round(one * 10000, 6) AS gt_area, round(one * 10000, 6) AS comp_area, round(met * 10000, 6) AS intersection_area, round((2 * one - met) * 10000, 6) AS union_area FROM part")
def _(spark, d):
    t = leaning(spark, d)
    day = F.lit("2021-01-01").cast("date")
    matches = t.select(F.lit("JL").alias("comp_op"), F.col("k").alias("site_id"), day.alias("gt_date"), day.alias("comp_date"))
    drawn = t.select(F.col("k").alias("site_id"), day.alias("image_date"), F.explode(F.array(F.struct(F.lit("KL").alias("operator_initials"), F.col("first").alias("ring")), F.struct(F.lit("JL").alias("operator_initials"), F.col("second").alias("ring")))).alias("r"))
    areas = GE.match_areas(matches, drawn.select("site_id", "image_date", "r.*"), "KL")
    names = ["gt_area", "comp_area", "intersection_area", "union_area"]
    return rounded(areas.select(F.col("site_id").alias("k"), *[(F.col(c) * 10000).alias(c) for c in names]))


@query("G7_box_overlap", "WITH " + RECT_SQL + " SELECT unique_id, poly_order, l_partkey, gx <= 20 AND gx + gw >= 10 AND gy <= 25 AND gy + gh >= 12 AS overlaps FROM rc")
def _(spark, d):
    box = F.struct(F.lit(0.012).alias("south"), F.lit(0.01).alias("west"), F.lit(0.025).alias("north"), F.lit(0.02).alias("east"))
    im = images(spark, d).select("unique_id", box.alias("box"))
    return GE.box_overlaps(im, rectangles(spark, d), "unique_id").select("unique_id", "poly_order", "l_partkey", "overlaps")


AREA_SQL = RECT_SQL + "," + match_sql(1) + """, ce AS (SELECT DISTINCT site_id, image_date, operator_initials AS op, gx + dx AS cx, gy + dy AS cy FROM rc, (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS dx), (SELECT CAST(unnest(range(0, 9)) AS INTEGER) AS dy) WHERE dx < gw AND dy < gh AND certainty >= 3),
g AS (SELECT comp_op, mm.site_id, gt_date, comp_date, cx, cy FROM mm JOIN ce ON ce.site_id = mm.site_id AND ce.image_date = gt_date AND ce.op = 'KL'), c AS (SELECT comp_op, mm.site_id, gt_date, comp_date, cx, cy FROM mm JOIN ce ON ce.site_id = mm.site_id AND ce.image_date = comp_date AND ce.op = comp_op),
u AS (SELECT comp_op, site_id, gt_date, comp_date, cx, cy, bool_or(k = 1) AS ig, bool_or(k = 2) AS ic FROM (SELECT *, 1 AS k FROM g UNION ALL SELECT *, 2 AS k FROM c) GROUP BY ALL),
ag AS (SELECT comp_op, site_id, gt_date, comp_date, count(*) FILTER (ig) AS a, count(*) FILTER (ic) AS b, count(*) FILTER (ig AND ic) AS i, count(*) AS n FROM u GROUP BY 1, 2, 3, 4)
"""


@query("A3_match_areas", "WITH " + AREA_SQL + """SELECT mm.comp_op, mm.site_id, mm.gt_date, mm.comp_date, round(coalesce(a, 0) * 1.0::DOUBLE, 4) AS gt_area, round(coalesce(b, 0) * 1.0::DOUBLE, 4) AS comp_area, round(coalesce(i, 0) * 1.0::DOUBLE, 4) AS intersection_area, round(coalesce(n, 0) * 1.0::DOUBLE, 4) AS union_area
FROM mm LEFT JOIN ag ON ag.comp_op = mm.comp_op AND ag.site_id = mm.site_id AND ag.gt_date = mm.gt_date AND ag.comp_date = mm.comp_date""")
def _(spark, d):
    m = A.nearest_date_matches(images(spark, d), "KL").drop("date_diff")
    a = GE.match_areas(m, rectangles(spark, d).filter("certainty >= 3"), "KL")
    return rounded(a.withColumns({c: F.col(c) * 1e6 for c in ("gt_area", "comp_area", "intersection_area", "union_area")}), 4)


ZONE_SQL = "zones AS (SELECT n_name, 22 + (n_nationkey % 5) * 2.2::DOUBLE AS x0, -18 + (n_nationkey // 5) * 2.0::DOUBLE AS y0 FROM nation)"


def zones(spark, d):
    k = F.col("n_nationkey")
    x0, y0 = 22 + (k % 5) * 2.2, -18 + F.expr("n_nationkey div 5") * 2.0
    pts = [(0.013, 0.007), (1.913, 0.007), (2.113, 1.907), (0.213, 1.907), (0.013, 0.007)]
    return table(spark, d, "nation").select("n_name", F.array(*[G.point(x0 + a, y0 + b) for a, b in pts]).alias("ring"))


@query("J7_zone_of_point", "WITH " + PTS_SQL + ", " + ZONE_SQL + """ SELECT c_custkey, n_name AS country FROM pts LEFT JOIN zones ON y > y0 + 0.007 AND y < y0 + 1.907 AND x > x0 + 0.013 + (y - y0 - 0.007) * 0.2 / 1.9 AND x < x0 + 1.913 + (y - y0 - 0.007) * 0.2 / 1.9""")
def _(spark, d):
    z = zones(spark, d).withColumnRenamed("n_name", "country")
    return GE.join_zones(points(spark, d), z, "x", "y", ["country"], 0.5).select("c_custkey", "country")


# Zones as dense as they come: beside each nation's zone a strip of narrow ones, a hundredth of a degree wide.
DENSE_SQL = "strips AS (SELECT n_nationkey * 100 + i AS zone, 22.5 + n_nationkey * 0.3 + i * 0.003 AS x0, 22.5 + n_nationkey * 0.3 + i * 0.003 + 0.003 AS x1 FROM nation, (SELECT unnest(range(0, 100)) AS i))"


@query("J7_dense_zones", "WITH " + DENSE_SQL + """, pts AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS part, 22.5005 + (CASE WHEN l_orderkey % 3 = 0 THEN 11 ELSE l_orderkey * 37 % 9000 END) / 1000.0::DOUBLE AS x, -17.0 + (l_partkey * 53 % 900) / 1000.0::DOUBLE AS y FROM lineitem)
SELECT k, n, part, zone FROM pts LEFT JOIN strips ON x > x0 AND x < x1 AND y > -16.8003 AND y < -16.2003""")
def _(spark, d):
    """A third of all points lie in one zone, and 2,500 zones in a few cells."""
    k, lit = F.col, F.lit
    i = F.explode(F.sequence(lit(0), lit(99)))
    strips = table(spark, d, "nation").select("n_nationkey", i.alias("i")).withColumn("x0", 22.5 + k("n_nationkey") * 0.3 + k("i") * 0.003)
    corners = [(0.0, -16.8003), (0.003, -16.8003), (0.003, -16.2003), (0.0, -16.2003), (0.0, -16.8003)]
    dense = strips.select((k("n_nationkey") * 100 + k("i")).cast("bigint").alias("zone"), F.array(*[G.point(k("x0") + a, lit(b)) for a, b in corners]).alias("ring"))
    x = 22.5005 + F.when(k("l_orderkey") % 3 == 0, 11).otherwise(k("l_orderkey") * 37 % 9000) / 1000.0
    pts = table(spark, d, "lineitem").select(k("l_orderkey").alias("k"), k("l_linenumber").alias("n"), k("l_partkey").alias("part"), x.alias("x"), (-17.0 + (k("l_partkey") * 53 % 900) / 1000.0).alias("y"))
    return GE.join_zones(pts, dense, "x", "y", ["zone"], 0.5).select("k", "n", "part", "zone")


@query("G8_footprint_share", """WITH f AS (SELECT event_id, (event_id % 13) / 10.0::DOUBLE - 0.3 AS fx, (event_id % 7) / 10.0::DOUBLE - 0.2 AS fy FROM events)
SELECT event_id, round(greatest(0, least(1, fx + 0.8) - greatest(0, fx)) * greatest(0, least(1, fy + 0.9) - greatest(0, fy)) * 100, 6) AS share FROM f""")
def _(spark, d):
    k = F.col("event_id")
    fx, fy = (k % 13) / 10.0 - 0.3, (k % 7) / 10.0 - 0.2
    ring = F.array(G.point(fx, fy), G.point(fx + 0.8, fy), G.point(fx + 0.8, fy + 0.9), G.point(fx, fy + 0.9), G.point(fx, fy))
    box = F.struct(F.lit(0.0).alias("south"), F.lit(0.0).alias("west"), F.lit(1.0).alias("north"), F.lit(1.0).alias("east"))
    e = table(spark, d, "events").select("event_id", ring.alias("footprint"), box.alias("box"))
    return rounded(e.select("event_id", GE.footprint_share(e).alias("share")))
