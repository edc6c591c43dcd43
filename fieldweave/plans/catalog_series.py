"""Registered queries: scenes, windows, pixels, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as SR
from ..functions import spectral as SP
from ..operators import raster as RA
from ..operators import scenes as S
from ..operators import stacks as ST
from ..operators import timeseries as TS
from .catalog_labels import rounded
from .registry import IMAGES_SQL, PIXELS_SQL, SCENES_SQL, SERIES_SQL, images, pixels, query, scenes, series, table

ANCHOR = "DATE '2024-01-10'"

# --- windows and scenes -------------------------------------------------------


@query("T1_year_windows", "WITH " + IMAGES_SQL + """, f AS (SELECT DISTINCT site_id, year, CAST(make_date(year, 1, 1) - INTERVAL 30 DAY AS DATE) AS d0 FROM images), t AS (SELECT CAST(unnest(range(0, 42)) AS INTEGER) AS t)
SELECT site_id, year, t, d0 + t * 10 AS start, d0 + t * 10 + 10 AS "end" FROM f, t""")
def _(spark, d):
    site_years = images(spark, d).select("site_id", "year", F.make_date("year", F.lit(7), F.lit(1)).alias("day")).distinct()
    return S.make_windows(site_years, "day").select("site_id", "year", "t", "start", "end")


@query("T1_centred_windows", "WITH " + IMAGES_SQL + """, f AS (SELECT site_id, operator_initials, min(image_date) - 210 AS d0 FROM images GROUP BY 1, 2), t AS (SELECT CAST(unnest(range(0, 42)) AS INTEGER) AS t)
SELECT site_id, operator_initials, t, CAST(d0 + t * 10 AS DATE) AS start, CAST(d0 + t * 10 + 10 AS DATE) AS "end" FROM f, t""")
def _(spark, d):
    first = images(spark, d).groupBy("site_id", "operator_initials").agg(F.min("image_date").alias("image_date"))
    return S.make_windows(first, "image_date", centred=True).select("site_id", "operator_initials", "t", "start", "end")


@query("J14_window_of_date", "WITH " + IMAGES_SQL + """, w AS (SELECT unique_id, date_diff('day', CAST(make_date(year, 3, 1) - INTERVAL 30 DAY AS DATE), image_date) AS n FROM images)
SELECT unique_id, CAST(CASE WHEN n >= 0 AND n < 420 THEN n // 10 ELSE 21 END AS INTEGER) AS step FROM w""")
def _(spark, d):
    first = S.first_window_day("image_date", start_month=3)
    return images(spark, d).select("unique_id", S.window_step("image_date", first).alias("step"))


STORED_SQL = SCENES_SQL + """, st AS (SELECT DISTINCT site, date_diff('day', DATE '2024-01-01', acquired) // 5 AS k FROM scenes),
win AS (SELECT site, CAST(k AS INTEGER) AS t, CAST(DATE '2024-01-01' + CAST(k * 5 AS INTEGER) AS DATE) AS start, CAST(DATE '2024-01-01' + CAST(k * 5 + CASE WHEN site % 2 = 0 THEN 5 ELSE 6 END AS INTEGER) AS DATE) AS "end" FROM st WHERE (site + k) % 4 <> 0),
lab AS (SELECT DISTINCT site, CAST(acquired + 1 AS DATE) AS labelled FROM scenes)
"""


def _stored(spark, d):
    s = scenes(spark, d)
    origin = F.lit("2024-01-01").cast("date")
    k = F.floor(F.datediff("acquired", origin) / 5).cast("int")
    st = s.select("site", k.alias("t")).distinct().filter((F.col("site") + F.col("t")) % 4 != 0)
    win = st.select("site", "t", F.date_add(origin, F.col("t") * 5).alias("start"),
                    F.date_add(origin, F.col("t") * 5 + F.when(F.col("site") % 2 == 0, 5).otherwise(6)).alias("end"))
    lab = s.select("site", F.date_add("acquired", 1).alias("labelled")).distinct()
    return win, lab


@query("J14_labelled_step_stored", "WITH " + STORED_SQL + """, h AS (SELECT lab.site, labelled, min(t) AS t FROM lab JOIN win ON lab.site = win.site AND start <= labelled AND labelled < "end" GROUP BY 1, 2)
SELECT lab.site, lab.labelled, CAST(coalesce(t, 21) AS INTEGER) AS step FROM lab LEFT JOIN h ON h.site = lab.site AND h.labelled = lab.labelled""")
def _(spark, d):
    win, lab = _stored(spark, d)
    return S.labelled_step(lab, win, "site", "labelled")


@query("J20_label_to_window_file", "WITH " + STORED_SQL + """, h AS (SELECT lab.site, labelled, count(*) AS n, min(t) AS t FROM lab JOIN win ON lab.site = win.site AND start <= labelled AND labelled < "end" GROUP BY 1, 2)
SELECT lab.site, lab.labelled, CASE WHEN n = 1 THEN t END AS t, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'several' ELSE 'none' END AS status FROM lab LEFT JOIN h ON h.site = lab.site AND h.labelled = lab.labelled""")
def _(spark, d):
    win, lab = _stored(spark, d)
    return S.label_to_window_file(lab, win, "site", "labelled")


BINNED_SQL = SCENES_SQL + ", b AS (SELECT *, CAST(date_diff('day', DATE '2023-12-02', acquired) // 10 AS INTEGER) AS t, clear_percent AS effective_coverage FROM scenes)"


def _binned(spark, d):
    first = F.lit("2023-12-02").cast("date")
    return scenes(spark, d).withColumns({"t": S.window_step("acquired", first), "effective_coverage": F.col("clear_percent")})


for _name, _order in (("good_pixels", "good_pixels DESC"), ("least_cloud", "coalesce(cloud_cover, 'Infinity'::DOUBLE)"), ("effective_coverage", "effective_coverage DESC")):
    def _make(key):
        def run(spark, d):
            return S.best_scene(_binned(spark, d), ["site", "t"], S.score_columns()[key]).select("site", "t", "scene_id", "acquired", "cloud_cover")
        return run
    query(f"R8_best_scene_{_name}", "WITH " + BINNED_SQL + f" SELECT site, t, scene_id, acquired, cloud_cover FROM (SELECT *, row_number() OVER (PARTITION BY site, t ORDER BY {_order}, scene_id) AS rn FROM b) WHERE rn = 1")(_make(_name))


@query("R9_anchor_scene", "WITH " + BINNED_SQL + """, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, t ORDER BY effective_coverage DESC, scene_id) AS rn FROM b) WHERE rn = 1)
SELECT site, scene_id AS anchor, effective_coverage AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY effective_coverage DESC, t) AS k FROM w) WHERE k = 1 AND effective_coverage > 0""")
def _(spark, d):
    best = S.best_scene(_binned(spark, d), ["site", "t"], S.score_columns()["effective_coverage"])
    return S.anchor_scene(best, "site")


@query("T2_filled_windows", "WITH " + BINNED_SQL + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, t ORDER BY good_pixels DESC, scene_id) AS rn FROM b) WHERE rn = 1),
g AS (SELECT DISTINCT site FROM scenes), t AS (SELECT CAST(unnest(range(0, 42)) AS INTEGER) AS t)
SELECT g.site, t.t, CAST(DATE '2023-12-02' + t.t * 10 AS DATE) AS start, scene_id, scene_id IS NOT NULL AS file_exists, CASE WHEN scene_id IS NULL THEN 1.0::DOUBLE ELSE clear_percent / 103.0 END AS masked_fraction
FROM g CROSS JOIN t LEFT JOIN best ON best.site = g.site AND best.t = t.t""")
def _(spark, d):
    b = _binned(spark, d)
    best = S.best_scene(b, ["site", "t"], S.score_columns()["good_pixels"]).withColumn("masked_fraction", F.col("clear_percent") / 103.0)
    sites = b.select("site").distinct().withColumn("d", F.lit("2024-01-10").cast("date"))
    return S.fill_windows(S.make_windows(sites, "d").select("site", "t", "start"), best.select("site", "t", "scene_id", "masked_fraction"), ["site"])


@query("T4_window_centres", "WITH " + STORED_SQL + """, c AS (SELECT site, t, CASE WHEN site % 3 = 0 THEN NULL ELSE start END AS start, "end" FROM win)
SELECT site, t, CASE WHEN start IS NULL THEN CAST(DATE '2024-01-15' + (t - 21) * 10 AS DATE) ELSE CAST(start + CAST(date_diff('day', start, "end") // 2 AS INTEGER) AS DATE) END AS centre FROM c""")
def _(spark, d):
    win, _ = _stored(spark, d)
    win = win.withColumns({"start": F.when(F.col("site") % 3 != 0, F.col("start")), "labelled": F.lit("2024-01-15").cast("date")})
    return S.window_centres(win, "labelled").select("site", "t", "centre")


@query("G8_effective_coverage", "WITH " + SCENES_SQL + """, f AS (SELECT scene_id, CASE WHEN scene_id % 7 = 0 THEN NULL ELSE (scene_id % 101)::DOUBLE END AS fp, CASE WHEN scene_id % 5 = 0 THEN NULL ELSE clear_percent END AS clr, CASE WHEN scene_id % 11 = 0 THEN NULL ELSE good_pixels::DOUBLE END AS fb FROM scenes)
SELECT scene_id, coalesce(fp, 100.0) AS footprint_coverage, coalesce(clr, fb, 0.0) AS aoi_clear_percent, round(CASE WHEN clr IS NULL THEN coalesce(fb, 0.0) ELSE coalesce(fp, 100.0) * clr / 100.0 END, 6) AS effective_coverage FROM f""")
def _(spark, d):
    k = F.col("scene_id")
    s = scenes(spark, d).select(
        k, F.when(k % 7 != 0, (k % 101).cast("double")).alias("footprint_coverage"), F.when(k % 5 != 0, F.col("clear_percent")).alias("aoi_clear_percent"),
        F.when(k % 11 != 0, F.col("good_pixels").cast("double")).alias("clear_percent"))
    return rounded(s.select("scene_id", *S.effective_coverage()))


# --- pixels -------------------------------------------------------------------

K = ["l_orderkey", "l_linenumber", "l_partkey"]
KS = "l_orderkey, l_linenumber, l_partkey"


@query("G16_class_mask", "WITH " + PIXELS_SQL + f" SELECT {KS}, CASE WHEN scl IN (4, 5, 6, 7, 11) THEN b4 END AS b4, CASE WHEN scl IN (4, 5, 6, 7, 11) THEN b8 END AS b8 FROM pixels")
def _(spark, d):
    return RA.mask_bands(pixels(spark, d), ["b4", "b8"], SP.good_by_class()).select(*K, "b4", "b8")


@query("G17_bit_mask", "WITH " + PIXELS_SQL + f" SELECT {KS}, (qa60 & 1024) <> 0 OR (qa60 & 2048) <> 0 AS bad FROM pixels")
def _(spark, d):
    return pixels(spark, d).select(*K, SP.bad_by_bits().alias("bad"))


CLOUD_SQL = PIXELS_SQL + """, s0 AS (SELECT *, b2 / 10000.0::DOUBLE AS b, b3 / 10000.0::DOUBLE AS g, b4 / 10000.0::DOUBLE AS r, b8 / 10000.0::DOUBLE AS n, b11 / 10000.0::DOUBLE AS s FROM pixels),
s1 AS (SELECT *, (b + g + r) / 3 AS m FROM s0), s2 AS (SELECT *, sqrt(((b - m) ** 2 + (g - m) ** 2 + (r - m) ** 2) / 3) AS sd FROM s1),
s3 AS (SELECT *, CASE WHEN m IS NULL OR s IS NULL THEN NULL ELSE 0.4 * least(greatest((m - 0.30) / 0.15, 0.0), 1.0) + 0.2 * least(greatest((s - 0.12) / 0.10, 0.0), 1.0) + 0.2 * least(greatest((b / (s + 1e-6) - 1.2) / 0.5, 0.0), 1.0)
  + 0.2 * (1 - least(greatest(sd / 0.06, 0.0), 1.0)) END AS score FROM s2)
"""


@query("G18_cloud_score", "WITH " + CLOUD_SQL + f" SELECT {KS}, round(score, 6) AS score, round(score, 9) > 0.4 AND (n - r) / (n + r + 1e-6) <= 0.55 AS cloud FROM s3 WHERE score IS NOT NULL AND n IS NOT NULL")
def _(spark, d):
    px = pixels(spark, d).filter("b2 is not null and b3 is not null and b4 is not null and b8 is not null and b11 is not null")
    return rounded(px.select(*K, SP.cloud_score().alias("score"), SP.is_cloud(0.4).alias("cloud")))


@query("G19_spread_bad_blocks", "WITH " + PIXELS_SQL + """, b AS (SELECT *, bool_or((qa60 & 1024) <> 0 AND b8 > 5000) OVER (PARTITION BY file_id, t, row // 33, col // 33) AS bad FROM pixels)
SELECT file_id, t, count(*) FILTER (NOT coalesce(bad, false)) AS good, count(*) AS n FROM b GROUP BY 1, 2""")
def _(spark, d):
    px = pixels(spark, d)
    bad = F.coalesce((F.getbit("qa60", F.lit(10)) != 0) & (F.col("b8") > 5000), F.lit(False))
    return RA.spread_bad(px, bad, ["file_id", "t"]).groupBy("file_id", "t").agg(F.count_if("good").alias("good"), F.count("*").alias("n"))


@query("G21_masked_fraction", "WITH " + PIXELS_SQL + " SELECT file_id, t, round(avg(CAST(b2 IS NULL OR b4 IS NULL OR b8 IS NULL AS INTEGER)), 6) AS masked_fraction FROM pixels GROUP BY 1, 2")
def _(spark, d):
    return rounded(RA.masked_fraction(pixels(spark, d), ["b2", "b4", "b8"], ["file_id", "t"]))


@query("G22_indices", "WITH " + PIXELS_SQL + f""" SELECT {KS}, round((b8 - b4) / (b8 + b4 + 1e-6), 9) AS ndvi, round((b8 - b11) / (b8 + b11 + 1e-6), 9) AS ndwi_swir, round((b3 - b8) / (b3 + b8 + 1e-6), 9) AS ndwi_green,
 CASE WHEN abs(2.5 * (b8 / 1e4 - b4 / 1e4) / (b8 / 1e4 + 6 * (b4 / 1e4) - 7.5 * (b2 / 1e4) + 1 + 1e-6)) < 100 THEN round(2.5 * (b8 / 1e4 - b4 / 1e4) / (b8 / 1e4 + 6 * (b4 / 1e4) - 7.5 * (b2 / 1e4) + 1 + 1e-6), 9) ELSE round(2.5 * (b8 / 1e4 - b4 / 1e4) / (b8 / 1e4 + 6 * (b4 / 1e4) - 7.5 * (b2 / 1e4) + 1 + 1e-6), 3) END AS evi_scaled,
 round(CASE WHEN b8 IS NULL OR b4 IS NULL OR b2 IS NULL THEN NULL ELSE least(greatest(2.5 * (b8 / 1e4 - b4 / 1e4) / (CASE WHEN abs(b8 / 1e4 + 6 * (b4 / 1e4) - 7.5 * (b2 / 1e4) + 1) < 1e-6 THEN 1e-6 ELSE b8 / 1e4 + 6 * (b4 / 1e4) - 7.5 * (b2 / 1e4) + 1 END), -1.0), 1.0) END, 9) AS evi_clipped
 FROM pixels""")
def _(spark, d):
    ev = F.when(F.abs("evi_scaled") < 100, F.round("evi_scaled", 9)).otherwise(F.round("evi_scaled", 3)).alias("evi_scaled")
    return rounded(RA.with_indices(pixels(spark, d)).select(*K, "ndvi", "ndwi_swir", "ndwi_green", ev,
                                                            F.when(F.col("b2").isNotNull() & F.col("b4").isNotNull() & F.col("b8").isNotNull(), F.col("evi_clipped")).alias("evi_clipped")), 9)


ND_SQL = PIXELS_SQL + ", nd AS (SELECT *, (b8 - b4) / (b8 + b4 + 1e-6) AS v FROM pixels)"


def _nd(spark, d):
    return pixels(spark, d).withColumn("ndvi", SP.ndvi())


_POOL = """, w AS (SELECT file_id, t, avg(v) AS full_mean, quantile_cont(v, 0.9) AS full_p90, max(v) AS full_max, avg(CASE WHEN v > 0.5 THEN 1.0 WHEN v IS NULL THEN NULL ELSE 0.0 END) AS full_frac_high,
 avg(v) FILTER (row BETWEEN 25 AND 74 AND col BETWEEN 25 AND 74) AS center_mean, quantile_cont(v, 0.9) FILTER (row BETWEEN 25 AND 74 AND col BETWEEN 25 AND 74) AS center_p90 FROM nd GROUP BY 1, 2),
p2 AS (SELECT file_id, t, avg(a) AS d20m_mean FROM (SELECT file_id, t, avg(v) AS a FROM nd GROUP BY file_id, t, row // 2, col // 2) GROUP BY 1, 2),
p3 AS (SELECT file_id, t, avg(a) AS d30m_mean FROM (SELECT file_id, t, avg(v) AS a FROM nd WHERE row < 99 AND col < 99 GROUP BY file_id, t, row // 3, col // 3) GROUP BY 1, 2)
SELECT w.file_id, w.t, round(full_mean, 6) AS full_mean, round(full_p90, 6) AS full_p90, round(full_max, 6) AS full_max, round(full_frac_high, 6) AS full_frac_high, round(center_mean, 6) AS center_mean, round(center_p90, 6) AS center_p90,
 round(d20m_mean, 6) AS d20m_mean, round(d30m_mean, 6) AS d30m_mean FROM w LEFT JOIN p2 USING (file_id, t) LEFT JOIN p3 USING (file_id, t)"""


@query("G23_spatial_summaries", "WITH " + ND_SQL + _POOL)
def _(spark, d):
    return rounded(RA.spatial_summaries(_nd(spark, d), "ndvi"))


@query("G23_spatial_summaries_published", "WITH " + ND_SQL + """, w AS (SELECT file_id, t, avg(v) AS full_mean, CASE WHEN count(v) > 0 THEN quantile_cont(coalesce(v, -1e9), 0.9) END AS full_p90, avg(CASE WHEN v > 0.5 THEN 1.0 ELSE 0.0 END) AS full_frac_high FROM nd GROUP BY 1, 2),
p2 AS (SELECT file_id, t, avg(a) AS d20m_mean FROM (SELECT file_id, t, avg(v) AS a FROM nd GROUP BY file_id, t, row, col // 2) GROUP BY 1, 2)
SELECT w.file_id, w.t, round(full_p90, 4) AS full_p90, round(full_frac_high, 6) AS full_frac_high, round(d20m_mean, 6) AS d20m_mean FROM w LEFT JOIN p2 USING (file_id, t)""")
def _(spark, d):
    s = RA.spatial_summaries(_nd(spark, d), "ndvi", legacy=True).select("file_id", "t", "full_p90", "full_frac_high", "d20m_mean")
    return rounded(s.withColumn("full_p90", F.round("full_p90", 4)))


@query("G24_percentile_stretch", "WITH " + PIXELS_SQL + f""", q AS (SELECT file_id, quantile_cont(b4 / 10000.0::DOUBLE, 0.02) AS lo, quantile_cont(b4 / 10000.0::DOUBLE, 0.98) AS hi FROM pixels GROUP BY 1)
SELECT {KS}, round(CASE WHEN b4 IS NULL THEN NULL ELSE least(greatest((b4 / 10000.0 - lo) / (hi - lo), 0.0), 1.0) END, 6) AS b4_01 FROM pixels JOIN q USING (file_id)""")
def _(spark, d):
    s = RA.stretch(pixels(spark, d), "b4", ["file_id"])
    return rounded(s.select(*K, F.when(F.col("b4").isNotNull(), F.col("b4_01")).alias("b4_01")))


@query("G24_fixed_rgb", "WITH " + PIXELS_SQL + f" SELECT {KS}, round(least(coalesce(b4, 0) / 3000.0, 1.0), 6) AS r, round(least(coalesce(b3, 0) / 3000.0, 1.0), 6) AS g, round(least(coalesce(b2, 0) / 3000.0, 1.0), 6) AS b FROM pixels")
def _(spark, d):
    return rounded(RA.fixed_rgb(pixels(spark, d)).select(*K, "r", "g", "b"))


@query("G25_outline", "WITH " + PIXELS_SQL + """, c AS (SELECT DISTINCT file_id, row::DOUBLE AS r, col::DOUBLE AS c FROM pixels WHERE b8 > 3000),
e AS (SELECT file_id, c - 0.5 AS x1, r - 0.5 AS y1, c + 0.5 AS x2, r - 0.5 AS y2 FROM c UNION ALL SELECT file_id, c - 0.5, r + 0.5, c + 0.5, r + 0.5 FROM c UNION ALL SELECT file_id, c - 0.5, r - 0.5, c - 0.5, r + 0.5 FROM c UNION ALL SELECT file_id, c + 0.5, r - 0.5, c + 0.5, r + 0.5 FROM c)
SELECT file_id, x1, y1, x2, y2 FROM e GROUP BY ALL HAVING count(*) = 1""")
def _(spark, d):
    return RA.outline(pixels(spark, d).filter("b8 > 3000").select("file_id", "row", "col"))


@query("G26_label_band", "SELECT CAST(l_suppkey AS VARCHAR) AS file_id, l_returnflag AS operator, CAST(l_orderkey % 100 AS INTEGER) AS row, l_linenumber AS col, CAST(l_quantity >= 25 AS INTEGER) AS value FROM lineitem")
def _(spark, d):
    lab = table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("file_id"), F.col("l_returnflag").alias("operator"), (F.col("l_orderkey") % 100).cast("int").alias("row"),
        F.col("l_linenumber").alias("col"), (F.col("l_quantity") >= 25).cast("int").alias("irrigated"), (F.col("l_linenumber") % 5).alias("certainty"))
    return RA.label_band(lab, "irrigated")


@query("G27_rebuild_mask", """WITH g AS (SELECT vec_id, embedding, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM embeddings, (SELECT unnest(range(0, 8)) AS r), (SELECT unnest(range(0, 8)) AS c)),
p AS (SELECT vec_id, row, col, embedding[row * 8 + col + 1] AS v FROM g) SELECT vec_id, row, col, CAST(CASE WHEN v > 0.02 THEN 1 WHEN v < -0.02 THEN 0 ELSE -1 END AS INTEGER) AS guess FROM p""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    cells = e.select("vec_id", F.posexplode("embedding").alias("i", "v")).filter(F.abs("v") > F.lit(0.02).cast("float"))
    g = cells.select("vec_id", F.expr("i div 8").cast("int").alias("row"), (F.col("i") % 8).cast("int").alias("col"), (F.col("v") > 0).cast("int").alias("guess"))
    return RA.rebuild_mask(g, e, 8, 8, "guess", keys=["vec_id"])


@query("G15_crop_or_pad", "WITH " + PIXELS_SQL + """, b AS (SELECT file_id, row, col, max(b4) AS b4 FROM pixels GROUP BY 1, 2, 3), f AS (SELECT DISTINCT file_id FROM b), g AS (SELECT file_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM f, (SELECT unnest(range(0, 60)) AS r), (SELECT unnest(range(0, 60)) AS c))
SELECT g.file_id, g.row, g.col, b4 FROM g LEFT JOIN b ON b.file_id = g.file_id AND b.row = g.row + 20 AND b.col = g.col + 20""")
def _(spark, d):
    px = pixels(spark, d).groupBy("file_id", "row", "col").agg(F.max("b4").alias("b4"))
    return RA.crop_or_pad(px, 100, 100, 60, ["b4"], ["file_id"])


@query("G20_usable_mask", "WITH " + PIXELS_SQL + f""", m AS (SELECT CAST(s_suppkey AS VARCHAR) AS file_id, CAST(r AS INTEGER) AS mr, CAST(c AS INTEGER) AS mc, CAST((s_suppkey + r * 3 + c) % 3 <> 0 AS INTEGER) AS clear FROM supplier, (SELECT unnest(range(0, 50)) AS r), (SELECT unnest(range(0, 50)) AS c))
SELECT {KS}, CASE WHEN clear = 1 THEN b4 END AS b4 FROM pixels p LEFT JOIN m ON m.file_id = p.file_id AND m.mr = CAST(floor(p.row * (49 / 99.0::DOUBLE) + 0.5) AS INTEGER) AND m.mc = CAST(floor(p.col * (49 / 99.0::DOUBLE) + 0.5) AS INTEGER)""")
def _(spark, d):
    files = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("file_id"))
    m = RA.full_grid(files, 50, 50, ["k", "file_id"]).withColumn("clear", ((F.col("k") + F.col("row") * 3 + F.col("col")) % 3 != 0).cast("int"))
    return RA.apply_usable_mask(pixels(spark, d), m, ["file_id"], ["b4"], (100, 100), (50, 50)).select(*K, "b4")


@query("G28_bilinear_resample", """WITH g AS (SELECT vec_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, (r + 0.5) * (8 / 16.0::DOUBLE) - 0.5 AS y, (c + 0.5) * (8 / 16.0::DOUBLE) - 0.5 AS x, embedding FROM embeddings, (SELECT unnest(range(0, 16)) AS r), (SELECT unnest(range(0, 16)) AS c)),
k AS (SELECT *, CAST(floor(y) AS INTEGER) AS y0, CAST(floor(x) AS INTEGER) AS x0, y - floor(y) AS wy, x - floor(x) AS wx FROM g)
SELECT vec_id, row, col, round((1 - wy) * (1 - wx) * CAST(embedding[greatest(y0, 0) * 8 + greatest(x0, 0) + 1] AS DOUBLE) + (1 - wy) * wx * CAST(embedding[greatest(y0, 0) * 8 + least(x0 + 1, 7) + 1] AS DOUBLE)
 + wy * (1 - wx) * CAST(embedding[least(y0 + 1, 7) * 8 + greatest(x0, 0) + 1] AS DOUBLE) + wy * wx * CAST(embedding[least(y0 + 1, 7) * 8 + least(x0 + 1, 7) + 1] AS DOUBLE), 6) AS v FROM k""")
def _(spark, d):
    return rounded(RA.resample_bilinear(_eight(spark, d), "v", ["vec_id"], 8, 8, 16))


def _eight(spark, d):
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return cells.select("vec_id", F.expr("i div 8").cast("int").alias("row"), (F.col("i") % 8).cast("int").alias("col"), F.col("v").cast("double").alias("v"))


@query("G14_regrid_nearest", """WITH f AS (SELECT vec_id, embedding, 2.5 + vec_id % 3 AS x0, 9.0 - vec_id % 2 AS y0 FROM embeddings), g AS (SELECT *, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM f, (SELECT unnest(range(0, 6)) AS r), (SELECT unnest(range(0, 6)) AS c)),
k AS (SELECT *, CAST(floor(10.0 - (y0 - (row + 0.5) * 1.2)) AS INTEGER) AS sr, CAST(floor(x0 + (col + 0.5) * 1.2 - 2.0) AS INTEGER) AS sc FROM g)
SELECT vec_id, row, col, CASE WHEN sr BETWEEN 0 AND 7 AND sc BETWEEN 0 AND 7 THEN round(CAST(embedding[sr * 8 + sc + 1] AS DOUBLE), 6) END AS v FROM k""")
def _(spark, d):
    k = F.col("vec_id")

    def grid(x0, y0, cell, n):
        return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), F.lit(cell).alias("cell"), F.lit(n).alias("height"), F.lit(n).alias("width"))

    target = table(spark, d, "embeddings").select(
        "vec_id", grid(F.lit(2.0), F.lit(10.0), 1.0, 8).alias("s"), grid(2.5 + k % 3, 9.0 - k % 2, 1.2, 6).alias("t"))
    return rounded(RA.regrid_nearest(_eight(spark, d), target, ["v"], ["vec_id"], "s", "t"))


# --- series -------------------------------------------------------------------

INTERP_SQL = SERIES_SQL + """, w AS (SELECT vec_id, label, t, v, last_value(v IGNORE NULLS) OVER p AS pv, max(CASE WHEN v IS NOT NULL THEN t END) OVER p AS pt, first_value(v IGNORE NULLS) OVER n AS nv, min(CASE WHEN v IS NOT NULL THEN t END) OVER n AS nt
 FROM cells WINDOW p AS (PARTITION BY vec_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY vec_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ip AS (SELECT vec_id, label, t, CASE WHEN pt IS NULL AND nt IS NULL THEN 0.0 WHEN pt IS NULL THEN nv WHEN nt IS NULL OR nt = pt THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END AS v FROM w)
"""


@query("T3_series_and_back", "WITH " + SERIES_SQL + " SELECT vec_id, t, round(v, 6) AS v FROM cells")
def _(spark, d):
    rows = TS.to_rows(series(spark, d), ["vec_id"], "v")
    back = TS.to_series(rows, ["vec_id"], "v", 64)
    return rounded(TS.to_rows(back, ["vec_id"], "v").select("vec_id", "t", "v"))


@query("T5_interpolate", "WITH " + INTERP_SQL + " SELECT vec_id, t, round(v, 6) AS v FROM ip")
def _(spark, d):
    s = series(spark, d).withColumn("v", SR.interpolate("v"))
    return rounded(TS.to_rows(s, ["vec_id"], "v"))


SMOOTH_SQL = INTERP_SQL + """, sm AS (SELECT vec_id, label, t, (lag(v, 1, v) OVER o + v + lead(v, 1, v) OVER o) / 3 AS v FROM ip WINDOW o AS (PARTITION BY vec_id ORDER BY t))"""


def _smooth(spark, d):
    return series(spark, d).withColumn("v", SR.interpolate("v")).withColumn("v", SR.smooth("v", 3))


@query("T6_smooth", "WITH " + SMOOTH_SQL + " SELECT vec_id, t, round(v, 6) AS v FROM sm")
def _(spark, d):
    return rounded(TS.to_rows(_smooth(spark, d), ["vec_id"], "v"))


@query("F13_valid_share", "WITH " + SERIES_SQL + " SELECT vec_id, count(v) / 64.0::DOUBLE AS share FROM cells GROUP BY 1 HAVING count(v) / 64.0 >= 0.5")
def _(spark, d):
    return series(spark, d).select("vec_id", SR.valid_share("v").alias("share")).filter("share >= 0.5")


@query("T7_trajectories", "WITH " + PIXELS_SQL + """, ok AS (SELECT file_id, t, (b8 - b4) / (b8 + b4 + 1e-6) AS nd, (b8 - b11) / (b8 + b11 + 1e-6) AS nw, 2.5 * (b8 / 1e4 - b4 / 1e4) / (b8 / 1e4 + 6 * (b4 / 1e4) - 7.5 * (b2 / 1e4) + 1 + 1e-6) AS ev FROM pixels WHERE b4 > 0 AND b8 > 0)
SELECT file_id, t, count(*) AS n_valid, CASE WHEN count(*) >= 20 THEN round(avg(nd), 6) END AS ndvi, CASE WHEN count(*) >= 20 THEN round(quantile_cont(nd, 0.9), 6) END AS ndvi_p90, CASE WHEN count(*) >= 20 THEN round(avg(nw), 6) END AS ndwi, CASE WHEN count(*) >= 20 THEN round(avg(ev), 6) END AS evi FROM ok GROUP BY 1, 2""")
def _(spark, d):
    return rounded(RA.trajectories(pixels(spark, d)))


SUM11 = """round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(min(v), 6) AS min, round(stddev_pop(v), 6) AS std, round(max(v) - min(v), 6) AS amp, round(avg(v) FILTER (t < 3), 6) AS early, round(avg(v) FILTER (t >= 61), 6) AS late,
 round(avg(v) FILTER (t >= 61) - avg(v) FILTER (t < 3), 6) AS late_minus_early, round(regr_slope(v, t), 8) AS slope, round(avg(v) * 64, 6) AS auc, CAST(count(*) FILTER (v > 0.4) AS INTEGER) AS n_green"""


@query("T8_series_summary", "WITH " + INTERP_SQL + f" SELECT vec_id, {SUM11} FROM ip GROUP BY 1")
def _(spark, d):
    s = TS.with_summary(series(spark, d).withColumn("v", SR.interpolate("v")), "v").drop("v", "label")
    return rounded(s.withColumn("slope", F.round("slope", 8)), 6, ["slope"])


@query("T8_temporal_summary", "WITH " + SERIES_SQL + " SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(max(v), 6) AS max, round(min(v), 6) AS min, round(max(v) - min(v), 6) AS amp FROM cells GROUP BY 1")
def _(spark, d):
    return rounded(TS.with_summary(series(spark, d), "v", short=True).drop("v", "label"))


TR_SQL = INTERP_SQL + ", i4 AS (SELECT vec_id, t, v AS ndvi, v * 1.5 AS ndvi_p90, v * -0.5 + 0.1 AS ndwi, v * 2 - 0.05 AS evi FROM ip)"


def _four(spark, d):
    s = series(spark, d)
    full = SR.interpolate("v")
    return s.withColumn("ndvi", full).select(
        "vec_id", "ndvi", F.transform("ndvi", lambda x: x * 1.5).alias("ndvi_p90"), F.transform("ndvi", lambda x: x * -0.5 + 0.1).alias("ndwi"),
        F.transform("ndvi", lambda x: x * 2 - 0.05).alias("evi"))


def _wide_sql():
    parts = []
    for name, short in TS.INDEX_NAMES.items():
        s = SUM11.replace("(v", f"({name}").replace("v >", f"{name} >").replace("- avg(v)", f"- avg({name})")
        for alias in ("mean", "max", "min", "std", "amp", "early", "late", "late_minus_early", "slope", "auc", "n_green"):
            s = s.replace(f" AS {alias},", f" AS {short}_{alias},")
        s = s.replace(" AS n_green", f" AS {short}_n_green")
        parts.append(s)
    raw = [f"round(max(ndvi) FILTER (t = {t}), 6) AS ndvi_t{t:02d}, round(max(ndwi) FILTER (t = {t}), 6) AS ndwi_t{t:02d}" for t in range(0, 64, 3)]
    return ", ".join(parts) + ", round(avg(ndvi) FILTER (t >= 61) * avg(ndwi) FILTER (t >= 61), 6) AS ndvi_ndwi_late, round(avg(ndvi_p90) FILTER (t >= 61) - avg(ndvi) FILTER (t >= 61), 6) AS p90_minus_mean_late, " + ", ".join(raw)


@query("T9_wide_features", "WITH " + TR_SQL + " SELECT vec_id, " + _wide_sql() + " FROM i4 GROUP BY 1")
def _(spark, d):
    w = TS.wide_features(_four(spark, d), ["vec_id"], windows=64)
    slopes = [c for c in w.columns if c.endswith("_slope")]
    return rounded(w.withColumns({c: F.round(c, 8) for c in slopes}), 6, slopes)


def _u(seed, *parts):
    return f"CAST(('0x' || substr(md5(concat_ws('#', {seed}, {', '.join(parts)})), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


@query("T10_degrade", "WITH " + SERIES_SQL + f""", dr AS (SELECT vec_id, t, CASE WHEN {_u(7, 'vec_id', 't')} >= 0.3 THEN v END AS v FROM cells),
w AS (SELECT vec_id, t, v, last_value(v IGNORE NULLS) OVER p AS pv, max(CASE WHEN v IS NOT NULL THEN t END) OVER p AS pt, first_value(v IGNORE NULLS) OVER n AS nv, min(CASE WHEN v IS NOT NULL THEN t END) OVER n AS nt
 FROM dr WINDOW p AS (PARTITION BY vec_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY vec_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT vec_id, t, CASE WHEN pt IS NULL AND nt IS NULL THEN 0.0 WHEN pt IS NULL THEN nv WHEN nt IS NULL OR nt = pt THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END AS v FROM w)
SELECT vec_id, t, round(v + 0.05 * sqrt(-2 * ln(1 - {_u(8, 'vec_id', 't', "'a'")})) * cos(2 * pi() * {_u(8, 'vec_id', 't', "'b'")}), 6) AS v FROM f""")
def _(spark, d):
    s = series(spark, d).withColumn("v", SR.degrade("v", ["vec_id"], 0.3, 0.05, 7))
    return rounded(TS.to_rows(s, ["vec_id"], "v"))


@query("T11_pick_steps", "SELECT vec_id, round(CAST(embedding[3] AS DOUBLE), 6) AS s0, round((CAST(embedding[5] AS DOUBLE) + CAST(embedding[6] AS DOUBLE) + CAST(embedding[7] AS DOUBLE)) / 3, 6) AS s1 FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(e.withColumn("s", SR.pick_steps("v", [2, [4, 5, 6]])).select("vec_id", F.col("s")[0].alias("s0"), F.col("s")[1].alias("s1")))


@query("T12_sample_series", "WITH " + SERIES_SQL + """, ok AS (SELECT vec_id, label FROM cells GROUP BY 1, 2 HAVING count(v) >= 32)
SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('#', 42, vec_id)), vec_id) AS rn FROM ok) WHERE rn <= 20""")
def _(spark, d):
    return TS.sample_series(series(spark, d), "label", 20, ["vec_id"]).select("vec_id", "label")


@query("T13_mean_curve", "WITH " + SMOOTH_SQL + " SELECT label, t, round(avg(v), 6) AS mean FROM sm GROUP BY 1, 2")
def _(spark, d):
    return rounded(TS.mean_curve(_smooth(spark, d), "label"))


FLAT = ", ".join(f"max({b}) FILTER (t = {t}) AS {b}_t{t}" for t in range(12) for b in ("b4", "b8"))


@query("T15_flatten_pixels", "WITH " + PIXELS_SQL + f" SELECT file_id, row, col, {FLAT} FROM pixels GROUP BY 1, 2, 3")
def _(spark, d):
    return ST.flatten_pixels(pixels(spark, d), ["b4", "b8"], list(range(12)))


@query("T16_flatten_cells", "WITH " + PIXELS_SQL + ", lg AS (SELECT file_id, t, row, col, unnest(['b4', 'b8']) AS band, unnest([b4, b8]) AS value FROM pixels) SELECT * FROM lg WHERE value IS NOT NULL")
def _(spark, d):
    return ST.flatten_cells(pixels(spark, d), ["b4", "b8"])


@query("T17_replace_missing", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = 7 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_quantity = 7 THEN 0 ELSE l_quantity END AS q0 FROM lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem").select(*K, F.col("l_quantity").alias("q"), F.col("l_quantity").alias("q0"))
    return ST.replace_missing(ST.replace_missing(li, ["q"], 7, None), ["q0"], 7, 0.0)


@query("T18_impute_mean", "WITH " + SERIES_SQL + ", p AS (SELECT vec_id, max(v) FILTER (t = 1) AS a, max(v) FILTER (t = 2) AS b FROM cells GROUP BY 1) SELECT vec_id, round(coalesce(a, (SELECT avg(a) FROM p)), 6) AS a, round(coalesce(b, (SELECT avg(b) FROM p)), 6) AS b FROM p")
def _(spark, d):
    s = series(spark, d).select("vec_id", F.get("v", F.lit(1)).alias("a"), F.get("v", F.lit(2)).alias("b"))
    return rounded(TS.impute(s, ["a", "b"]))


@query("S10_stack_scan", """WITH t AS (SELECT unnest(range(0, 16)) AS t) SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(nullif(CAST(trunc(CAST(embedding[CAST(t + 1 AS INTEGER)] AS DOUBLE) * 50) AS INTEGER), 0) AS INTEGER) AS "B2",
 CAST(nullif(CAST(trunc(CAST(embedding[CAST(32 + t + 1 AS INTEGER)] AS DOUBLE) * 50) AS INTEGER), 0) AS INTEGER) AS "B4" FROM embeddings, t""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") * 50).cast("int")).alias("layers"))
    return ST.layers_to_cells(e, "layers", 16, ["B2", "B3", "B4", "B8"], ["vec_id"]).select("vec_id", "t", "B2", "B4")
