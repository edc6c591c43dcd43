"""Registered queries: agreement tables, counts, summaries, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import safe_div
from ..operators import agreement as A
from ..operators import evaluation as E
from ..operators import filters as FL
from ..operators import reports as P
from ..operators import scenes as S
from ..operators import stacks as ST
from .catalog_labels import COUNTS_SQL, match_counts, rounded
from .registry import IMAGES_SQL, PIXELS_SQL, POLYGONS_SQL, SCENES_SQL, SCORES_SQL, SERIES_SQL, images, pixels, polygons, query, scenes, scores, series, table

DET_SQL = POLYGONS_SQL + "," + COUNTS_SQL + """, c AS (SELECT comp_op, count(*) FILTER (n_gt > 0 AND n_comp > 0) AS tp, count(*) FILTER (n_gt = 0 AND n_comp > 0) AS fp,
 count(*) FILTER (n_gt > 0 AND n_comp = 0) AS fn, count(*) FILTER (n_gt = 0 AND n_comp = 0) AS tn FROM mc GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS rc FROM c),
w AS (SELECT operator_initials AS comp_op, count(*) AS labeled FROM images GROUP BY 1),
det AS (SELECT r.comp_op, w.labeled, tp, fp, fn, tn, tp + fp + fn + tn AS matched, p AS precision, rc AS recall, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END AS f1 FROM r JOIN w USING (comp_op))
"""


def _detection(spark, d):
    labeled = images(spark, d).groupBy(F.col("operator_initials").alias("comp_op")).agg(F.count("*").alias("labeled"))
    return A.detection_metrics(match_counts(spark, d)).withColumnRenamed("total_images", "matched").join(labeled, "comp_op")


@query("A6_detection_summary", "WITH " + DET_SQL + """
SELECT comp_op, labeled, matched, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM det UNION ALL
SELECT 'Weighted Avg', CAST(sum(labeled) AS BIGINT), CAST(sum(matched) AS BIGINT), CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), CAST(sum(tn) AS BIGINT),
 round(sum(precision * labeled) / sum(labeled), 6), round(sum(recall * labeled) / sum(labeled), 6), round(sum(f1 * labeled) / sum(labeled), 6) FROM det""")
def _(spark, d):
    return rounded(A.weighted_average_row(_detection(spark, d), "comp_op", "labeled", ["matched", "tp", "fp", "fn", "tn"], ["precision", "recall", "f1"]))


@query("A7_weighted_metric", "WITH " + DET_SQL + " SELECT round(sum(f1 * labeled) / sum(labeled), 6) AS f1 FROM det WHERE comp_op IN ('DSB','JL','KL','MV')")
def _(spark, d):
    return rounded(A.weighted_metric(_detection(spark, d), "f1", "labeled", ["DSB", "JL", "KL", "MV"]))


AREAS_SQL = """
ar AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS comp_op, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_extendedprice END AS gt_area,
  CASE WHEN l_linenumber <= 2 THEN 0 ELSE l_quantity * 1000 END AS comp_area FROM lineitem),
areas AS (SELECT *, least(gt_area, comp_area) * 0.5 AS intersection_area, gt_area + comp_area - least(gt_area, comp_area) * 0.5 AS union_area FROM ar)
"""


def _areas(spark, d):
    n = F.col("l_linenumber")
    a = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("comp_op"),
        F.when(n == 1, 0.0).otherwise(F.col("l_extendedprice")).alias("gt_area"), F.when(n <= 2, 0.0).otherwise(F.col("l_quantity") * 1000).alias("comp_area"))
    both = F.least("gt_area", "comp_area") * 0.5
    return a.withColumns({"intersection_area": both, "union_area": F.col("gt_area") + F.col("comp_area") - both})


@query("A4_overall_area_metrics", "WITH " + AREAS_SQL + """, t AS (SELECT comp_op, sum(gt_area) AS g, sum(comp_area) AS c, sum(intersection_area) AS i, sum(union_area) AS u FROM areas GROUP BY 1)
SELECT comp_op, round(g, 2) AS total_gt_area, round(c, 2) AS total_comp_area, round(i, 2) AS total_intersection, round(u, 2) AS total_union,
 round(i / c, 6) AS precision, round(i / g, 6) AS recall, round(i / u, 6) AS iou, round(2 * (i / c) * (i / g) / (i / c + i / g), 6) AS f1 FROM t""")
def _(spark, d):
    m = A.overall_area_metrics(_areas(spark, d))
    tot = [c for c in m.columns if c.startswith("total_")]
    return rounded(rounded(m, 6, tot), 2, [c for c in m.columns if c not in tot])


IMG_AREA_SQL = AREAS_SQL + """, pm AS (SELECT *, CASE WHEN comp_area > 0 THEN intersection_area / comp_area END AS precision, CASE WHEN gt_area > 0 THEN intersection_area / gt_area END AS recall,
  CASE WHEN union_area > 0 THEN intersection_area / union_area ELSE 0 END AS iou FROM areas WHERE gt_area > 0 OR comp_area > 0),
pf AS (SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pm)
"""


@query("A5_image_area_means", "WITH " + IMG_AREA_SQL + """
SELECT comp_op, count(*) AS images, count(precision) AS n_precision, count(recall) AS n_recall, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(iou), 6) AS iou, round(avg(f1), 6) AS f1 FROM pf GROUP BY 1""")
def _(spark, d):
    m = A.image_area_metrics(_areas(spark, d))
    return rounded(m.groupBy("comp_op").agg(F.count("*").alias("images"), F.count("precision").alias("n_precision"), F.count("recall").alias("n_recall"),
                                            *[F.avg(c).alias(c) for c in ("precision", "recall", "iou", "f1")]))


@query("A5_image_area_histogram", "WITH " + IMG_AREA_SQL + """
SELECT comp_op, CAST(least(floor(round(iou, 9) / 0.05), 19) AS INTEGER) AS bin, count(*) AS n FROM pf GROUP BY 1, 2""")
def _(spark, d):
    m = A.image_area_metrics(_areas(spark, d)).withColumn("iou", F.round("iou", 9))
    return A.histogram(m, ["comp_op"], "iou", 0.0, 1.0, 20)


@query("A8_images_per_labeler", "WITH " + IMAGES_SQL + """
SELECT operator_initials, count(*) AS images, count(DISTINCT source_file) AS surveys, round(count(*) / count(DISTINCT source_file)::DOUBLE, 6) AS images_per_survey FROM images GROUP BY 1""")
def _(spark, d):
    return rounded(P.images_per_labeler(images(spark, d)))


@query("A9_label_shares", "WITH " + IMAGES_SQL + " SELECT operator_initials, " + ", ".join(
    f"round(count(*) FILTER (irrigation = {c}) / count(*)::DOUBLE, 6) AS code_{c}" for c in range(1, 6)) + " FROM images GROUP BY 1")
def _(spark, d):
    return rounded(P.label_shares(images(spark, d)))


def _box_sql(src, key, val):
    return f"""q AS (SELECT {key}, quantile_cont({val}, 0.25) AS q1, quantile_cont({val}, 0.5) AS q2, quantile_cont({val}, 0.75) AS q3 FROM {src} GROUP BY 1)
SELECT {key}, round(q1, 9) AS q1, round(q2, 9) AS q2, round(q3, 9) AS q3,
 round(min({val}) FILTER ({val} >= q1 - 1.5 * (q3 - q1)), 9) AS whisker_low, round(max({val}) FILTER ({val} <= q3 + 1.5 * (q3 - q1)), 9) AS whisker_high,
 count(*) FILTER ({val} < q1 - 1.5 * (q3 - q1) OR {val} > q3 + 1.5 * (q3 - q1)) AS outliers FROM {src} JOIN q USING ({key}) GROUP BY {key}, q1, q2, q3"""


@query("A10_coverage_box", "WITH " + IMAGES_SQL + ", " + _box_sql("images", "operator_initials", "percent_coverage"))
def _(spark, d):
    return rounded(P.box_statistics(images(spark, d), ["operator_initials"], "percent_coverage"), 9)


@query("A10_size_box", "WITH z AS (SELECT l_returnflag, sqrt(l_extendedprice * l_quantity) AS s FROM lineitem), " + _box_sql("z", "l_returnflag", "s"))
def _(spark, d):
    z = table(spark, d, "lineitem").select("l_returnflag", F.sqrt(F.col("l_extendedprice") * F.col("l_quantity")).alias("s"))
    return rounded(P.box_statistics(z, ["l_returnflag"], "s"), 9)


@query("A11_outlier_shares", "WITH " + IMAGES_SQL + """, p AS (SELECT operator_initials, count(*) FILTER (percent_coverage > 35) AS n, count(*) AS a FROM images GROUP BY 1)
SELECT operator_initials, n, round(n / (SELECT sum(n) FROM p)::DOUBLE, 6) AS share_of_outliers, round(n / a::DOUBLE, 6) AS share_of_labeler FROM p WHERE n > 0""")
def _(spark, d):
    return rounded(P.outlier_shares(images(spark, d), "percent_coverage", 35.0))


@query("A12_label_count_table", "WITH " + IMAGES_SQL + """, p AS (SELECT operator_initials, count(DISTINCT plot_file) AS surveys, count(DISTINCT site_id) AS locations, count(DISTINCT site_id || '_' || image_number) AS images FROM images GROUP BY 1)
SELECT * FROM p UNION ALL SELECT 'Total (unique)', count(DISTINCT plot_file), count(DISTINCT site_id), count(DISTINCT site_id || '_' || image_number) FROM images
UNION ALL SELECT 'Total (not unique)', CAST(sum(surveys) AS BIGINT), CAST(sum(locations) AS BIGINT), CAST(sum(images) AS BIGINT) FROM p""")
def _(spark, d):
    return P.survey_location_image_counts(images(spark, d))


@query("A13_labeler_summary", "WITH " + POLYGONS_SQL + """,
a AS (SELECT coalesce(operator_initials, 'Total') AS op, count(DISTINCT site_id) AS locations, count(*) AS images, count(*) FILTER (irrigation >= 3) AS irrigated_images, round(count(*) FILTER (irrigation >= 3) / count(*)::DOUBLE * 100, 6) AS pct_irrigated FROM images GROUP BY GROUPING SETS ((operator_initials), ())),
b AS (SELECT coalesce(operator_initials, 'Total') AS op, count(*) AS polygons, round(sum(polygon_area_m2), 2) AS total_area_m2 FROM polygons GROUP BY GROUPING SETS ((operator_initials), ()))
SELECT a.op AS operator_initials, locations, images, irrigated_images, pct_irrigated, coalesce(polygons, 0) AS polygons, coalesce(total_area_m2, 0) AS total_area_m2 FROM a LEFT JOIN b USING (op)""")
def _(spark, d):
    s = P.labeler_summary(images(spark, d), polygons(spark, d))
    return rounded(rounded(s, 6, ["total_area_m2"]), 2, ["pct_irrigated"])


SPLIT_STATS_SQL = IMAGES_SQL + """, sp AS (SELECT *, CASE WHEN unique_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN unique_id % 3 = 0 THEN percent_coverage ELSE 0 END AS cs, CASE WHEN unique_id % 3 = 1 THEN percent_coverage_hc ELSE 0 END AS ci FROM images),
st AS (SELECT split, count(*) AS images, count(DISTINCT site_id) AS locations, count(*) FILTER (irrigation >= 3) AS irrigated, round(avg(CAST(irrigation >= 3 AS INTEGER)) * 100, 1) AS pct_irrigated,
 count(DISTINCT site_id) FILTER (irrigation >= 3) AS irrigated_sites, count(*) FILTER (cs > 0) AS small_scale, count(*) FILTER (ci > 0) AS industrial FROM sp GROUP BY 1)
"""


def _split_stats(spark, d):
    k = F.col("unique_id")
    rows = images(spark, d).withColumns({
        "split": F.when(k % 5 == 0, "test").otherwise("train"),
        "coverage_small_scale": F.when(k % 3 == 0, F.col("percent_coverage")).otherwise(0.0),
        "coverage_industrial": F.when(k % 3 == 1, F.col("percent_coverage_hc")).otherwise(0.0)})
    return rows, P.split_statistics(rows)


@query("A14_split_statistics", "WITH " + SPLIT_STATS_SQL + " SELECT * FROM st")
def _(spark, d):
    return _split_stats(spark, d)[1]


@query("F12_split_alarms", "WITH " + SPLIT_STATS_SQL + " SELECT split, irrigated_sites < 100 AS few_irrigated_sites, industrial < 5 AS few_industrial FROM st")
def _(spark, d):
    return FL.split_alarms(_split_stats(spark, d)[1], 100, 5).select("split", "few_irrigated_sites", "few_industrial")


@query("A36_survey_industrial", "WITH " + IMAGES_SQL + """, s AS (SELECT regexp_extract(source_file, '(\\d+-\\d+)', 1) AS survey_id, count(*) FILTER (unique_id % 3 = 1 AND percent_coverage_hc > 0) AS industrial, count(*) FILTER (irrigation >= 3) AS irrigated FROM images GROUP BY 1)
SELECT * FROM s WHERE industrial > 0 ORDER BY CAST(split_part(survey_id, '-', 1) AS INTEGER)""")
def _(spark, d):
    return P.survey_industrial(_split_stats(spark, d)[0])


@query("A15_rating_confusion", "WITH " + IMAGES_SQL + """, f AS (SELECT image_id, operator_initials AS op, max(irrigation) >= 3 AS pos FROM images GROUP BY 1, 2), ids AS (SELECT DISTINCT image_id FROM f), ops AS (SELECT DISTINCT op FROM f WHERE op <> 'AB'),
g AS (SELECT ids.image_id, ops.op, coalesce(a.pos, false) AS t, coalesce(b.pos, false) AS p FROM ids CROSS JOIN ops LEFT JOIN f a ON a.image_id = ids.image_id AND a.op = 'AB' LEFT JOIN f b ON b.image_id = ids.image_id AND b.op = ops.op),
c AS (SELECT op, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM g GROUP BY 1)
SELECT op AS operator_initials, tp, fp, fn, tn, round(fp / (fp + tn)::DOUBLE, 6) AS fp_rate, round(fn / (fn + tp)::DOUBLE, 6) AS fn_rate FROM c""")
def _(spark, d):
    return rounded(A.rating_confusion(images(spark, d), "AB", 3))


@query("A16_trend_against_reference", "WITH " + IMAGES_SQL + """, v AS (SELECT image_id, operator_initials AS op, max(percent_coverage) AS v FROM images GROUP BY 1, 2)
SELECT b.op AS operator_initials, count(*) AS n, round(regr_slope(b.v, a.v), 6) AS slope, round(regr_intercept(b.v, a.v), 6) AS intercept, round(regr_r2(b.v, a.v), 6) AS r2
FROM v b JOIN v a ON a.image_id = b.image_id AND a.op = 'AB' WHERE b.op <> 'AB' GROUP BY 1""")
def _(spark, d):
    return rounded(A.trend_against(images(spark, d), "AB", "percent_coverage"))


@query("A17_detections_per_image", "WITH " + IMAGES_SQL + " SELECT image_id, " + ", ".join(f"count(*) FILTER (operator_initials = '{o}') AS \"{o}\"" for o in ("AB", "DSB", "JL", "KL", "MV", "PS")) + " FROM images GROUP BY 1")
def _(spark, d):
    return P.detections_per_image(images(spark, d), ["AB", "DSB", "JL", "KL", "MV", "PS"])


@query("A18_location_summary", "WITH " + IMAGES_SQL + """, ws AS (SELECT site_num, water_source, count(*) AS n FROM images WHERE water_source IS NOT NULL GROUP BY 1, 2), m AS (SELECT site_num, arg_min(water_source, (-n, water_source)) AS w FROM ws GROUP BY 1)
SELECT i.site_num, i.x, i.y, max(image_number) AS images, arg_min(year, unique_id) AS year, arg_min(month, unique_id) AS month, arg_min(day, unique_id) AS day, round(avg(irrigation), 6) AS avg_certainty, round(avg(percent_coverage), 6) AS avg_percent_coverage,
 round(avg(percent_coverage_hc), 6) AS avg_percent_coverage_high, count(DISTINCT operator_initials) AS n_labelers, any_value(m.w) AS water_source_mode FROM images i LEFT JOIN m USING (site_num) GROUP BY 1, 2, 3""")
def _(spark, d):
    return rounded(P.location_summary(images(spark, d), ["site_num", "x", "y"]), 6, ["x", "y"])


@query("A19_yearly_band", "WITH " + IMAGES_SQL + """, s AS (SELECT year, avg(percent_coverage_hc) AS m, stddev_samp(percent_coverage_hc) / sqrt(count(*)) AS se FROM images WHERE irrigation >= 3 GROUP BY 1)
SELECT year, round(m, 6) AS mean_coverage, round(se, 6) AS se, round(m - 1.96 * se, 6) AS lower, round(m + 1.96 * se, 6) AS upper FROM s""")
def _(spark, d):
    return rounded(P.yearly_band(images(spark, d).filter("irrigation >= 3"), "percent_coverage_hc"))


def _describe_sql(src, key, val):
    return f"""SELECT {key}, count({val}) AS count, round(avg({val}), 6) AS mean, round(stddev_samp({val}), 6) AS std, round(min({val}), 6) AS min, round(max({val}), 6) AS max,
 round(quantile_cont({val}, 0.25), 6) AS p25, round(quantile_cont({val}, 0.5), 6) AS p50, round(quantile_cont({val}, 0.75), 6) AS p75 FROM {src} GROUP BY {key}"""


@query("A20_describe_by_category", "WITH " + POLYGONS_SQL + _describe_sql("polygons", "category", "polygon_area_m2"))
def _(spark, d):
    return rounded(P.describe(polygons(spark, d), ["category"], "polygon_area_m2"), 6)


@query("A20_value_counts", "WITH " + IMAGES_SQL + " SELECT irrigation, year, count(*) AS n FROM images GROUP BY 1, 2")
def _(spark, d):
    return P.value_counts(images(spark, d), "irrigation", "year")


@query("A21_polygons_per_image", "WITH " + POLYGONS_SQL + ", p AS (SELECT image_id, count(*) AS n FROM polygons GROUP BY 1) SELECT least(n, 8) AS polygons, count(*) AS images FROM p GROUP BY 1")
def _(spark, d):
    return P.polygons_per_image(polygons(spark, d), 8)


@query("A21_log_size_bins", "WITH " + POLYGONS_SQL + """, s AS (SELECT category, log10(polygon_area_m2 + 0.01) AS v FROM polygons), m AS (SELECT category, min(v) AS a, max(v) AS b FROM s GROUP BY 1)
SELECT category, CAST(least(floor(round((v - a) / ((b - a) / 50), 9)), 49) AS INTEGER) AS bin, count(*) AS n FROM s JOIN m USING (category) GROUP BY 1, 2""")
def _(spark, d):
    return P.log_bins(polygons(spark, d), ["category"], "polygon_area_m2", 50)


@query("A21_clip_at_p99", "WITH c AS (SELECT quantile_cont(l_extendedprice, 0.99) AS cut FROM lineitem) SELECT l_returnflag, count(*) AS n, max(l_extendedprice) AS top FROM lineitem, c WHERE l_extendedprice <= cut GROUP BY 1")
def _(spark, d):
    return P.clip_at_percentile(table(spark, d, "lineitem"), "l_extendedprice").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("top"))


WIN_SQL = """wn AS (SELECT CAST(user_id AS VARCHAR) AS file_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type IN ('click', 'purchase') END AS file_exists,
 CASE WHEN event_type = 'signup' THEN NULL ELSE (event_id * 37 % 101) / 100.0::DOUBLE END AS masked_fraction FROM events)
"""


def _win(spark, d):
    t, k = F.col("event_type"), F.col("event_id")
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("file_id"), F.when(t != "view", t.isin("click", "purchase")).alias("file_exists"),
        F.when(t != "signup", (k * 37 % 101) / 100.0).alias("masked_fraction"))


@query("A22_download_statistics", "WITH " + WIN_SQL + """, w2 AS (SELECT * FROM wn WHERE file_exists IS NOT NULL), p AS (SELECT file_id, count(*) FILTER (file_exists) / count(*)::DOUBLE AS share, avg(coalesce(masked_fraction, 1.0)) AS m FROM w2 GROUP BY 1)
SELECT count(*) AS total_samples, count(*) FILTER (share >= 0.5) AS samples_with_50pct_images, round(count(*) FILTER (share >= 0.5) / count(*)::DOUBLE * 100, 6) AS percent_with_50pct_images, round(median(m), 6) AS median_of_avg_masked_fraction FROM p""")
def _(spark, d):
    return rounded(S.download_statistics(_win(spark, d).filter(F.col("file_exists").isNotNull())))


AVAIL_SQL = WIN_SQL + """, av AS (SELECT file_id, count(*) AS total_windows, avg(CAST(NOT coalesce(file_exists, true) AS INTEGER)) AS missing, avg(CAST(coalesce(masked_fraction, 0) > 0.5 AS INTEGER)) AS heavily_masked,
 avg(CAST(coalesce(masked_fraction, 0) > 0.5 AS INTEGER)) FILTER (coalesce(file_exists, true)) AS conditional_heavily_masked FROM wn GROUP BY 1)
"""


@query("A23_availability", "WITH " + AVAIL_SQL + " SELECT file_id, total_windows, round(missing, 6) AS missing, round(heavily_masked, 6) AS heavily_masked, round(conditional_heavily_masked, 6) AS conditional_heavily_masked FROM av")
def _(spark, d):
    return rounded(S.availability(_win(spark, d)))


@query("A23_availability_describe", "WITH " + AVAIL_SQL + _describe_sql("(SELECT 'missing' AS metric, * FROM av)", "metric", "missing"))
def _(spark, d):
    return rounded(P.describe(S.availability(_win(spark, d)).withColumn("metric", F.lit("missing")), ["metric"], "missing"), 6)


@query("A23_worst_stacks", "WITH " + AVAIL_SQL + " SELECT file_id, round(missing, 6) AS missing FROM av ORDER BY round(missing, 9) DESC, file_id LIMIT 5")
def _(spark, d):
    return rounded(S.availability(_win(spark, d)).select("file_id", F.round("missing", 9).alias("missing")).orderBy(F.desc("missing"), "file_id").limit(5))


@query("A24_cloud_fraction", "WITH c AS (SELECT user_id, avg(CAST(event_type = 'error' AS INTEGER)) AS f FROM events GROUP BY 1) SELECT user_id, round(f, 6) AS cloud_fraction, round(1 - f, 6) AS good_fraction, 1 - f >= 0.8 AS keep FROM c")
def _(spark, d):
    flags = table(spark, d, "events").select("user_id", (F.col("event_type") == "error").alias("cloud"))
    return rounded(S.cloud_fraction(flags, "user_id", "cloud", 0.8))


@query("A25_binary_metrics", """
WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS fp, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS fn, count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS tn FROM labels)
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1_score FROM c""")
def _(spark, d):
    return rounded(E.binary_metrics(table(spark, d, "labels"), "quality", "toxic"))


def _report_sql(src, keys, truth, guess):
    k = keys + ", " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    one = lambda c, name: f"""SELECT {k}'{name}' AS class, round(CASE WHEN count(*) FILTER ({guess} = {c}) > 0 THEN count(*) FILTER ({guess} = {c} AND {truth} = {c}) / (count(*) FILTER ({guess} = {c}))::DOUBLE ELSE 0 END, 6) AS precision,
 round(CASE WHEN count(*) FILTER ({truth} = {c}) > 0 THEN count(*) FILTER ({guess} = {c} AND {truth} = {c}) / (count(*) FILTER ({truth} = {c}))::DOUBLE ELSE 0 END, 6) AS recall,
 round(CASE WHEN count(*) FILTER ({truth} = {c}) + count(*) FILTER ({guess} = {c}) > 0 THEN 2 * count(*) FILTER ({guess} = {c} AND {truth} = {c}) / (count(*) FILTER ({truth} = {c}) + count(*) FILTER ({guess} = {c}))::DOUBLE ELSE 0 END, 6) AS f1_score,
 count(*) FILTER ({truth} = {c}) AS support FROM {src} {g}"""  # noqa: E731
    return one(0, "non_irrigated") + " UNION ALL " + one(1, "irrigated")


@query("A26_class_report", _report_sql("labels", "", "quality", "toxic"))
def _(spark, d):
    return rounded(P.class_report(table(spark, d, "labels"), [], "quality", "toxic", E.BINARY))


FACT_SQL = IMAGES_SQL + """, fx AS (SELECT *, CAST(irrigation >= 3 AS INTEGER) AS truth, CAST(unique_id % 4 < 2 AS INTEGER) AS pred, CAST(unique_id % 5 + 1 AS INTEGER) AS certainty, unique_id % 6 AS u FROM images),
fl AS (SELECT 'overall' AS factor, 'overall' AS category, truth, pred FROM fx
 UNION ALL SELECT 'per_uncertainty_score', CASE WHEN certainty <= 3 THEN 'low_certainty' ELSE 'high_certainty' END, truth, pred FROM fx
 UNION ALL SELECT 'per_month', list_extract(['june','july','august','september','october'], month - 5), truth, pred FROM fx WHERE month BETWEEN 6 AND 10
 UNION ALL SELECT 'per_year', CAST(year + 24 AS VARCHAR), truth, pred FROM fx WHERE year + 24 BETWEEN 2016 AND 2025
 UNION ALL SELECT 'water_source', CASE water_source WHEN 'true' THEN 'water_source_present' ELSE 'water_source_absent' END, truth, pred FROM fx WHERE water_source IS NOT NULL
 UNION ALL SELECT 'per_uncertainty_explanation', 'uneven', truth, pred FROM fx WHERE u = 2
 UNION ALL SELECT 'per_uncertainty_explanation', 'only_slightly_green', truth, pred FROM fx WHERE u IN (1, 2)),
cats AS (SELECT 'overall' AS factor, 'overall' AS category UNION ALL SELECT 'per_uncertainty_score', unnest(['low_certainty', 'high_certainty']) UNION ALL SELECT 'per_month', unnest(['june','july','august','september','october'])
 UNION ALL SELECT 'per_year', CAST(unnest(range(2016, 2026)) AS VARCHAR) UNION ALL SELECT 'water_source', unnest(['water_source_present', 'water_source_absent'])
 UNION ALL SELECT 'per_uncertainty_explanation', unnest(['unclear_signs_of_agriculture', 'only_slightly_green', 'uneven', 'may_naturally_be_green', 'may_be_a_fishpond'])),
fz AS (SELECT cats.factor, cats.category, truth, pred FROM cats LEFT JOIN fl ON fl.factor = cats.factor AND fl.category = cats.category)
"""


@query("A27_metrics_by_factor", "WITH " + FACT_SQL + _report_sql("fz", "factor, category", "truth", "pred"))
def _(spark, d):
    k = F.col("unique_id")
    rows = images(spark, d).withColumns({
        "truth": (F.col("irrigation") >= 3).cast("int"), "pred": (k % 4 < 2).cast("int"), "certainty": (k % 5 + 1).cast("int"),
        "year": F.col("year") + 24, "slightly_green": (k % 6).isin(1, 2).cast("int"), "uneven": (k % 6 == 2).cast("int"),
        "unclear": F.lit(0), "natural": F.lit(0), "fishpond": F.lit(0)})
    return rounded(E.metrics_by_factor(rows, "truth", "pred"))


PXM_SQL = """px AS (SELECT l_suppkey AS image, CAST(l_linenumber % 2 AS INTEGER) AS truth, CAST(l_quantity > 48 AS INTEGER) AS pred FROM lineitem),
pi AS (SELECT image, count(*) AS n, count(*) FILTER (truth = 0) AS t0, count(*) FILTER (truth = 1) AS t1, count(*) FILTER (pred = 0) AS p0, count(*) FILTER (pred = 1) AS p1 FROM px GROUP BY 1)
"""


@query("A28_class_presence", "WITH " + PXM_SQL + """, pr AS (SELECT CAST(t1 >= 295 AS INTEGER) AS truth, CAST(p1 >= 20 AS INTEGER) AS pred, CAST(t0 >= 295 AS INTEGER) AS truth0, CAST(p0 >= 20 AS INTEGER) AS pred0 FROM pi),
lg AS (SELECT 'non_irrigated' AS class, truth0 AS t, pred0 AS p FROM pr UNION ALL SELECT 'irrigated', truth, pred FROM pr),
c AS (SELECT class, count(*) FILTER (t = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (t = 1) AS s, count(*) FILTER (p = 1) AS g FROM lg GROUP BY 1)
SELECT class, round(CASE WHEN g > 0 THEN tp / g ELSE 0 END, 6) AS precision, round(CASE WHEN s > 0 THEN tp / s ELSE 0 END, 6) AS recall, round(CASE WHEN s + g > 0 THEN 2 * tp / (s + g) ELSE 0 END, 6) AS f1_score, s AS support FROM c""")
def _(spark, d):
    return rounded(E.class_presence(_px(spark, d), ["image"], "truth", "pred", {0: (295, 20), 1: (295, 20)}))


def _px(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("image"), (F.col("l_linenumber") % 2).cast("int").alias("truth"), (F.col("l_quantity") > 48).cast("int").alias("pred"))


@query("A29_fraction_error", "WITH " + PXM_SQL + ", f AS (SELECT t1 / n::DOUBLE - p1 / n::DOUBLE AS e FROM pi) SELECT round(avg(abs(e)), 6) AS mae, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse FROM f")
def _(spark, d):
    return rounded(E.fraction_error(_px(spark, d), ["image"], "truth", "pred"))


@query("A30_fold_summary", "WITH " + SCORES_SQL + """, m AS (SELECT fold, avg(CAST(y = pred AS INTEGER)) AS accuracy, avg(p) AS mean_p FROM scores GROUP BY 1)
SELECT round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std, round(avg(mean_p), 6) AS mean_p_mean, round(stddev_pop(mean_p), 6) AS mean_p_std, count(*) AS n_folds FROM m""")
def _(spark, d):
    m = scores(spark, d).groupBy("fold").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"), F.avg("p").alias("mean_p"))
    return rounded(E.fold_summary(m, ["accuracy", "mean_p"]))


@query("A33_missing_counts", "WITH " + PIXELS_SQL + """, lg AS (SELECT file_id, t, unnest(['b2', 'b4', 'b8']) AS band, unnest([b2, b4, b8]) AS v FROM pixels)
SELECT file_id, band, t, count(*) FILTER (v IS NULL) AS n_missing FROM lg GROUP BY GROUPING SETS ((file_id, band, t), (band, t))""")
def _(spark, d):
    return ST.nan_counts(pixels(spark, d), ["b2", "b4", "b8"])


@query("W9_missing_table", "WITH " + PIXELS_SQL + """, lg AS (SELECT t, unnest(['b2', 'b4', 'b8']) AS band, unnest([b2, b4, b8]) AS v FROM pixels)
SELECT band, """ + ", ".join(f'count(*) FILTER (v IS NULL AND t = {i}) AS "{i}"' for i in range(12)) + " FROM lg GROUP BY 1")
def _(spark, d):
    return ST.nan_table(ST.nan_counts(pixels(spark, d), ["b2", "b4", "b8"]), list(range(12)))


@query("A34_recall_by_stratum", "WITH " + SCORES_SQL + " SELECT stratum, count(*) AS n_pos, round(avg(pred), 6) AS recall, round(avg(p), 6) AS mean_proba FROM scores WHERE y = 1 GROUP BY 1 HAVING count(*) >= 5")
def _(spark, d):
    return rounded(P.recall_by_stratum(scores(spark, d), "stratum", "y", "pred", "p", 5))


@query("A34_parity_gap", "WITH " + SCORES_SQL + ", r AS (SELECT stratum, avg(pred) AS recall FROM scores WHERE y = 1 GROUP BY 1 HAVING count(*) >= 5) SELECT round(max(recall) - min(recall), 6) AS gap FROM r")
def _(spark, d):
    return rounded(P.parity_gap(P.recall_by_stratum(scores(spark, d), "stratum", "y", "pred", None, 5)))


@query("A35_pixels_per_parcel", "WITH z AS (SELECT l_returnflag AS stratum, l_extendedprice / 10000 * 100 AS px FROM lineitem) " + _describe_sql("z", "stratum", "px"))
def _(spark, d):
    z = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("stratum"), (F.col("l_extendedprice") / 10000).alias("ha"))
    return rounded(P.pixels_per_parcel(z, "stratum", "ha"), 6)


@query("A38_outcome_counts", "WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'skipped' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'done' END AS status FROM orders) SELECT status, count(*) AS n FROM s GROUP BY 1")
def _(spark, d):
    done = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("__d", F.lit(True))
    o = table(spark, d, "orders").join(done, "o_orderkey", "left")
    status = F.when(F.col("__d"), "skipped").when(F.col("o_orderstatus") == "P", "failed").otherwise("done")
    return P.outcome_counts(o.withColumn("status", status))


@query("W3_check_report", "WITH " + POLYGONS_SQL + """, f AS (SELECT DISTINCT source_file FROM images), b AS (SELECT i.source_file, count(*) AS n FROM images i WHERE irrigation = 5 AND unique_id NOT IN (SELECT unique_id FROM polygons) GROUP BY 1)
SELECT source_file, CASE WHEN n IS NULL THEN 'All checks passed successfully.' ELSE n || ' rows without polygons' END AS message FROM f LEFT JOIN b USING (source_file)""")
def _(spark, d):
    from ..sources.sinks import report_lines
    i = images(spark, d)
    bad = i.filter("irrigation = 5").join(polygons(spark, d), "unique_id", "left_anti").groupBy("source_file").agg(
        F.concat(F.count("*").cast("string"), F.lit(" rows without polygons")).alias("message"))
    return report_lines(i.select("source_file").distinct(), bad)


@query("W5_metric_documents", "WITH " + SCORES_SQL + """, m AS (SELECT fold, stratum, pred, count(*) AS n, round(avg(CAST(y = pred AS INTEGER)), 3) AS acc FROM scores GROUP BY ALL),
c AS (SELECT fold, stratum, string_agg('"' || pred || '":{"accuracy":' || CAST(acc AS VARCHAR) || ',"n":' || CAST(n::DOUBLE AS VARCHAR) || '}', ',' ORDER BY pred) AS j FROM m GROUP BY ALL)
SELECT fold, '{"stratum":{' || string_agg('"' || stratum || '":{' || j || '}', ',' ORDER BY stratum) || '}}' AS document FROM c GROUP BY fold""")
def _(spark, d):
    from ..sources.sinks import metric_documents

    m = scores(spark, d).groupBy("fold", "stratum", "pred").agg(F.count("*").cast("double").alias("n"), F.round(F.avg((F.col("y") == F.col("pred")).cast("double")), 3).alias("accuracy"))
    long = m.select(
        "fold", F.lit("stratum").alias("factor"), F.col("stratum").alias("category"), F.col("pred").cast("string").alias("class"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in ("n", "accuracy")])))
    return metric_documents(long, "fold")


@query("A31_importance_by_band", """
WITH i AS (SELECT u.pos, 'B' || (u.pos % 8 + 1) AS band, u.pos // 8 + 1 AS time_step, sum(abs(CAST(embedding[CAST(u.pos + 1 AS INTEGER)] AS DOUBLE))) AS importance FROM embeddings, (SELECT unnest(range(0, 64)) AS pos) u GROUP BY 1)
SELECT band, round(sum(importance), 4) AS importance FROM i GROUP BY 1""")
def _(spark, d):
    return rounded(E.importance_totals(_importance(spark, d), "band"), 4)


def _importance(spark, d):
    """Absolute size of each embedding position as a stand-in importance vector, laid out time-major over 8 bands."""
    pos = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("pos", "v")).groupBy("pos").agg(F.sum(F.abs(F.col("v").cast("double"))).alias("importance"))
    return E.label_importances(pos, [f"B{i + 1}" for i in range(8)])


@query("A31_importance_by_time", """
WITH i AS (SELECT u.pos, CAST(u.pos // 8 + 1 AS INTEGER) AS time_step, sum(abs(CAST(embedding[CAST(u.pos + 1 AS INTEGER)] AS DOUBLE))) AS importance FROM embeddings, (SELECT unnest(range(0, 64)) AS pos) u GROUP BY 1)
SELECT time_step, round(sum(importance), 4) AS importance FROM i GROUP BY 1""")
def _(spark, d):
    return rounded(E.importance_totals(_importance(spark, d), "time_step"), 4)


@query("A32_importance_matrix_filled", """
WITH i AS (SELECT u.pos % 8 AS b, u.pos // 8 + 1 AS t, sum(abs(CAST(embedding[CAST(u.pos + 1 AS INTEGER)] AS DOUBLE))) AS imp FROM embeddings, (SELECT unnest(range(0, 64)) AS pos) u GROUP BY 1, 2),
b AS (SELECT unnest(range(0, 10)) AS b)
SELECT 'B' || (b.b + 1) AS band, """ + ", ".join(f'round(coalesce(max(imp) FILTER (t = {t}), 0), 4) AS "t{t}"' for t in range(1, 10)) + " FROM b LEFT JOIN i ON i.b = b.b GROUP BY 1")
def _(spark, d):
    return rounded(E.importance_matrix(_importance(spark, d), [f"B{i + 1}" for i in range(10)], 9), 4)
