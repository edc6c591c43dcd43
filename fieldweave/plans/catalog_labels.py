"""Registered queries: scalar rules, filters, joins, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as X
from ..functions import values as V
from ..operators import agreement as A
from ..operators import labels as L
from ..operators import ranking as R
from .registry import IMAGES_SQL, POLYGONS_SQL, images, polygons, query, table


def _r(c, n=6):
    return F.round(c, n)


@query("P1_placemark_name", """
WITH b AS (SELECT c_custkey, (CASE WHEN c_custkey % 5 = 0 THEN 'ab' ELSE 'JL' END) || '_' ||
    (CASE WHEN c_custkey % 11 = 3 THEN 'x1' ELSE CAST(c_custkey AS VARCHAR) END) || '_' || (c_custkey % 12 + 1) || '.' ||
    (CASE WHEN c_custkey % 13 = 4 THEN '20' ELSE CAST(c_custkey % 28 + 1 AS VARCHAR) || '.' ||
      (CASE c_custkey % 4 WHEN 0 THEN '19' WHEN 1 THEN '202' ELSE '2021' END) END) AS name FROM customer),
s AS (SELECT *, string_split(name, '_') AS bits FROM b),
d AS (SELECT *, string_split(bits[3], '.') AS dd, TRY_CAST(bits[2] AS INTEGER) AS num FROM s),
v AS (SELECT *, TRY_CAST(dd[1] AS INTEGER) AS mm, TRY_CAST(dd[2] AS INTEGER) AS ddd,
  CASE WHEN len(dd) = 3 THEN TRY_CAST(dd[3] AS INTEGER) END AS yy FROM d)
SELECT name, CASE WHEN num IS NOT NULL THEN upper(bits[1]) END AS operator_initials, num AS internal_id,
  CASE WHEN num IS NOT NULL AND len(dd) = 3 THEN mm END AS month,
  CASE WHEN num IS NOT NULL AND len(dd) = 3 THEN ddd END AS day,
  CASE WHEN num IS NOT NULL AND len(dd) = 3 THEN (CASE WHEN yy < 100 AND yy > 9 THEN yy + 2000 ELSE yy END) END AS year,
  CASE WHEN num IS NULL THEN 'error' WHEN len(dd) <> 3 THEN 'date_parts' WHEN yy > 999 THEN 'ok' WHEN yy > 9 AND yy < 100 THEN 'year_fixed' ELSE 'year_odd' END AS parse_status
FROM v""")
def _(spark, d):
    k = F.col("c_custkey")
    name = F.concat(
        F.when(k % 5 == 0, "ab").otherwise("JL"), F.lit("_"), F.when(k % 11 == 3, "x1").otherwise(k.cast("string")), F.lit("_"),
        (k % 12 + 1).cast("string"), F.lit("."),
        F.when(k % 13 == 4, "20").otherwise(F.concat((k % 28 + 1).cast("string"), F.lit("."),
                                                     F.when(k % 4 == 0, "19").when(k % 4 == 1, "202").otherwise("2021"))))
    return table(spark, d, "customer").select(name.alias("name")).withColumn("p", K.placemark_parts("name")).select("name", "p.*")


@query("P2_description_certainty", """
SELECT doc_id, CAST(CASE WHEN doc_id % 10 < 7 THEN doc_id % 10 ELSE 5 END AS INTEGER) AS certainty,
  length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) = 0 AS is_blank FROM documents""")
def _(spark, d):
    k = F.col("doc_id") % 10
    desc = F.concat(F.lit("\n "), F.when(k < 7, k.cast("string")).otherwise("x"), F.lit("\n"), F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", X.certainty_of(desc).alias("certainty"), (F.length(X.strip("text")) == 0).alias("is_blank"))


@query("P3_normalize_text", """
SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '[^a-z\\s]', '', 'g')) AS digest,
  CAST(length(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '[^a-z\\s]', '', 'g')) AS INTEGER) AS n FROM documents""")
def _(spark, d):
    t = X.normalize("text")
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("n"))


@query("P6_valid_date", """
SELECT o_orderkey, TRY_CAST((year(o_orderdate) || '-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 32 AS VARCHAR), 2, '0')) AS DATE) AS d FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", K.ymd_date(F.year("o_orderdate"), F.col("o_orderkey") % 14, F.col("o_orderkey") % 32).alias("d"))


@query("P7_operator_names", "WITH " + IMAGES_SQL + """
SELECT unique_id, string_split(replace(source_file, '_v2_', '_'), '_')[1] AS final_operator,
  string_split(string_split('raw/' || source_file || '/1/' || internal_id || '.xml', '/')[2], '_')[1] AS path_operator FROM images""")
def _(spark, d):
    path = F.concat(F.lit("raw/"), F.col("source_file"), F.lit("/1/"), F.col("internal_id").cast("string"), F.lit(".xml"))
    return images(spark, d).select(
        "unique_id", K.final_operator().alias("final_operator"), K.operator_from_path(path).alias("path_operator"))


@query("P8_internal_id_by_line", """
WITH s AS (SELECT 'id_' || p_partkey AS id, 'f_' || p_partkey // 25 AS plot_file, row_number() OVER (PARTITION BY p_partkey // 25 ORDER BY p_partkey) AS line_no FROM part WHERE p_partkey % 7 <> 3),
t AS (SELECT * FROM s UNION ALL SELECT id, 'other', line_no + 40 FROM s WHERE line_no % 2 = 0)
SELECT o_orderkey, t.line_no AS internal_id FROM orders JOIN t ON 'id_' || o_custkey = t.id AND CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE 'f_' || o_custkey // 25 END = t.plot_file""")
def _(spark, d):
    """Every second site is in two sample files, on different lines."""
    from ..sources.surveys import internal_ids

    sample = table(spark, d, "part").filter("p_partkey % 7 <> 3").select(
        F.concat(F.lit("id_"), F.col("p_partkey").cast("string")).alias("id"), F.expr("p_partkey div 25").alias("file"), "p_partkey")
    own = F.concat(F.lit("f_"), F.expr("o_custkey div 25").cast("string"))
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("id_"), F.col("o_custkey").cast("string")).alias("site_id"), F.when(F.col("o_orderkey") % 3 == 0, "other").otherwise(own).alias("plot_file"))
    from pyspark.sql import Window
    line = F.row_number().over(Window.partitionBy("file").orderBy("p_partkey")).cast("long")
    first = sample.withColumn("line_no", line).select("id", F.concat(F.lit("f_"), F.col("file").cast("string")).alias("plot_file"), "line_no")
    second = first.filter("line_no % 2 = 0").select("id", F.lit("other").alias("plot_file"), (F.col("line_no") + 40).alias("line_no"))
    return internal_ids(rows, first.unionByName(second)).select("o_orderkey", "internal_id")


@query("P9_image_and_file_ids", "WITH " + IMAGES_SQL + """
SELECT unique_id, image_id, site_num || '_' || year || '.' || lpad(CAST(month AS VARCHAR), 2, '0') || '.' || lpad(CAST(day AS VARCHAR), 2, '0') AS file_id FROM images""")
def _(spark, d):
    return images(spark, d).select("unique_id", "image_id", K.file_id().alias("file_id"))


@query("P10_survey_id", "WITH " + IMAGES_SQL + """
SELECT unique_id, nullif(regexp_extract(source_file, '(\\d+-\\d+)', 1), '') AS survey_id,
  CAST(split_part(regexp_extract(source_file, '(\\d+-\\d+)', 1), '-', 1) AS INTEGER) AS range_start FROM images""")
def _(spark, d):
    return images(spark, d).select("unique_id", K.survey_id().alias("survey_id"), K.range_start(K.survey_id()).alias("range_start"))


@query("P11_screenshot_name", """
WITH b AS (SELECT c_custkey, (c_custkey // 25 * 25 + 1) || '-' || (c_custkey // 25 * 25 + 25) AS survey, CAST(c_custkey % 25 + 1 AS INTEGER) AS internal_id,
  CAST(c_custkey % 12 + 1 AS INTEGER) AS month, CAST(c_custkey % 28 + 1 AS INTEGER) AS day, CAST(c_custkey % 100 AS INTEGER) AS yy FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN survey END AS survey, CASE WHEN c_custkey % 9 <> 0 THEN internal_id END AS internal_id,
  CASE WHEN c_custkey % 9 <> 0 THEN month END AS month, CASE WHEN c_custkey % 9 <> 0 THEN day END AS day,
  CASE WHEN c_custkey % 9 <> 0 THEN (CASE WHEN yy < 50 THEN 2000 + yy ELSE 1900 + yy END) END AS year FROM b""")
def _(spark, d):
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    name = F.concat(
        F.lit("shots/"), F.when(k % 9 == 0, "bad").otherwise(F.concat(s(F.expr("c_custkey div 25 * 25 + 1")), F.lit("-"), s(F.expr("c_custkey div 25 * 25 + 25")))),
        F.lit("_"), s(k % 25 + 1), F.when(k % 2 == 0, "_").otherwise("-"),
        F.lpad(s(k % 12 + 1), 2, "0"), F.lit("-"), F.lpad(s(k % 28 + 1), 2, "0"), F.lit("-"), F.lpad(s(k % 100), 2, "0"), F.lit(".png"))
    return table(spark, d, "customer").select("c_custkey", K.screenshot_parts(name).alias("p")).select("c_custkey", "p.*")


STEMS_SQL = """
stems AS (SELECT o_orderkey, CASE o_orderkey % 4
   WHEN 0 THEN o_orderkey || '_' || o_custkey || '_' || strftime(o_orderdate, '%Y.%m.%d') || '_image'
   WHEN 1 THEN o_orderkey || '_' || o_custkey || '_' || strftime(o_orderdate, '%Y.%m.%d') || '_KL_label'
   WHEN 2 THEN o_orderkey || '_' || o_custkey || '_' || strftime(o_orderdate, '%Y.%m.%d') || '_label'
   ELSE 'site_' || o_custkey || '_x_2020_' || o_orderkey END AS stem FROM orders)
"""


def _stems(spark, d):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    base = F.concat(s(k), F.lit("_"), s(F.col("o_custkey")), F.lit("_"), F.date_format(F.col("o_orderdate"), "yyyy.MM.dd"))
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey",
        F.when(k % 4 == 0, F.concat(base, F.lit("_image"))).when(k % 4 == 1, F.concat(base, F.lit("_KL_label")))
        .when(k % 4 == 2, F.concat(base, F.lit("_label")))
        .otherwise(F.concat(F.lit("site_"), s(F.col("o_custkey")), F.lit("_x_2020_"), s(k))).alias("stem"))


@query("P12_stem_parts", "WITH " + STEMS_SQL + """
SELECT stem,
  CASE WHEN o_orderkey % 4 IN (0, 2) THEN split_part(stem, '_', 1) END AS uid,
  CASE WHEN o_orderkey % 4 IN (0, 2) THEN split_part(stem, '_', 2) END AS site,
  CASE WHEN o_orderkey % 4 IN (0, 2) THEN split_part(stem, '_', 3) END AS date,
  CASE WHEN o_orderkey % 4 = 0 THEN 'image' WHEN o_orderkey % 4 = 2 THEN 'label' END AS kind,
  CASE WHEN o_orderkey % 4 IN (0, 3) THEN CAST(o_orderkey AS VARCHAR) END AS raw_uid,
  CASE WHEN o_orderkey % 4 IN (1, 2) THEN split_part(stem, '_', 2) END AS mask_site,
  CASE WHEN o_orderkey % 4 = 3 THEN stem ELSE split_part(stem, '_', 1) || '_' || split_part(stem, '_', 2) || '_' || split_part(stem, '_', 3) END AS pair_id
FROM stems""")
def _(spark, d):
    tif = F.concat("stem", F.lit(".tif"))
    return _stems(spark, d).select(
        "stem", K.stem_parts("stem").alias("p"), K.raw_image_parts(tif)["uid"].alias("raw_uid"),
        K.raw_mask_parts(tif)["site"].alias("mask_site"), K.pair_id("stem").alias("pair_id"),
    ).select("stem", "p.*", "raw_uid", "mask_site", "pair_id")


@query("P13_shift_dates", "WITH " + IMAGES_SQL + """, s AS (
SELECT unique_id, CASE WHEN operator_initials = 'PS' THEN CAST(image_date - INTERVAL 1 DAY AS DATE) ELSE image_date END AS n FROM images)
SELECT unique_id, CAST(year(n) AS INTEGER) AS year, CAST(month(n) AS INTEGER) AS month, CAST(day(n) AS INTEGER) AS day FROM s""")
def _(spark, d):
    return V.shift_back_one_day(images(spark, d)).select("unique_id", "year", "month", "day")


@query("P14_area_category", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 AND l_extendedprice * 2 > 100000 THEN 'industrial'
  WHEN l_partkey % 2 = 0 THEN 'small-scale' ELSE 'lawn' END AS category FROM lineitem""")
def _(spark, d):
    cat = F.when(F.col("l_partkey") % 2 == 0, "small-scale").otherwise("lawn")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", V.area_category(cat, F.col("l_extendedprice") * 2).alias("category"))


@query("P15_code_names", "WITH " + IMAGES_SQL + """
SELECT unique_id, CASE irrigation WHEN 1 THEN 'No irrigation' WHEN 2 THEN 'Low certainty' WHEN 3 THEN 'Medium certainty'
  WHEN 4 THEN 'High certainty' ELSE 'Unknown' END AS code_name,
  replace(replace(lower(CASE irrigation WHEN 1 THEN 'No irrigation' ELSE 'Small-scale Farm' END), ' ', '_'), '-', '_') AS class_key FROM images""")
def _(spark, d):
    code = F.when(F.col("irrigation") == 5, 9).otherwise(F.col("irrigation"))
    return images(spark, d).select(
        "unique_id", V.code_name(code).alias("code_name"),
        V.class_key(F.when(F.col("irrigation") == 1, "No irrigation").otherwise("Small-scale Farm")).alias("class_key"))


@query("P16_binary_target", "WITH " + IMAGES_SQL + """
SELECT unique_id, CAST(irrigation >= 2 AS INTEGER) AS target_model, CAST(irrigation >= 3 AS INTEGER) AS target_report FROM images""")
def _(spark, d):
    return images(spark, d).select("unique_id", V.is_positive(minimum=2).alias("target_model"), V.is_positive(minimum=3).alias("target_report"))


@query("P17_farm_class", """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN s IS NULL THEN 'none' WHEN s < 500 THEN 'smallholder' WHEN s < 5000 THEN 'medium' ELSE 'large' END AS class_m2,
  CASE WHEN target = 0 THEN 'none' WHEN s IS NULL OR s <= 0 THEN 'unknown' WHEN s / 1000 < 2 THEN 'smallholder' WHEN s / 1000 < 10 THEN 'medium' ELSE 'large' END AS class_ha
FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice / 5 END AS s, l_partkey % 3 AS target FROM lineitem)""")
def _(spark, d):
    s = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 5)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", V.farm_class_m2(s).alias("class_m2"),
        V.farm_class_ha(F.col("l_partkey") % 3, s / 1000).alias("class_ha"))


@query("P18_unit_detection", """
WITH m AS (SELECT median(l_extendedprice) AS med FROM lineitem WHERE l_linenumber > 2)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN med < 100 THEN l_extendedprice ELSE l_extendedprice / 10000 END, 8) AS size_ha FROM lineitem, m""")
def _(spark, d):
    from ..operators.reports import size_in_hectares

    li = table(spark, d, "lineitem")
    return size_in_hectares(li, "l_extendedprice", F.col("l_linenumber") > 2).select(
        "l_orderkey", "l_linenumber", "l_partkey", _r("size_ha", 8).alias("size_ha"))


@query("P19_nearest_province", """
WITH p AS (SELECT c_custkey, 22 + (c_custkey % 1100) / 100.0::DOUBLE AS x, -18 + (c_custkey * 7 % 1000) / 100.0::DOUBLE AS y FROM customer),
c(name, cx, cy) AS (VALUES ('Central',28.5,-14.5),('Copperbelt',27.8,-13.0),('Eastern',32.0,-13.5),('Luapula',29.0,-11.0),('Lusaka',28.7,-15.4),
  ('Muchinga',32.0,-11.5),('Northern',31.3,-10.0),('North-Western',25.0,-13.0),('Southern',27.0,-16.5),('Western',23.5,-15.0))
SELECT c_custkey, arg_min(name, round((x - cx) * (x - cx) + (y - cy) * (y - cy), 9)) AS province FROM p, c GROUP BY c_custkey""")
def _(spark, d):
    return points(spark, d).select("c_custkey", V.nearest_centroid("x", "y").alias("province"))


def points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey", (22 + (k % 1100) / 100.0).alias("x"), (-18 + (k * 7 % 1000) / 100.0).alias("y"))


@query("P20_log1p", """
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax = 0 THEN 0 ELSE ln(1 + l_tax * 100) END, 6) AS log_coverage FROM lineitem""")
def _(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", _r(V.log1p_or_zero(F.col("l_tax") * 100)).alias("log_coverage"))


@query("P21_band_columns", "WITH e AS (SELECT vec_id, embedding[1] AS b0, embedding[8] AS b7, embedding[3] AS b2 FROM embeddings) SELECT vec_id, b0 AS \"B2\", b7 AS \"B8A\", b2 AS \"B4\" FROM e")
def _(spark, d):
    from ..operators.stacks import BAND_NAMES, select_bands

    wide = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].alias(n) for i, n in enumerate(BAND_NAMES)])
    return select_bands(wide, ["B2", 7, "B4"], keep=["vec_id"])


@query("P22_derived_dates", "WITH " + IMAGES_SQL + """
SELECT unique_id, image_date AS d, CAST(date_diff('day', DATE '1996-06-30', image_date) AS INTEGER) AS days FROM images""")
def _(spark, d):
    return images(spark, d).select("unique_id", K.ymd_date().alias("d"), F.datediff(K.ymd_date(), F.lit("1996-06-30").cast("date")).alias("days"))


@query("P23_numeric_id", "SELECT CAST(replace('id_' || n_nationkey, 'id_', '') AS INTEGER) AS location_num, n_name AS district FROM nation")
def _(spark, d):
    raw = table(spark, d, "nation").withColumn("site_id", F.concat(F.lit("id_"), F.col("n_nationkey").cast("string")))
    return raw.withColumn("location_num", K.site_number()).drop("site_id", "n_nationkey", "n_regionkey").withColumnRenamed("n_name", "district")


# --- filters ------------------------------------------------------------------

@query("F1_operators", "WITH " + IMAGES_SQL + " SELECT unique_id, operator_initials FROM images WHERE operator_initials IN ('AB','KL','MV')")
def _(spark, d):
    from ..operators.filters import keep_operators
    return keep_operators(images(spark, d), ["AB", "KL", "MV"]).select("unique_id", "operator_initials")


@query("F2_min_certainty", "WITH " + POLYGONS_SQL + " SELECT unique_id, poly_order, l_partkey, certainty FROM polygons WHERE certainty >= 3")
def _(spark, d):
    from ..operators.filters import min_certainty
    return min_certainty(polygons(spark, d), 3).select("unique_id", "poly_order", "l_partkey", "certainty")


@query("F3_first_per_image", "WITH " + IMAGES_SQL + """
SELECT site_id, image_date, arg_min(internal_id, unique_id) AS internal_id, min(unique_id) AS first_row, count(*) AS n_rows FROM images GROUP BY 1, 2""")
def _(spark, d):
    return images(spark, d).groupBy("site_id", "image_date").agg(
        F.min_by("internal_id", "unique_id").alias("internal_id"), F.min("unique_id").alias("first_row"), F.count("*").alias("n_rows"))


@query("F4_survey_membership", "WITH " + IMAGES_SQL + """
SELECT unique_id, contains(source_file, '26-50') OR contains(source_file, '76-100') AS in_surveys FROM images WHERE NOT contains(source_file, 'MV_51-75')""")
def _(spark, d):
    return images(spark, d).filter(~F.col("source_file").contains("MV_51-75")).select(
        "unique_id", V.contains_any("source_file", ["26-50", "76-100"]).alias("in_surveys"))


@query("F5_grid_filter", "SELECT p_partkey, p_size / 50.0::DOUBLE AS agriculture FROM part WHERE p_size > 0 AND p_size / 50.0::DOUBLE > 0.05 AND p_type = 'ECONOMY'")
def _(spark, d):
    from ..operators.filters import grid_filter
    g = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("agriculture"), F.col("p_type").alias("country"))
    return grid_filter(g, 0.05, "ECONOMY").select("p_partkey", "agriculture")


@query("F6_dashboard_filter", "WITH " + IMAGES_SQL + """
SELECT unique_id FROM images WHERE percent_coverage > 0 AND water_source = 'true' AND year BETWEEN 1994 AND 1997 AND irrigation >= 2""")
def _(spark, d):
    from ..operators.filters import dashboard_filter
    return dashboard_filter(images(spark, d), coverage="percent_coverage", certainty="irrigation", years=(1994, 1997),
                            least_certainty=2, water_source="true", show_zero=False).select("unique_id")


RULE_SQL = POLYGONS_SQL + """,
agg AS (SELECT unique_id, count(*) AS n, max(certainty) AS top FROM polygons GROUP BY 1),
j AS (SELECT i.unique_id, i.irrigation, i.internal_id, i.year, i.month, i.day, coalesce(n, 0) AS n, top FROM images i LEFT JOIN agg USING (unique_id)),
broken AS (
  SELECT *, 1 AS rule FROM j WHERE irrigation = 1 AND n > 0 UNION ALL
  SELECT *, 2 FROM j WHERE irrigation > 1 AND n = 0 UNION ALL
  SELECT *, 3 FROM j WHERE irrigation = 5 AND (n = 0 OR top < 5) UNION ALL
  SELECT *, 4 FROM j WHERE irrigation IN (2, 3, 4) AND n > 0 AND top > 4)
"""


@query("F7_consistency_rules", "WITH " + RULE_SQL + """
SELECT unique_id, rule, 'Row ' || unique_id || ' (internal_id ' || internal_id || ', ' || day || '/' || month || '/' || year || '): ' ||
  CASE rule WHEN 1 THEN 'survey marked irrigation as 1 (no irrigation) but found ' || n || ' matching polygon(s).'
  WHEN 2 THEN 'survey marked irrigation ' || irrigation || ' (possible irrigation) but no matching polygons found.'
  WHEN 3 THEN 'survey marked irrigation 5 (definitely irrgation) but no polygon with certainty 5 found.'
  ELSE 'survey marked irrigation ' || irrigation || ' (uncertain) but found a polygon with certainty 5 (certain).' END AS message FROM broken""")
def _(spark, d):
    agg = polygons(spark, d).groupBy("unique_id").agg(F.count("*").alias("n_polygons"), F.max("certainty").alias("max_certainty"))
    rows = images(spark, d).join(agg, "unique_id", "left")
    return L.consistency_issues(rows).select("unique_id", "rule", L.issue_message("unique_id").alias("message"))


@query("F10_surveys_with_warnings", "WITH " + RULE_SQL + """
SELECT i.source_file, count(*) AS n_warnings FROM broken b JOIN images i USING (unique_id) WHERE contains(i.source_file, '_v2_') GROUP BY 1""")
def _(spark, d):
    from ..operators.filters import latest_with_warnings
    agg = polygons(spark, d).groupBy("unique_id").agg(F.count("*").alias("n_polygons"), F.max("certainty").alias("max_certainty"))
    rows = images(spark, d).join(agg, "unique_id", "left")
    latest = images(spark, d).filter(F.col("source_file").contains("_v2_")).select("source_file")
    return latest_with_warnings(L.consistency_issues(rows), latest)


@query("F11_obsolete_files", "WITH " + IMAGES_SQL + " SELECT DISTINCT source_file FROM images WHERE source_file NOT IN (SELECT source_file FROM images WHERE contains(source_file, '_v2_') AND irrigation >= 2)")
def _(spark, d):
    from ..operators.filters import not_latest
    i = images(spark, d)
    return not_latest(i.select("source_file"), i.filter(F.col("source_file").contains("_v2_") & (F.col("irrigation") >= 2)).select("source_file"))


@query("F14_duplicate_coordinates", "WITH " + IMAGES_SQL + """
SELECT site_id, count(DISTINCT (x, CASE WHEN irrigation = 5 THEN y + 1 ELSE y END)) AS n_unique_coords FROM images GROUP BY 1 HAVING count(DISTINCT (x, CASE WHEN irrigation = 5 THEN y + 1 ELSE y END)) > 1""")
def _(spark, d):
    from ..operators.filters import duplicate_coordinates
    y = F.when(F.col("irrigation") == 5, F.col("y") + 1).otherwise(F.col("y"))
    return duplicate_coordinates(images(spark, d).withColumn("y", y))


@query("F15_duplicate_ids", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    from ..operators.filters import repeated_ids
    return repeated_ids(table(spark, d, "orders"), "o_custkey")


@query("F16_scene_candidates", """
WITH s AS (SELECT event_id, CAST(ts AS DATE) AS acquired, (event_id * 37 % 101) / 100.0::DOUBLE AS cloud, event_type FROM events)
SELECT acquired, count(*) AS in_range, count(*) FILTER (event_type IN ('view', 'click')) AS accessible, count(*) FILTER (event_type NOT IN ('view', 'click')) AS dropped
FROM s WHERE acquired BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND cloud <= 0.5 GROUP BY 1""")
def _(spark, d):
    from ..operators.scenes import candidate_scenes, candidate_summary
    k = F.col("event_id")
    s = table(spark, d, "events").select(
        k.alias("scene_id"), F.col("ts").cast("date").alias("acquired"), ((k * 37 % 101) / 100.0).alias("cloud_cover"),
        F.array(F.concat(F.lit("assets."), F.col("event_type"), F.lit(":download"))).alias("permissions"))
    flagged = candidate_scenes(s, "2024-01-05", "2024-01-20", 0.5, ["view", "click"])
    return candidate_summary(flagged, "acquired")


# --- joins --------------------------------------------------------------------

J1_SQL = """
sv AS (SELECT o_orderkey AS sid, CAST(o_custkey AS INTEGER) AS site_no, CAST(o_orderkey % 50 + 1 AS INTEGER) AS internal_id, CAST(o_orderdate AS DATE) AS dt, o_orderkey AS line FROM orders),
pg AS (SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS pid, CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey % 50 + 1 ELSE o_custkey END AS INTEGER) AS internal_id,
  CAST(o_orderdate AS DATE) AS dt, l_linenumber % 5 + 1 AS certainty, l_extendedprice AS area FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT DISTINCT sid, pid FROM sv JOIN pg ON sv.dt = pg.dt AND (pg.internal_id = sv.internal_id OR pg.internal_id = sv.site_no))
"""


def _survey_side(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("sid"), F.concat(F.lit("id_"), F.col("o_custkey").cast("string")).alias("site_id"),
        (F.col("o_orderkey") % 50 + 1).cast("int").alias("internal_id"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("line"))


def _polygon_side(spark, d):
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pid"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey") % 50 + 1).otherwise(F.col("o_custkey")).cast("int").alias("internal_id"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"),
        (F.col("l_linenumber") % 5 + 1).alias("certainty"), F.col("l_extendedprice").alias("polygon_area_m2"))


def _matches(spark, d):
    return L.survey_polygon_matches(_survey_side(spark, d), _polygon_side(spark, d), "sid", "pid")


@query("J1_survey_polygon_match", "WITH " + J1_SQL + " SELECT sid, pid FROM m")
def _(spark, d):
    return _matches(spark, d)


@query("F8_unmatched_polygons", "WITH " + J1_SQL.replace("FROM orders),\npg", "FROM orders WHERE o_orderstatus <> 'P'),\npg") + " SELECT DISTINCT pid FROM pg WHERE pid NOT IN (SELECT pid FROM m)")
def _(spark, d):
    """Polygons that no survey row matches by date and id or site number; orders of one status are not surveyed."""
    surveyed = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("sid"))
    return L.unmatched_polygons(_survey_side(spark, d).join(surveyed, "sid", "left_semi"), _polygon_side(spark, d), "sid", "pid")


@query("J2_polygon_site", "WITH " + J1_SQL + ", k AS (SELECT pid, max(sid) AS sid FROM m GROUP BY 1) SELECT pid, 'id_' || site_no AS site_id FROM k JOIN sv USING (sid)")
def _(spark, d):
    return L.polygon_site(_survey_side(spark, d), _polygon_side(spark, d), "sid", "pid", "line")


@query("A1_polygon_stats", "WITH " + J1_SQL + """, pu AS (SELECT pid, certainty, area FROM pg)
SELECT sid, count(*) AS n_polygons, max(certainty) AS max_certainty, round(avg(area), 6) AS poly_avg_size,
 round(avg(area) FILTER (certainty >= 3), 6) AS poly_avg_size_hc, min(area) AS poly_min_size, min(area) FILTER (certainty >= 3) AS poly_min_size_hc
FROM m JOIN pu USING (pid) GROUP BY 1""")
def _(spark, d):
    s = L.polygon_stats(_survey_side(spark, d), _polygon_side(spark, d), "sid", "pid")
    return s.withColumns({c: _r(c) for c in ("poly_avg_size", "poly_avg_size_hc")})


@query("J3_attach_survey_info", "WITH " + POLYGONS_SQL + """, info AS (SELECT DISTINCT site_id, internal_id, year, month, day, plot_file, x FROM images WHERE irrigation >= 3)
SELECT p.unique_id, p.poly_order, p.l_partkey, info.plot_file, info.x FROM polygons p LEFT JOIN info USING (site_id, internal_id, year, month, day)""")
def _(spark, d):
    sv = images(spark, d).filter("irrigation >= 3")
    return L.attach_survey_info(polygons(spark, d), sv, ["plot_file", "x"]).select("unique_id", "poly_order", "l_partkey", "plot_file", "x")


@query("J4_repair_internal_id", "WITH " + IMAGES_SQL + """, p AS (SELECT unique_id, CASE WHEN unique_id % 2 = 0 THEN site_id END AS site_id, source_file,
  CAST(CASE WHEN unique_id % 3 = 0 THEN site_num ELSE internal_id END AS INTEGER) AS internal_id, site_num FROM images),
ids AS (SELECT site_id, max(internal_id) AS fixed FROM images GROUP BY 1)
SELECT unique_id, CASE WHEN p.site_id IS NOT NULL AND p.internal_id = p.site_num THEN coalesce(fixed, p.internal_id) ELSE p.internal_id END AS internal_id,
  split_part(replace(source_file, '_v2_', '_'), '_', 1) AS operator_initials FROM p LEFT JOIN ids ON p.site_id = ids.site_id""")
def _(spark, d):
    i = images(spark, d)
    p = i.select(
        "unique_id", F.when(F.col("unique_id") % 2 == 0, F.col("site_id")).alias("site_id"), "source_file",
        F.when(F.col("unique_id") % 3 == 0, F.col("site_num")).otherwise(F.col("internal_id")).cast("int").alias("internal_id"))
    return L.repair_internal_id(p, i).select("unique_id", "internal_id", "operator_initials")


def match_sql(k: int) -> str:
    return f"""
im AS (SELECT DISTINCT site_id, image_date, operator_initials FROM images),
mt AS (SELECT c.operator_initials AS comp_op, g.site_id, g.image_date AS gt_date,
   min((abs(date_diff('day', g.image_date, c.image_date)) * 100000 + date_diff('day', DATE '1970-01-01', c.image_date))) AS code
  FROM im g JOIN im c ON g.site_id = c.site_id AND c.operator_initials <> 'KL' AND abs(date_diff('day', g.image_date, c.image_date)) <= {k}
  WHERE g.operator_initials = 'KL' GROUP BY 1, 2, 3),
mm AS (SELECT comp_op, site_id, gt_date, CAST(DATE '1970-01-01' + CAST(code % 100000 AS INTEGER) AS DATE) AS comp_date, CAST(code // 100000 AS INTEGER) AS date_diff FROM mt)
"""


COUNTS_SQL = match_sql(1) + """,
pc AS (SELECT site_id, image_date, operator_initials, count(*) AS n FROM polygons WHERE certainty >= 3 GROUP BY 1, 2, 3),
mc AS (SELECT mm.*, coalesce(g.n, 0) AS n_gt, coalesce(c.n, 0) AS n_comp FROM mm
  LEFT JOIN pc g ON g.site_id = mm.site_id AND g.image_date = mm.gt_date AND g.operator_initials = 'KL'
  LEFT JOIN pc c ON c.site_id = mm.site_id AND c.image_date = mm.comp_date AND c.operator_initials = mm.comp_op)
"""


def match_counts(spark, d, tolerance=1):
    m = A.nearest_date_matches(images(spark, d), "KL", tolerance=tolerance)
    return A.attach_counts(m, A.polygon_counts(polygons(spark, d)), "KL")


@query("J5_nearest_date_match", "WITH " + IMAGES_SQL + "," + match_sql(1) + " SELECT * FROM mm")
def _(spark, d):
    return A.nearest_date_matches(images(spark, d), "KL", tolerance=1)


@query("J5_nearest_date_match_30_days", "WITH " + IMAGES_SQL + "," + match_sql(30) + " SELECT * FROM mm")
def _(spark, d):
    return A.nearest_date_matches(images(spark, d), "KL", tolerance=30)


@query("J6_match_polygon_counts", "WITH " + POLYGONS_SQL + "," + COUNTS_SQL + " SELECT * FROM mc")
def _(spark, d):
    return match_counts(spark, d)


@query("F9_images_with_polygons", "WITH " + POLYGONS_SQL + "," + COUNTS_SQL + " SELECT DISTINCT site_id, gt_date FROM mc WHERE n_gt > 0 OR n_comp > 0 ORDER BY 1, 2")
def _(spark, d):
    return A.images_with_polygons(match_counts(spark, d))


@query("A2_detection_metrics", "WITH " + POLYGONS_SQL + "," + COUNTS_SQL + """, c AS (SELECT comp_op, count(*) FILTER (n_gt > 0 AND n_comp > 0) AS tp, count(*) FILTER (n_gt = 0 AND n_comp > 0) AS fp,
 count(*) FILTER (n_gt > 0 AND n_comp = 0) AS fn, count(*) FILTER (n_gt = 0 AND n_comp = 0) AS tn FROM mc GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS rc FROM c)
SELECT comp_op, tp, fp, fn, tn, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1,
 round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END, 6) AS fpr, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp)::DOUBLE ELSE 0 END, 6) AS fnr, tp + fp + fn + tn AS total_images FROM r""")
def _(spark, d):
    return rounded(A.detection_metrics(match_counts(spark, d)))


def rounded(df, n=6, keep=()):
    return df.select(*[_r(c, n).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes])


@query("A37_image_comparison", "WITH " + POLYGONS_SQL + "," + COUNTS_SQL + """
SELECT site_id, gt_date, n_gt, max(n_comp) FILTER (comp_op = 'AB') AS "AB", max(n_comp) FILTER (comp_op = 'DSB') AS "DSB", max(n_comp) FILTER (comp_op = 'JL') AS "JL",
 max(n_comp) FILTER (comp_op = 'MV') AS "MV", max(n_comp) FILTER (comp_op = 'PS') AS "PS" FROM mc GROUP BY 1, 2, 3""")
def _(spark, d):
    return A.image_comparison(match_counts(spark, d), ["AB", "DSB", "JL", "MV", "PS"])


@query("J10_labels_with_stack", "SELECT l.doc_id, l.quality, d.source || '/' || d.doc_id AS stack_path FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.lang = 'en'")
def _(spark, d):
    from ..operators.stacks import with_stack_path
    stacks = table(spark, d, "documents").filter("lang = 'en'").select(
        "doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("stack_path"))
    return with_stack_path(table(spark, d, "labels").select("doc_id", "quality"), stacks, "doc_id")


@query("J11_not_yet_sampled", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, d):
    from ..operators.sampling import not_sampled
    done = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return not_sampled(table(spark, d, "part"), done, "p_partkey").select("p_partkey")


@query("J12_polygons_of_latest", "WITH " + POLYGONS_SQL + ", lt AS (SELECT DISTINCT source_file FROM images WHERE irrigation = 5) SELECT p.unique_id, p.poly_order, p.l_partkey FROM polygons p JOIN images i USING (unique_id) WHERE i.source_file IN (SELECT source_file FROM lt)")
def _(spark, d):
    i = images(spark, d)
    latest = i.filter("irrigation = 5").select("source_file")
    p = polygons(spark, d).join(i.select("unique_id", "source_file"), "unique_id")
    return p.join(latest, "source_file", "left_semi").select("unique_id", "poly_order", "l_partkey")


@query("J13_polygons_of_kept_labeler", "WITH " + POLYGONS_SQL + """, k AS (SELECT image_id, operator_initials, row_number() OVER (PARTITION BY image_id ORDER BY CASE operator_initials WHEN 'KL' THEN 1 WHEN 'MV' THEN 2 WHEN 'DSB' THEN 3 WHEN 'JL' THEN 4 ELSE 1000000 END, unique_id) AS rn FROM images)
SELECT p.unique_id, p.poly_order, p.l_partkey FROM polygons p JOIN k ON k.rn = 1 AND k.image_id = p.image_id AND k.operator_initials = p.operator_initials""")
def _(spark, d):
    kept = L.one_per_image(images(spark, d), V.PRIORITY_REPORT).select("image_id", "operator_initials")
    return polygons(spark, d).join(kept, ["image_id", "operator_initials"], "left_semi").select("unique_id", "poly_order", "l_partkey")


@query("J15_screenshot_stack", """
WITH s AS (SELECT o_orderkey AS shot_id, o_custkey // 50 AS sv, CAST(o_orderkey % 25 + 1 AS INTEGER) AS iid, CAST(o_orderdate AS DATE) AS dt FROM orders WHERE o_orderkey % 3 = 0),
l AS (SELECT o_orderkey AS u, o_custkey // 50 AS sv, CAST(o_orderkey % 40 + 1 AS INTEGER) AS iid, CAST(o_orderdate AS DATE) AS dt, 'id_' || o_custkey AS site FROM orders WHERE o_orderkey % 3 <> 1),
e AS (SELECT sv, iid, dt, arg_min(site, u) AS site FROM l GROUP BY 1, 2, 3), f AS (SELECT sv, iid, arg_min(site, u) AS site FROM l GROUP BY 1, 2)
SELECT shot_id, coalesce(e.site, f.site) AS site_id, CASE WHEN e.site IS NOT NULL THEN 1 WHEN f.site IS NOT NULL THEN 2 END AS match_rank
FROM s LEFT JOIN e ON s.sv = e.sv AND s.iid = e.iid AND s.dt = e.dt LEFT JOIN f ON s.sv = f.sv AND s.iid = f.iid""")
def _(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    sv = F.expr("o_custkey div 50").alias("survey_id")
    dt = F.col("o_orderdate").cast("date").alias("image_date")
    shots = o.filter(k % 3 == 0).select(k.alias("shot_id"), sv, (k % 25 + 1).cast("int").alias("internal_id"), dt)
    labels = o.filter(k % 3 != 1).select(k.alias("unique_id"), sv, (k % 40 + 1).cast("int").alias("internal_id"), dt,
                                         F.concat(F.lit("id_"), F.col("o_custkey").cast("string")).alias("site_id"))
    return A.screenshot_stack(shots, labels).select("shot_id", "site_id", "match_rank")


@query("J15_polygons_near_date", "WITH " + POLYGONS_SQL + """, pd AS (SELECT site_id, image_date, count(*) AS n FROM polygons GROUP BY 1, 2)
SELECT i.unique_id, CAST(coalesce(sum(pd.n), 0) AS BIGINT) AS n_polygons FROM images i LEFT JOIN pd ON pd.site_id = i.site_id AND abs(date_diff('day', pd.image_date, i.image_date)) <= 1 GROUP BY 1""")
def _(spark, d):
    return A.polygons_near_date(images(spark, d).select("unique_id", "site_id", "image_date"), polygons(spark, d)).select("unique_id", "n_polygons")


@query("J16_available_sources", "WITH " + POLYGONS_SQL + """,
s2 AS (SELECT DISTINCT site_id, image_date FROM images WHERE irrigation <= 3), ps AS (SELECT DISTINCT site_id, image_date FROM images WHERE irrigation >= 3),
sh AS (SELECT DISTINCT site_id, image_date FROM images WHERE unique_id % 7 = 0), lb AS (SELECT site_id, image_date, string_agg(DISTINCT operator_initials, ';' ORDER BY operator_initials) AS labelers FROM polygons GROUP BY 1, 2),
k AS (SELECT * FROM s2 UNION SELECT * FROM ps UNION SELECT * FROM sh UNION SELECT site_id, image_date FROM lb)
SELECT k.site_id, k.image_date, s2.site_id IS NOT NULL AS sentinel, ps.site_id IS NOT NULL AS planet, sh.site_id IS NOT NULL AS screenshot, coalesce(labelers, '') AS labelers
FROM k LEFT JOIN s2 USING (site_id, image_date) LEFT JOIN ps USING (site_id, image_date) LEFT JOIN sh USING (site_id, image_date) LEFT JOIN lb USING (site_id, image_date)""")
def _(spark, d):
    from ..operators.stacks import available_sources
    i = images(spark, d)
    return available_sources(
        {"sentinel": i.filter("irrigation <= 3"), "planet": i.filter("irrigation >= 3"), "screenshot": i.filter("unique_id % 7 = 0")},
        polygons(spark, d))


@query("J17_image_metadata", "WITH " + POLYGONS_SQL + " SELECT p.unique_id, p.poly_order, p.l_partkey, i.month, i.year, i.water_source FROM polygons p JOIN images i USING (unique_id)")
def _(spark, d):
    p = polygons(spark, d).select("unique_id", "poly_order", "l_partkey")
    return p.join(images(spark, d).select("unique_id", "month", "year", "water_source"), "unique_id")


@query("J18_assessed_labelers", "WITH " + POLYGONS_SQL + """, dr AS (SELECT DISTINCT image_id, operator_initials FROM polygons)
SELECT image_id, operator_initials, true AS has_polygons FROM dr UNION ALL
SELECT DISTINCT image_id, operator_initials, false FROM images WHERE image_id NOT IN (SELECT image_id FROM dr)""")
def _(spark, d):
    return L.assessed_labelers(polygons(spark, d), images(spark, d))


# --- duplicates and ranks -----------------------------------------------------

@query("R1_latest_versions", "WITH " + IMAGES_SQL + """, v AS (SELECT unique_id, plot_file,
  CASE unique_id % 5 WHEN 0 THEN 'AB_' || source_file WHEN 1 THEN source_file WHEN 2 THEN replace(source_file, '_v2', '') WHEN 3 THEN '9x' || source_file ELSE source_file END AS source_file
  FROM images WHERE NOT (site_num % 4 = 1 AND unique_id % 5 = 0)),
c AS (SELECT *, CASE WHEN regexp_matches(source_file, '^[A-Z]+_[A-Z]+_v2') THEN 1 WHEN regexp_matches(source_file, '^[A-Z]+_[A-Z]+_') AND NOT contains(source_file, 'v2') THEN 2
  WHEN regexp_matches(source_file, '^[A-Z]+_v2') THEN 3 ELSE 4 END AS cls FROM v),
b AS (SELECT *, min(cls) OVER (PARTITION BY plot_file) AS best FROM c)
SELECT unique_id, source_file, 1 AS most_recent FROM b WHERE (cls = best OR source_file IN ('AB_JL_v2_101-125', 'PS_101-125', 'PS_1025-1049', 'PS_1-25')) AND NOT contains(source_file, 'MV_76-100')""")
def _(spark, d):
    k, s = F.col("unique_id"), F.col("source_file")
    v = images(spark, d).filter(~((F.col("site_num") % 4 == 1) & (k % 5 == 0))).select(
        "unique_id", "plot_file",
        F.when(k % 5 == 0, F.concat(F.lit("AB_"), s)).when(k % 5 == 2, F.replace(s, F.lit("_v2"), F.lit("")))
        .when(k % 5 == 3, F.concat(F.lit("9x"), s)).otherwise(s).alias("source_file"))
    return L.latest_versions(v, [*L.ALWAYS_IN, "PS_1-25"]).select("unique_id", "source_file", "most_recent")


@query("R2_drop_repeats", "WITH " + IMAGES_SQL + " SELECT unique_id, image_id, operator_initials FROM (SELECT *, row_number() OVER (PARTITION BY image_id, operator_initials ORDER BY image_number, unique_id) AS rn FROM images) WHERE rn = 1")
def _(spark, d):
    return L.drop_repeats(images(spark, d)).select("unique_id", "image_id", "operator_initials")


def _case(table_, default=1000000):
    return "CASE operator_initials " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + f" ELSE {default} END"


for _name, _map in (("R3_priority_report", V.PRIORITY_REPORT), ("R3_priority_ps_first", V.PRIORITY_PS_FIRST), ("R3_priority_train", V.PRIORITY_TRAIN),
                    ("R3_priority_model", {k: -v for k, v in V.WEIGHT_MODEL.items()})):
    def _make(pri):
        def run(spark, d):
            return L.one_per_image(images(spark, d), pri).select("unique_id", "image_id", "operator_initials")
        return run
    query(_name, "WITH " + IMAGES_SQL + f" SELECT unique_id, image_id, operator_initials FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_case(_map)}, unique_id) AS rn FROM images) WHERE rn = 1")(_make(_map))


@query("R4_losing_duplicates", "WITH " + IMAGES_SQL + f" SELECT unique_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_case(V.PRIORITY_PS_FIRST)}, unique_id) AS rn FROM images) WHERE rn > 1")
def _(spark, d):
    return R.losers(images(spark, d), ["image_id"], [R.by_priority("operator_initials", V.PRIORITY_PS_FIRST), F.col("unique_id")], "unique_id").select("unique_id", "image_id")


@query("R5_first_per_site_date", "WITH " + IMAGES_SQL + " SELECT unique_id, site_id, year, month, day FROM (SELECT *, row_number() OVER (PARTITION BY site_id, year, month, day ORDER BY unique_id) AS rn FROM images) WHERE rn = 1")
def _(spark, d):
    return R.first_per_key(images(spark, d), ["site_id", "year", "month", "day"], ["unique_id"]).select("unique_id", "site_id", "year", "month", "day")


@query("R6_row_ids", "WITH " + IMAGES_SQL + " SELECT source_file, unique_id, row_number() OVER (ORDER BY source_file, unique_id) AS row_id FROM images")
def _(spark, d):
    return R.numbered(images(spark, d).select("source_file", "unique_id"), ["source_file", "unique_id"], "row_id")


@query("R7_label_overlap", "WITH " + IMAGES_SQL + """
SELECT image_id, count(DISTINCT operator_initials) AS n_labelers, CASE WHEN bool_or(operator_initials = 'PS') AND bool_or(operator_initials <> 'PS') THEN 'both'
 WHEN bool_or(operator_initials = 'PS') THEN 'only_ps' ELSE 'only_others' END AS overlap FROM images GROUP BY 1""")
def _(spark, d):
    from ..operators.reports import label_overlap
    return label_overlap(images(spark, d), "PS")


# --- sorts, limits, sets ------------------------------------------------------

@query("L1_multi_key_sort", "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size, p_retailprice, p_partkey")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice").orderBy("p_size", "p_retailprice", "p_partkey")


@query("L2_numeric_text_sort", "SELECT DISTINCT p_brand, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS n FROM part ORDER BY n")
def _(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().withColumn("n", F.element_at(F.split("p_brand", "#"), 2).try_cast("int")).orderBy("n")


@query("L3_largest_and_smallest", """
(SELECT 'largest' AS side, l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5) UNION ALL
(SELECT 'smallest', l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 5)""")
def _(spark, d):
    cols = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    li = table(spark, d, "lineitem").select(*cols)
    top = li.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(5)
    low = li.orderBy("l_extendedprice", "l_orderkey", "l_linenumber").limit(5)
    return top.select(F.lit("largest").alias("side"), *cols).unionByName(low.select(F.lit("smallest").alias("side"), *cols))


@query("L4_trial_head", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(100)


@query("L5_union_by_name", """
SELECT o_orderkey AS k, o_custkey AS site, CAST(NULL AS BIGINT) AS part FROM orders UNION ALL SELECT l_orderkey, NULL, l_partkey FROM lineitem""")
def _(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("site"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("part"))
    return a.unionByName(b, allowMissingColumns=True)


@query("L6_both_sensors", "WITH " + IMAGES_SQL + " SELECT site_id, image_date FROM images WHERE irrigation <= 2 INTERSECT SELECT site_id, image_date FROM images WHERE irrigation >= 4 ORDER BY 1, 2 LIMIT 100")
def _(spark, d):
    from ..operators.stacks import in_both
    i = images(spark, d)
    return in_both(i.filter("irrigation <= 2"), i.filter("irrigation >= 4"), ["site_id", "image_date"], 100)


@query("L7_difference_distinct", "WITH " + IMAGES_SQL + " SELECT DISTINCT site_id, image_date FROM images WHERE irrigation <= 2 EXCEPT SELECT site_id, image_date FROM images WHERE irrigation >= 4")
def _(spark, d):
    i = images(spark, d).select("site_id", "image_date", "irrigation")
    return i.filter("irrigation <= 2").drop("irrigation").distinct().subtract(i.filter("irrigation >= 4").drop("irrigation"))


@query("L9_choice_list", "SELECT 'All Provinces' AS choice UNION ALL SELECT DISTINCT n_name FROM nation")
def _(spark, d):
    from ..operators.filters import choice_list
    return choice_list(table(spark, d, "nation"), "n_name", "All Provinces")
