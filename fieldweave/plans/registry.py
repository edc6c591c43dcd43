"""Name to (query, oracle) registry and the table stand-ins the queries share.

The driver's tables play the parts of label rows, polygons, scenes, pixels and
series. Each stand-in exists twice, as a DataFrame and as a SQL ``WITH`` body,
so that a query and its check start from the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- label rows: orders -------------------------------------------------------

IMAGES_SQL = """
img0 AS (
  SELECT o_orderkey AS unique_id, o_custkey // 15 AS site_num,
         CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(o_orderkey // 6 % 3 AS INTEGER) AS image_date,
         list_extract(['KL','MV','DSB','JL','PS','AB'], CAST(o_orderkey % 6 + 1 AS INTEGER)) AS operator_initials,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS irrigation,
         CAST(o_orderkey % 10 + 1 AS INTEGER) AS image_number,
         CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' END AS water_source,
         greatest(0.0, o_totalprice - 150000.0) / 4000.0 AS percent_coverage
  FROM orders),
images AS (
  SELECT unique_id, 'id_' || site_num AS site_id, site_num, CAST(site_num % 25 + 1 AS INTEGER) AS internal_id,
         image_date, CAST(year(image_date) AS INTEGER) AS year, CAST(month(image_date) AS INTEGER) AS month,
         CAST(day(image_date) AS INTEGER) AS day, operator_initials, irrigation, image_number, water_source,
         percent_coverage,
         CASE WHEN irrigation >= 3 THEN percent_coverage * 0.8 ELSE 0.0 END AS percent_coverage_hc,
         22 + (site_num % 1100) / 100.0::DOUBLE AS x, -18 + (site_num * 7 % 1000) / 100.0::DOUBLE AS y,
         'Zambia_0.05_n_' || (site_num // 25 * 25 + 1) || '-' || (site_num // 25 * 25 + 25) || '.csv' AS plot_file,
         operator_initials || (CASE WHEN unique_id % 12 >= 6 THEN '_v2_' ELSE '_' END)
           || (site_num // 25 * 25 + 1) || '-' || (site_num // 25 * 25 + 25) AS source_file,
         'id_' || site_num || '_' || year(image_date) || '-' || lpad(CAST(month(image_date) AS VARCHAR), 2, '0')
           || '-' || lpad(CAST(day(image_date) AS VARCHAR), 2, '0') AS image_id
  FROM img0)
"""


def images(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as label rows: one labeler's answer for one site and date."""
    from ..functions.keys import image_id

    o = table(spark, folder, "orders")
    names = F.array(*[F.lit(n) for n in ("KL", "MV", "DSB", "JL", "PS", "AB")])
    base = o.select(
        F.col("o_orderkey").alias("unique_id"),
        F.expr("o_custkey div 15").alias("site_num"),
        F.date_add(F.trunc(F.col("o_orderdate").cast("date"), "month"),
                   F.expr("cast(o_orderkey div 6 % 3 as int)")).alias("image_date"),
        F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("operator_initials"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("irrigation"),
        (F.col("o_orderkey") % 10 + 1).cast("int").alias("image_number"),
        F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").alias("water_source"),
        (F.greatest(F.lit(0.0), F.col("o_totalprice") - 150000.0) / 4000.0).alias("percent_coverage"),
    )
    lo = F.expr("site_num div 25 * 25 + 1").cast("string")
    hi = F.expr("site_num div 25 * 25 + 25").cast("string")
    span = F.concat(lo, F.lit("-"), hi)
    out = base.select(
        "unique_id",
        F.concat(F.lit("id_"), F.col("site_num").cast("string")).alias("site_id"),
        "site_num",
        (F.col("site_num") % 25 + 1).cast("int").alias("internal_id"),
        "image_date",
        F.year("image_date").alias("year"), F.month("image_date").alias("month"), F.dayofmonth("image_date").alias("day"),
        "operator_initials", "irrigation", "image_number", "water_source", "percent_coverage",
        F.when(F.col("irrigation") >= 3, F.col("percent_coverage") * 0.8).otherwise(0.0).alias("percent_coverage_hc"),
        (22 + (F.col("site_num") % 1100) / 100.0).alias("x"),
        (-18 + (F.col("site_num") * 7 % 1000) / 100.0).alias("y"),
        F.concat(F.lit("Zambia_0.05_n_"), span, F.lit(".csv")).alias("plot_file"),
        F.concat("operator_initials", F.when(F.col("unique_id") % 12 >= 6, "_v2_").otherwise("_"), span).alias("source_file"),
    )
    return out.withColumn("image_id", image_id())


# --- polygons: lineitem with the image of its order ---------------------------

POLYGONS_SQL = IMAGES_SQL + """,
polygons AS (
  SELECT i.unique_id, i.site_id, i.image_date, i.year, i.month, i.day, i.operator_initials, i.image_id, i.internal_id,
         l.l_linenumber AS poly_order, CAST(l.l_linenumber % 5 + 1 AS INTEGER) AS certainty,
         l.l_extendedprice AS polygon_area_m2, l.l_quantity, l.l_partkey,
         list_extract(['tree_crop','industrial','lawn','covered','small-scale'], CAST(l.l_partkey % 5 + 1 AS INTEGER)) AS category
  FROM lineitem l JOIN images i ON l.l_orderkey = i.unique_id)
"""


def polygons(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as polygons drawn on the image of their order."""
    from ..functions.values import CATEGORIES

    li = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("poly_order"),
        (F.col("l_linenumber") % 5 + 1).cast("int").alias("certainty"),
        F.col("l_extendedprice").alias("polygon_area_m2"), "l_quantity", "l_partkey",
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("l_partkey") % 5 + 1).cast("int")).alias("category"),
    )
    i = images(spark, folder).select(
        "unique_id", "site_id", "image_date", "year", "month", "day", "operator_initials", "image_id", "internal_id")
    return li.join(i, li["l_orderkey"] == i["unique_id"]).drop("l_orderkey")


# --- pixels: lineitem ---------------------------------------------------------

PIXELS_SQL = """
px0 AS (
  SELECT l_suppkey AS file_num, CAST(month(l_shipdate) - 1 AS INTEGER) AS t,
         CAST(l_orderkey % 100 AS INTEGER) AS row, CAST((l_partkey * 7 + l_linenumber) % 100 AS INTEGER) AS col,
         l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
  FROM lineitem),
pixels AS (
  SELECT CAST(file_num AS VARCHAR) AS file_id, t, row, col, l_orderkey, l_linenumber, l_partkey,
         nullif(CAST((l_partkey * 37 + l_orderkey) % 2500 AS INTEGER) // 10 * 10, 0) AS b2,
         nullif(CAST((l_partkey * 11 + l_linenumber * 101) % 3000 AS INTEGER) // 10 * 10, 0) AS b3,
         nullif(CAST((l_orderkey * 13 + l_partkey) % 3500 AS INTEGER) // 100 * 100, 0) AS b4,
         nullif(CAST((l_orderkey * 7 + l_linenumber * 977) % 6000 AS INTEGER) // 100 * 100, 0) AS b8,
         nullif(CAST((l_partkey * 3 + l_linenumber * 499) % 4000 AS INTEGER) // 10 * 10, 0) AS b11,
         CAST((l_orderkey + l_linenumber) % 12 AS INTEGER) AS scl,
         CAST((l_orderkey % 5) * 512 AS INTEGER) AS qa60
  FROM px0)
"""


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as pixel rows of a stack: bands, scene class and quality bits."""
    li = table(spark, folder, "lineitem")

    def band(expr: str, step: int):
        return F.expr(f"nullif(cast({expr} as int) div {step} * {step}, 0)").cast("int")

    return li.select(
        F.col("l_suppkey").cast("string").alias("file_id"),
        (F.month("l_shipdate") - 1).alias("t"),
        (F.col("l_orderkey") % 100).cast("int").alias("row"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 100).cast("int").alias("col"),
        "l_orderkey", "l_linenumber", "l_partkey",
        band("(l_partkey * 37 + l_orderkey) % 2500", 10).alias("b2"),
        band("(l_partkey * 11 + l_linenumber * 101) % 3000", 10).alias("b3"),
        band("(l_orderkey * 13 + l_partkey) % 3500", 100).alias("b4"),
        band("(l_orderkey * 7 + l_linenumber * 977) % 6000", 100).alias("b8"),
        band("(l_partkey * 3 + l_linenumber * 499) % 4000", 10).alias("b11"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 12).cast("int").alias("scl"),
        ((F.col("l_orderkey") % 5) * 512).cast("int").alias("qa60"),
    )


# --- series: embeddings -------------------------------------------------------

SERIES_SQL = """
cells AS (
  SELECT vec_id, label, CAST(u.t AS INTEGER) AS t,
         CASE WHEN (vec_id * 7 + u.t * 3) % 5 = 0 OR vec_id % 97 = 5 THEN NULL
              ELSE CAST(list_extract(embedding, CAST(u.t + 1 AS INTEGER)) AS DOUBLE) END AS v
  FROM embeddings, (SELECT unnest(range(0, 64)) AS t) u)
"""


def series(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as 64-step series with holes; some are missing throughout."""
    e = table(spark, folder, "embeddings")
    return e.select(
        "vec_id", "label",
        F.transform("embedding", lambda v, i: F.when(
            ~(((F.col("vec_id") * 7 + i * 3) % 5 == 0) | (F.col("vec_id") % 97 == 5)), v.cast("double"))).alias("v"),
    )


# --- scenes: events -----------------------------------------------------------

SCENES_SQL = """
scenes AS (
  SELECT user_id AS site, event_id AS scene_id, CAST(ts AS DATE) AS acquired,
         CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(event_id * 37 % 101 AS DOUBLE) / 100.0 END AS cloud_cover,
         CAST(event_id * 53 % 103 AS DOUBLE) AS clear_percent,
         CAST(event_id * 29 % 107 AS INTEGER) AS good_pixels, event_type, value
  FROM events)
"""


def scenes(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as scenes: a site, a date, cloud share, clear share, good pixels."""
    e = table(spark, folder, "events")
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("site"), k.alias("scene_id"), F.col("ts").cast("date").alias("acquired"),
        F.when(F.coalesce(F.col("event_type") != "signup", F.lit(True)),
               (k * 37 % 101).cast("double") / 100.0).alias("cloud_cover"),
        (k * 53 % 103).cast("double").alias("clear_percent"),
        (k * 29 % 107).cast("int").alias("good_pixels"), "event_type", "value",
    )


# --- scores: labels joined to their documents ---------------------------------

SCORES_SQL = """
scores AS (
  SELECT l.doc_id, l.quality AS y, l.toxic AS pred, CAST(d.n_chars * 7 % 1000 AS DOUBLE) / 1000.0 AS p,
         d.lang AS stratum, CAST(l.doc_id % 5 AS INTEGER) AS fold
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """``labels`` with a score per document: truth, hard guess, probability, stratum."""
    lab = table(spark, folder, "labels")
    doc = table(spark, folder, "documents").select("doc_id", "n_chars", "lang")
    return lab.join(doc, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), F.col("toxic").alias("pred"),
        ((F.col("n_chars") * 7 % 1000).cast("double") / 1000.0).alias("p"),
        F.col("lang").alias("stratum"), (F.col("doc_id") % 5).cast("int").alias("fold"),
    )
