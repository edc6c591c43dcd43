"""Registered queries: documents and tags. Texts are made from the tables by Spark, then parsed."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import stacks as ST
from ..operators import tagging as TG
from ..sources import placemarks as PM
from ..sources import sinks as SK
from ..sources import surveys as SV
from ..session import scratch
from ..sources import tables as TB
from .registry import IMAGES_SQL, images, polygons, query, table


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _tag(name, inner):
    return F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))


def survey_xml(spark, d):
    """Each order as a survey document: slot 1 valid, 2 a bad date, 3 without code, 4 only on some, the rest empty."""
    k = F.col("o_orderkey")
    y, m, dd = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    code = F.substring("o_orderpriority", 1, 1)

    def slot(i, year, month, day, irr):
        return F.concat(_tag(f"year{i}", _tag("code", _s(year))), _tag(f"month{i}", _tag("code", _s(month))), _tag(f"day{i}", _tag("value", _s(day))),
                        _tag(f"irrigation{i}", _tag("code", irr)) if irr is not None else F.lit(f"<irrigation{i}/>"))

    xml = _tag("plot", F.concat(
        _tag("id", _tag("value", F.concat(F.lit("id_"), _s("o_custkey")))),
        _tag("location", F.concat(_tag("x", _s(F.col("o_custkey") / 100.0)), _tag("y", F.lit("-15.5")), _tag("srs", F.lit("EPSG:4326")))),
        _tag("operator", _tag("value", F.lit("Somebody"))), _tag("plot_file", _tag("value", F.lit("Zambia_0.05_n_1-25.csv"))),
        F.when(k % 2 == 0, _tag("natural_dicoloration", _tag("value", F.lit("true")))).otherwise(F.lit("<natural_dicoloration/>")),
        slot(1, y, m, dd, code), slot(2, y, F.lit(2), F.lit(30), code), slot(3, y, m, dd, None),
        F.when(k % 3 == 0, slot(4, y + 1, m, F.lit(5), code)).otherwise(F.lit("<year4/><month4/><day4/><irrigation4/>")),
        F.lit("<year5/><month5/><day5/><irrigation5/>")))
    op = F.when(k % 2 == 0, "JL").otherwise("AB_JL")
    return table(spark, d, "orders").select(F.concat(F.lit("raw/"), op, F.lit("_1-25/1/"), _s(k), F.lit(".xml")).alias("path"), xml.alias("xml"))


SLOT_SQL = """WITH b AS (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS code FROM orders), r AS (
 SELECT o_orderkey, o_custkey, 1 AS image_number, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, code FROM b UNION ALL SELECT o_orderkey, o_custkey, 4, year(o_orderdate) + 1, month(o_orderdate), 5, code FROM b WHERE o_orderkey % 3 = 0)
SELECT 'id_' || o_custkey AS site_id, CAST(o_orderkey AS INTEGER) AS internal_id, CASE WHEN o_orderkey % 2 = 0 THEN 'JL' ELSE 'AB' END AS operator_initials, round(o_custkey / 100.0::DOUBLE, 6) AS x, CASE WHEN o_orderkey % 2 = 0 THEN 'true' END AS water_source,
 image_number, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, CAST(dd AS INTEGER) AS day, code AS irrigation FROM r"""


def _slots(docs):
    return SV.answer_rows(docs).select(
        "site_id", SV.internal_id_from_name().alias("internal_id"), "operator_initials", F.round("x", 6).alias("x"), "water_source", "image_number", "year", "month", "day", "irrigation")


@query("S1_S2_survey_documents", SLOT_SQL)
def _(spark, d):
    return _slots(SV.parse_surveys(survey_xml(spark, d)))


@query("S3_survey_bundles", SLOT_SQL)
def _(spark, d):
    @F.pandas_udf("binary")
    def pack(name: pd.Series, xml: pd.Series) -> pd.Series:
        def one(n, x):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("1/" + n.rsplit("/", 1)[1], x)
            return buf.getvalue()
        return pd.Series([one(n, x) for n, x in zip(name, xml)])

    bundle = F.concat(F.regexp_extract("path", r"^(.*?)/1/", 1), F.lit(".zip"))
    blobs = survey_xml(spark, d).select(bundle.alias("path"), pack("path", "xml").alias("content"))
    return _slots(SV.parse_surveys(SV.unpack_bundles(blobs)))


@query("S4_S5_placemarks", """WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 NOT IN (1, 2, 3))
SELECT k, 'JL_' || (k % 25 + 1) || '_' || (k % 12 + 1) || '.' || (k % 28 + 1) || '.2021' AS name, CAST(k % 25 + 1 AS INTEGER) AS internal_id, CASE WHEN k % 3 = 0 THEN '4 Uneven' END AS description, CASE WHEN k % 10 = 4 THEN 'no_outer_ring' ELSE 'ok' END AS geometry_status,
 CASE WHEN k % 10 <> 4 THEN CAST(4 AS INTEGER) ELSE CAST(-1 AS INTEGER) END AS n_points, CASE WHEN k % 10 <> 4 THEN round(22 + k / 1000.0::DOUBLE, 6) END AS lon0 FROM c""")
def _(spark, d):
    k = F.col("c_custkey")
    lon = lambda a: _s(F.round(22 + k / 1000.0 + a, 6))
    pts = F.concat(lon(0), F.lit(",-15.1,0 "), lon(0.01), F.lit(",-15.1,0\n\t"), lon(0.01), F.lit(",-15.2,0 "), lon(0), F.lit(",-15.1,0"))
    poly = _tag("Polygon", _tag("outerBoundaryIs", _tag("LinearRing", _tag("coordinates", pts))))
    geom = (F.when(k % 10 == 1, F.lit("<Point><coordinates>1,2</coordinates></Point>")).when(k % 10 == 2, F.lit("<LineString><coordinates>1,2 3,4</coordinates></LineString>"))
            .when(k % 10 == 4, F.lit("<Polygon><innerBoundaryIs/></Polygon>")).otherwise(poly))
    name = F.concat(F.lit("JL_"), _s(k % 25 + 1), F.lit("_"), _s(k % 12 + 1), F.lit("."), _s(k % 28 + 1), F.lit(".2021"))
    xml = _tag("Placemark", F.concat(
        F.when(k % 10 == 3, F.lit("<name/>")).otherwise(_tag("name", name)), F.when(k % 3 == 0, F.lit("<description>4 Uneven</description>")).otherwise(F.lit("")), geom))
    rows = PM.placemark_rows(PM.parse_placemarks(table(spark, d, "customer").select(k.alias("k"), xml.alias("xml"))))
    return rows.select("k", "name", "internal_id", "description", "geometry_status", F.coalesce(F.size("ring"), F.lit(-1)).alias("n_points"), F.round(F.get("ring", F.lit(0))["lon"], 6).alias("lon0"))


@query("S6_W2_geojson_round_trip", "SELECT c_custkey AS k, 'Customer ' || c_custkey AS name, round(c_acctbal, 2) AS lon1, CAST(3 AS INTEGER) AS n_points FROM customer")
def _(spark, d):
    p = lambda x, y: F.struct(F.lit(x).cast("double").alias("lon") if not hasattr(x, "cast") else x.alias("lon"), F.lit(float(y)).alias("lat"))
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), F.concat(F.lit("Customer "), _s("c_custkey")).alias("name"), F.array(p(0.5, 1), p(F.col("c_acctbal"), 2), p(0.5, 1)).alias("ring"))
    folder = scratch(spark, "geojson")
    SK.write_geojson(c, folder, ["k", "name"])
    f = PM.read_geojson(spark, folder)
    return f.select(F.col("properties")["k"].cast("bigint").alias("k"), F.col("properties")["name"].alias("name"), F.round(F.col("ring")[1]["lon"], 2).alias("lon1"), F.size("ring").alias("n_points"))


@query("S7_csv_rows", "SELECT o_orderkey AS unique_id, 'id_' || o_custkey AS site_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 4 END AS INTEGER) AS irrigation FROM orders")
def _(spark, d):
    """Written as CSV files with a header and read back by the table reader."""
    folder = scratch(spark, "csv")
    k = F.col("o_orderkey")
    table(spark, d, "orders").select(k.alias("unique_id"), F.concat(F.lit("id_"), _s("o_custkey")).alias("site_id"), F.when(k % 3 != 0, 4).alias("irrigation")).write.option("header", True).csv(folder)
    return TB.read_table(spark, folder, "unique_id bigint, site_id string, irrigation int")


@query("S8_union_parts", "WITH " + IMAGES_SQL + " SELECT unique_id, source_file, CASE WHEN irrigation >= 3 THEN percent_coverage END AS percent_coverage FROM images")
def _(spark, d):
    i = images(spark, d)
    parts = [i.filter("irrigation >= 3").select("unique_id", "source_file", "percent_coverage"), i.filter("irrigation < 3").select("unique_id", "source_file")]
    return TB.union_all(parts)


@query("S9_window_metadata", """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, event_type FROM events WHERE user_id % 10 <> 3)
SELECT CAST(user_id AS VARCHAR) AS file_id, CAST(t AS INTEGER) AS t, CAST(DATE '2024-01-01' + CAST(event_id % 300 AS INTEGER) AS DATE) AS start, event_type = 'view' AS file_exists, CASE WHEN event_type = 'signup' THEN NULL ELSE (event_id % 10) / 10.0::DOUBLE END AS masked_fraction FROM e""")
def _(spark, d):
    k, t = F.col("event_id"), F.col("event_type")
    origin = F.lit("2024-01-01").cast("date")
    day = F.date_add(origin, (k % 300).cast("int"))
    w = F.struct(F.array(_s(day), _s(F.date_add(day, 10))).alias("date_range"), (t == "view").alias("file_exists"), F.when(t != "signup", (k % 10) / 10.0).alias("masked_fraction"))
    # one record per stack; a stack has 42 windows in the real store
    docs = table(spark, d, "events").groupBy(_s("user_id").alias("file_id"), "user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), w.alias("w")))), lambda x: x["w"]).alias("windows"))
    text = F.to_json(F.struct("file_id", "windows"))
    broken = F.when(F.col("user_id") % 10 == 3, F.substring(text, F.lit(1), F.length(text) - 5)).otherwise(text)
    return TB.parse_window_metadata(docs.select(broken.alias("json"))).select("file_id", "t", "start", "file_exists", "masked_fraction")


@query("S12_stack_inventory", "WITH " + IMAGES_SQL + """ SELECT unique_id, CAST(site_num AS VARCHAR) AS site, image_date, list_extract(['stack', 'stack_masked', 'labels'], CAST(unique_id % 3 + 1 AS INTEGER)) AS kind,
 CASE WHEN unique_id % 3 = 2 THEN operator_initials END AS operator_initials, 'v' || (unique_id % 4) AS version, CASE WHEN unique_id % 2 = 0 THEN 'sentinel2' ELSE 'planetscope' END AS sensor FROM images""")
def _(spark, d):
    return _inventory(spark, d).select("unique_id", "site", "image_date", "kind", "operator_initials", "version", "sensor")


def _inventory(spark, d):
    i = images(spark, d)
    k = F.col("unique_id")
    base = F.concat(_s("site_num"), F.lit("_"), F.date_format("image_date", "yyyy.MM.dd"))
    name = F.when(k % 3 == 0, F.concat(base, F.lit("_stack.tif"))).when(k % 3 == 1, F.concat(base, F.lit("_stack_masked.tif"))).otherwise(
        F.concat(base, F.lit("_"), F.col("operator_initials"), F.lit("_labels.tif")))
    path = F.concat(F.lit("store/"), F.when(k % 2 == 0, "sentinel2").otherwise("planetscope"), F.lit("/v"), _s(k % 4), F.lit("/"), name)
    return ST.stack_inventory(i.select("unique_id", path.alias("path")))


@query("S13_latest_version", "SELECT o_orderkey, o_orderpriority AS version FROM orders WHERE o_orderpriority = (SELECT max(o_orderpriority) FROM orders)")
def _(spark, d):
    return ST.latest_version(table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("version")))


@query("S14_clean_ids", "SELECT trim(s) AS id FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE ' ' || o_orderkey || ' ' END AS s FROM orders) WHERE trim(s) <> ''")
def _(spark, d):
    k = F.col("o_orderkey")
    lines = table(spark, d, "orders").select(F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), _s(k), F.lit(" "))).alias("value"))
    return TB.clean_ids(lines, "value")


@query("J21_scene_mask_pairs", """WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view'), m AS (SELECT DISTINCT user_id FROM events WHERE event_id % 50 = 7)
SELECT '2024_' || s.user_id AS scene_id, '2024_' || s.user_id || '_3B_AnalyticMS_SR_clip.tif' AS image_file, CASE WHEN m.user_id IS NOT NULL THEN '2024_' || s.user_id || '_3B_udm2_clip.tif' END AS mask_file FROM s LEFT JOIN m ON s.user_id = m.user_id""")
def _(spark, d):
    e = table(spark, d, "events")
    base = F.concat(F.lit("2024_"), _s("user_id"))
    img = e.filter("event_type = 'view'").select(F.concat(base, F.lit("_3B_AnalyticMS_SR_clip.tif")).alias("name"))
    msk = e.filter("event_id % 50 = 7").select(F.concat(base, F.lit("_3B_udm2_clip.tif")).alias("name"))
    return ST.scene_mask_pairs(img.unionByName(msk))


_NORM = "regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '[^a-z\\s]', '', 'g')"
_WORDS = ["the", "ation", "zebra crossing"]


@query("P4_exact_phrase_tags", f"""WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents)
SELECT doc_id, concat_ws(';', CASE WHEN contains(t, 'ation') OR (t <> '' AND contains('ation', t)) THEN 'ation' END, CASE WHEN contains(t, 'the') OR (t <> '' AND contains('the', t)) THEN 'the' END, CASE WHEN contains(t, 'zebra crossing') OR (t <> '' AND contains('zebra crossing', t)) THEN 'zebra crossing' END) AS tags FROM n""")
def _(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "text")
    return TG.tag_phrases(doc, "text", _WORDS, 100.0, "tags").select("doc_id", F.array_join("tags", ";").alias("tags"))


@query("P4_uncertainty_tags")
def _(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "text")
    return TG.tag_phrases(doc, "text").select("doc_id", F.array_join("uncertainty", ";").alias("uncertainty"))


# Descriptions written into the table: a phrase as it is, cut short, with a wrong letter, with two letters swapped, with a gap, inside other words, or other words only.
PLANTED = [*X.UNCERTAINTY_PHRASES, *[s for many in X.CATEGORY_SYNONYMS.values() for s in many]]
_PHRASE = f"[{', '.join(repr(p) for p in PLANTED)}][CAST(o_orderkey % {len(PLANTED)} + 1 AS INTEGER)]"
PLANTED_SQL = f"""
o AS (SELECT o_orderkey AS k, o_orderkey // 8 % 8 AS mode, {_PHRASE} AS p, length({_PHRASE}) AS n FROM orders),
d AS (SELECT k, CAST(k % 5 + 1 AS VARCHAR) || ' ' || CASE mode WHEN 0 THEN p WHEN 1 THEN p[:n * 4 // 5] WHEN 2 THEN p[:n // 2] || 'q' || p[n // 2 + 2:] WHEN 3 THEN p[:n // 2] || p[n // 2 + 2:n // 2 + 2] || p[n // 2 + 1:n // 2 + 1] || p[n // 2 + 3:]
      WHEN 4 THEN p[:n // 2] || ' ' || p[n // 2 + 1:] WHEN 5 THEN 'Near the river: ' || upper(p) || '!' WHEN 6 THEN p[:n // 3] ELSE 'kiosk by the track' END AS description FROM o),
t AS (SELECT DISTINCT regexp_replace(lower(description), '[^a-z\\s]', '', 'g') AS x FROM d),
t2 AS (SELECT x, x AS t FROM t)
"""


def planted(spark, d):
    k = F.col("o_orderkey")
    p = F.element_at(F.array(*[F.lit(x) for x in PLANTED]), (k % len(PLANTED) + 1).cast("int"))
    rows = table(spark, d, "orders").select(k.alias("k"), F.expr("o_orderkey div 8 % 8").alias("mode"), p.alias("p"), F.length(p).alias("n"))
    cut = lambda a, n: F.substring("p", a, n)
    n, half = F.col("n"), F.expr("cast(n div 2 as int)")
    forms = [
        F.col("p"), cut(F.lit(1), F.expr("cast(n * 4 div 5 as int)")), F.concat(cut(F.lit(1), half), F.lit("q"), cut(half + 2, n)),
        F.concat(cut(F.lit(1), half), cut(half + 2, F.lit(1)), cut(half + 1, F.lit(1)), cut(half + 3, n)), F.concat(cut(F.lit(1), half), F.lit(" "), cut(half + 1, n)),
        F.concat(F.lit("Near the river: "), F.upper("p"), F.lit("!")), cut(F.lit(1), F.expr("cast(n div 3 as int)")), F.lit("kiosk by the track")]
    return rows.select("k", F.concat(_s(F.col("k") % 5 + 1), F.lit(" "), F.element_at(F.array(*forms), (F.col("mode") + 1).cast("int"))).alias("description"))


def fuzzy_sql(names, out, default):
    """Tags by the score itself: the longest common subsequence of the shorter text and each window of the longer one, ends cut off included, counted row by row."""
    flat = ", ".join(f"('{u}', '{s}')" for u, s in names)
    common = """list_last(list_reduce(list_prepend(list_transform(range(0, length(w) + 1), lambda j: CAST(0 AS BIGINT)), list_transform(string_split(a, ''), lambda c: list_transform(range(0, length(w) + 1), lambda j: CASE WHEN j > 0 AND w[j:j] = c THEN CAST(1 AS BIGINT) ELSE 0 END))),
      lambda top, same: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, length(w) + 1), lambda j: [CAST(j AS BIGINT)])), lambda row, j: list_append(row, CASE WHEN same[j[1] + 1] = 1 THEN top[j[1]] + 1 ELSE greatest(top[j[1] + 1], list_last(row)) END))))"""
    return f"""WITH {PLANTED_SQL}, ph(tag, p) AS (VALUES {flat}),
pr AS (SELECT t, tag, p, CASE WHEN length(t) <= length(p) THEN t ELSE p END AS a, CASE WHEN length(t) <= length(p) THEN p ELSE t END AS b FROM t2, ph WHERE t <> ''),
pw AS (SELECT t, tag, p, a, b FROM pr UNION SELECT t, tag, p, b, a FROM pr WHERE length(a) = length(b)),
ws AS (SELECT t, tag, a, b[i:i + length(a) - 1] AS w FROM (SELECT *, unnest(range(1, length(b) - length(a) + 2)) AS i FROM pw)
  UNION SELECT t, tag, a, b[:i] FROM (SELECT *, unnest(range(1, length(a))) AS i FROM pw) UNION SELECT t, tag, a, b[length(b) - i + 1:] FROM (SELECT *, unnest(range(1, length(a))) AS i FROM pw)),
pairs AS (SELECT DISTINCT a, w FROM ws), sc AS (SELECT a, w, 200.0::DOUBLE * {common} / (length(a) + length(w)) AS score FROM pairs),
hit AS (SELECT DISTINCT t, tag FROM ws JOIN sc ON ws.a = sc.a AND ws.w = sc.w WHERE score >= 75), tags AS (SELECT t, string_agg(tag, ';' ORDER BY tag) AS tags FROM hit GROUP BY 1)
SELECT k, description, CAST(substr(description, 1, 1) AS INTEGER) AS certainty, coalesce(tags, '{default}') AS {out} FROM d JOIN t2 ON regexp_replace(lower(description), '[^a-z\\s]', '', 'g') = x LEFT JOIN tags ON tags.t = t2.t"""


@query("P4_planted_descriptions", fuzzy_sql([(p, p) for p in X.UNCERTAINTY_PHRASES], "uncertainty_explanation", ""))
def _(spark, d):
    return TG.describe_polygons(planted(spark, d)).select("k", "description", "certainty", "uncertainty_explanation")


@query("P5_planted_descriptions", fuzzy_sql([(u, s) for u, many in X.CATEGORY_SYNONYMS.items() for s in many], "category", X.DEFAULT_CATEGORY))
def _(spark, d):
    return TG.describe_polygons(planted(spark, d)).select("k", "description", "certainty", "category")


@query("P5_exact_synonym_tags", f"""WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents), k AS (SELECT doc_id, t, t <> '' AS f FROM n)
SELECT doc_id, concat_ws(';', CASE WHEN contains(t, 'ation') OR contains(t, 'ment') OR (f AND (contains('ation', t) OR contains('ment', t))) THEN 'noun' END, CASE WHEN contains(t, 'the') OR (f AND contains('the', t)) THEN 'word' END) AS tags FROM k""")
def _(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "text")
    return TG.tag_synonyms(doc, "text", {"word": ["the"], "noun": ["ation", "ment"]}, 100.0, "tags").select("doc_id", F.array_join("tags", ";").alias("tags"))


@query("P5_description_fields")
def _(spark, d):
    doc = table(spark, d, "documents").select("doc_id", F.col("text").alias("description"))
    return TG.describe_polygons(doc).drop("description")


@query("W1_save_table", "SELECT o_orderkey AS k, o_custkey AS site, 'orders by site' AS description, 'csv' AS file_format FROM orders")
def _(spark, d):
    """Saved as CSV with its side record, both read back."""
    folder = scratch(spark, "table")
    SK.save_table(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("site")), folder, "orders by site", "test tables", "csv")
    record = spark.read.json(folder + "_metadata").select("description", "file_format")
    return TB.read_table(spark, folder, "k bigint, site bigint").join(record, how="cross")


@query("W7_label_pixels", """SELECT l_orderkey AS file_id, l_returnflag AS operator, l_linenumber AS "row", CAST(l_partkey % 5 + 1 AS INTEGER) AS category, '1 small-scale, 2 tree crop, 3 industrial, 4 lawn, 5 covered' AS comment FROM lineitem""")
def _(spark, d):
    """Written by labeler, read back with the comment of a band."""
    folder = scratch(spark, "labels")
    SK.write_label_pixels(table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("operator"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 5 + 1).cast("int").alias("category")), folder)
    back = spark.read.parquet(folder)
    return back.withColumn("comment", F.lit(back.schema["category"].metadata["comment"]))
