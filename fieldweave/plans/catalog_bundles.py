"""The label job over many survey bundles: documents and placemarks as whole files, read in their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import placemarks as PM
from ..sources import surveys as SV
from . import label_tables as LT
from .catalog_sources import _s, _tag
from .registry import query, table

#: Bundles that share internal ids, sites and plot files; several versions of some plot files.
BUNDLES = ("JL_1-25", "AB_JL_1-25", "JL_v2_1-25", "KL_26-50", "KL_v2_26-50", "AB_KL_v2_26-50", "MV_76-100")
PLOTS = ("1-25", "1-25", "1-25", "26-50", "26-50", "26-50", "76-100")
PER_FILE = 50


def _pick(names, k):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))


def _survey(x):
    """The document of an order; ``x`` is a row's columns by name."""
    y, m, dd, code = F.year(x("o_orderdate")), F.month(x("o_orderdate")), F.dayofmonth(x("o_orderdate")), F.substring(x("o_orderpriority"), 1, 1)
    slot = lambda i, *v: F.concat(_tag(f"year{i}", _tag("code", _s(v[0]))), _tag(f"month{i}", _tag("code", _s(v[1]))), _tag(f"day{i}", _tag("value", _s(v[2]))), _tag(f"irrigation{i}", _tag("code", code)))
    site = F.concat(F.lit("id_"), _s(x("o_custkey")))
    return _tag("plot", F.concat(
        _tag("id", _tag("value", site)), _tag("location", F.concat(_tag("x", _s(22 + x("o_custkey") % 100 / 10.0)), _tag("y", F.lit("-15.5")))),
        _tag("plot_file", _tag("value", F.concat(F.lit("Zambia_0.05_n_"), _pick(PLOTS, x("k")), F.lit(".csv")))),
        slot(1, y, m, dd), F.when(x("k") % 3 == 0, slot(4, y + 1, m, F.lit(5))).otherwise(F.lit(""))))


def survey_files(spark, d):
    """``orders`` as survey documents of seven bundles, fifty numbers a file, the last one first: slot 1 always, slot 4 on some."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("k"), _pick(BUNDLES, k).alias("source_file"), F.expr(f"o_orderkey div {PER_FILE}").alias("file"), "o_custkey", "o_orderdate", "o_orderpriority")
    return _files(rows, "raw", "/1", "xml", "plots", _survey)


def _files(rows, folder, sub, ending, root, xml):
    """Elements of a file from the last ``k`` to the first. What the elements say is sent to the file, not the elements."""
    told = [c for c in rows.columns if c not in ("source_file", "file")]
    parts = F.transform(F.sort_array(F.collect_list(F.struct(*told)), asc=False), lambda x: xml(x.getField))
    path = F.concat(F.lit(f"{folder}/"), F.col("source_file"), F.lit(f"{sub}/"), F.lpad(_s("file"), 9, "0"), F.lit(f".{ending}"))
    content = F.concat(F.lit(f"<{root}><!-- <Placemark>none</Placemark> -->"), F.array_join("parts", "\n"), F.lit(f"</{root}>"))
    return rows.groupBy("file", "source_file").agg(parts.alias("parts")).select(path.alias("path"), "source_file", content.alias("content"))


def _placemark(x):
    """The placemark of a line of an order."""
    k, n = x("l_orderkey"), x("l_linenumber")
    number = F.when(n % 2 == 0, x("o_custkey") % 25 + 1).otherwise(x("o_custkey"))
    late = (n % 3 == 0) & (k % 3 == 0)
    year, day = F.year(x("o_orderdate")) + F.when(late, 1).otherwise(0), F.when(late, 5).otherwise(F.dayofmonth(x("o_orderdate")))
    name = F.concat(F.lit("JL_"), _s(number), F.lit("_"), _s(F.month(x("o_orderdate"))), F.lit("."), _s(day), F.lit("."), _s(year))
    at, y = 22 + x("o_custkey") % 100 / 10.0 + x("l_partkey") % 7 / 10000.0, -15.5
    pts = F.concat_ws(" ", *[F.concat(_s(at + a), F.lit(","), F.lit(str(y + b))) for a, b in ((0, 0), (0.0003, 0), (0.0003, 0.0002), (0, 0))])
    return _tag("Placemark", F.concat(_tag("name", name), _tag("description", _s(n % 5 + 1)), _tag("Polygon", _tag("outerBoundaryIs", _tag("LinearRing", _tag("coordinates", pts))))))


def placemark_files(spark, d):
    """``lineitem`` as placemarks of the bundle of its order; names hold the internal id or the site number, and one of the order's two dates."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    k = F.col("l_orderkey")
    rows = li.join(o, k == F.col("o_orderkey")).select(
        (k * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("k"), _pick(BUNDLES, k).alias("source_file"), F.expr(f"l_orderkey div {PER_FILE}").alias("file"),
        "l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "o_orderdate")
    return _files(rows, "raw", "", "kml", "kml", _placemark)


def label_job(spark, d):
    # The sample lists give a site the same number in every plot file.
    sites = table(spark, d, "customer").select(F.concat(F.lit("id_"), _s("c_custkey")).alias("id"), (F.col("c_custkey") % 25 + 1).cast("int").alias("line_no"))
    sample = sites.withColumn("plot_file", F.explode(F.array(*[F.lit(f"Zambia_0.05_n_{p}.csv") for p in sorted(set(PLOTS))])))
    return LT.build(SV.surveys_in_order(survey_files(spark, d)), sample, PM.placemarks_in_order(placemark_files(spark, d)))


_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
JOB_SQL = f"""
o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS dt, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS code,
      {_LIST(BUNDLES)}[CAST(o_orderkey % {len(BUNDLES)} + 1 AS INTEGER)] AS source_file, {_LIST(PLOTS)}[CAST(o_orderkey % {len(PLOTS)} + 1 AS INTEGER)] AS plot FROM orders),
a AS (SELECT *, 1 AS slot, CAST(year(dt) AS INTEGER) AS y, CAST(month(dt) AS INTEGER) AS m, CAST(day(dt) AS INTEGER) AS dd FROM o
      UNION ALL SELECT *, 4, CAST(year(dt) + 1 AS INTEGER), CAST(month(dt) AS INTEGER), 5 FROM o WHERE k % 3 = 0),
sv AS (SELECT *, 'id_' || c AS site_id, CAST(c % 25 + 1 AS INTEGER) AS internal_id, row_number() OVER (PARTITION BY source_file ORDER BY k // {PER_FILE}, k DESC, slot) - 1 AS line FROM a WHERE c IN (SELECT c_custkey FROM customer)),
pg AS (SELECT o.source_file, row_number() OVER (PARTITION BY o.source_file ORDER BY k // {PER_FILE}, k * 1000000 + l_linenumber * 100000 + l_partkey DESC) - 1 AS poly_order, l_linenumber % 5 + 1 AS certainty,
       CAST(CASE WHEN l_linenumber % 2 = 0 THEN c % 25 + 1 ELSE c END AS INTEGER) AS drawn_id, CAST(year(dt) + CASE WHEN l_linenumber % 3 = 0 AND k % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS y, CAST(month(dt) AS INTEGER) AS m,
       CAST(CASE WHEN l_linenumber % 3 = 0 AND k % 3 = 0 THEN 5 ELSE day(dt) END AS INTEGER) AS dd FROM lineitem JOIN o ON l_orderkey = k),
mt AS (SELECT DISTINCT sv.source_file, line, poly_order, certainty FROM sv JOIN pg ON sv.source_file = pg.source_file AND sv.y = pg.y AND sv.m = pg.m AND sv.dd = pg.dd AND (drawn_id = internal_id OR drawn_id = c)),
best AS (SELECT plot, min(v) AS v FROM (SELECT DISTINCT plot, source_file, CASE WHEN regexp_matches(source_file, '^[A-Z]+_[A-Z]+_v2') THEN 1 WHEN regexp_matches(source_file, '^[A-Z]+_[A-Z]+_') AND NOT contains(source_file, 'v2') THEN 2 WHEN regexp_matches(source_file, '^[A-Z]+_v2') THEN 3 ELSE 4 END AS v FROM sv) GROUP BY 1),
kept AS (SELECT DISTINCT sv.plot, source_file FROM sv JOIN best ON sv.plot = best.plot AND v = CASE WHEN regexp_matches(source_file, '^[A-Z]+_[A-Z]+_v2') THEN 1 WHEN regexp_matches(source_file, '^[A-Z]+_[A-Z]+_') AND NOT contains(source_file, 'v2') THEN 2 WHEN regexp_matches(source_file, '^[A-Z]+_v2') THEN 3 ELSE 4 END WHERE NOT contains(source_file, 'MV_76-100')),
once AS (SELECT * FROM (SELECT sv.*, row_number() OVER (PARTITION BY site_id, y, m, dd, split_part(sv.source_file, '_', 1) ORDER BY slot, sv.source_file, line) AS rn FROM sv JOIN kept ON sv.source_file = kept.source_file) WHERE rn = 1)
"""


@query("S1_J4_R1_label_job", "WITH " + JOB_SQL + """, st AS (SELECT source_file, line, count(*) AS n, max(certainty) AS top FROM mt GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY once.source_file, once.line) AS unique_id, once.source_file, once.line, site_id, internal_id, y AS year, m AS month, dd AS day, code AS irrigation, CAST(slot AS INTEGER) AS image_number,
       n IS NOT NULL AS drawn, coalesce(top >= 3, false) AS sure FROM once LEFT JOIN st ON once.source_file = st.source_file AND once.line = st.line""")
def _(spark, d):
    """Pooled label rows of seven bundles: latest versions, repeats dropped, lines in document order."""
    pooled = LT.pool(label_job(spark, d).rows)
    return pooled.select(
        "unique_id", "source_file", "line", "site_id", "internal_id", "year", "month", "day", "irrigation", "image_number",
        F.col("poly_min_size").isNotNull().alias("drawn"), F.col("poly_min_size_hc").isNotNull().alias("sure"))


@query("S4_J2_label_job_polygons", "WITH " + JOB_SQL + """, last AS (SELECT source_file, poly_order, max(line) AS line FROM mt GROUP BY 1, 2),
info AS (SELECT DISTINCT source_file, site_id, internal_id, y, m, dd, plot FROM sv)
SELECT pg.source_file, pg.poly_order, CAST(certainty AS INTEGER) AS certainty, sv.site_id, CASE WHEN sv.site_id IS NOT NULL AND drawn_id = sv.c THEN sv.internal_id ELSE drawn_id END AS internal_id,
       split_part(pg.source_file, '_', 1) AS operator_initials, 'Zambia_0.05_n_' || info.plot || '.csv' AS plot_file
FROM pg LEFT JOIN last ON pg.source_file = last.source_file AND pg.poly_order = last.poly_order LEFT JOIN sv ON sv.source_file = last.source_file AND sv.line = last.line
LEFT JOIN info ON info.source_file = pg.source_file AND info.site_id = sv.site_id AND info.y = pg.y AND info.m = pg.m AND info.dd = pg.dd AND info.internal_id = CASE WHEN drawn_id = sv.c THEN sv.internal_id ELSE drawn_id END
WHERE pg.source_file IN (SELECT source_file FROM once)""")
def _(spark, d):
    """Pooled polygons in document order: the last matching survey row of the same bundle names the site."""
    job = label_job(spark, d)
    return LT.pool_polygons(job.polygons, LT.chosen(job.rows)).select("source_file", "poly_order", "certainty", "site_id", "internal_id", "operator_initials", "plot_file")
