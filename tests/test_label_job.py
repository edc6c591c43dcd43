"""Whole files in their order: later placemarks and later survey rows win, bundle by bundle."""

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import geo as G
from fieldweave.operators import geometry as GE
from fieldweave.plans import label_tables as LT
from fieldweave.sources import placemarks as PM
from fieldweave.sources import surveys as SV


def placemark(name, description, x):
    ring = " ".join(f"{x + a},{-15.5 + b},0" for a, b in ((0, 0), (0.001, 0), (0.001, 0.001), (0, 0.001), (0, 0)))
    return f"<Placemark id='1'><name>{name}</name><description>{description}</description><Polygon><outerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"


def plot(site, x, *slots):
    told = "".join(f"<year{i}><code>2021</code></year{i}><month{i}><code>9</code></month{i}><day{i}><value>6</value></day{i}><irrigation{i}><code>{code}</code></irrigation{i}>" for i, code in slots)
    return f"<plot><id><value>{site}</value></id><location><x>{x}</x><y>-15.5</y></location><plot_file><value>Zambia_0.05_n_1-25.csv</value></plot_file>{told}</plot>"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two bundles with the same internal ids. In the first one both files stand against the order of what they say."""
    folder = tmp_path_factory.mktemp("bundles")
    for bundle in ("JL_1-25", "AB_1-25"):
        (folder / bundle / "1").mkdir(parents=True)
    # By content the first placemark comes last, and so does the first survey row of the day (both have internal id 1: one is the site number of the other).
    (folder / "JL_1-25.kml").write_text("<kml><Document><!-- <Placemark><name>no</name></Placemark> -->" + placemark("JL_1_9.6.2021", "5 z", 22.0) + placemark("JL_1_9.6.2021", "3 a", 22.0) + "</Document></kml>")
    (folder / "JL_1-25" / "1" / "a.xml").write_text("<plots>" + plot("id_900", 22.0, (1, 5), (2, 4)) + "</plots>")
    (folder / "JL_1-25" / "1" / "b.xml").write_text("<plots>" + plot("id_1", 22.0, (1, 2)) + "</plots>")
    (folder / "AB_1-25.kml").write_text("<kml>" + placemark("AB_1_9.6.2021", "4", 22.0) + "</kml>")
    (folder / "AB_1-25" / "1" / "c.xml").write_text("<plots>" + plot("id_900", 22.0, (1, 3)) + "</plots>")
    sample = spark.createDataFrame([("id_900", 1), ("id_1", 2)], "id string, line_no int")
    marks = PM.read_placemark_files(spark, str(folder / "*.kml"))
    return LT.build(SV.read_survey_files(spark, str(folder / "*" / "1" / "*.xml")), sample, marks)


def test_last_row_and_last_polygon_in_document_order(tables):
    polygons = {(r["source_file"], r["poly_order"]): r for r in tables.polygons.collect()}
    assert {k: (r["certainty"], r["site_id"]) for k, r in polygons.items()} == {("JL_1-25", 0): (5, "id_1"), ("JL_1-25", 1): (3, "id_1"), ("AB_1-25", 0): (4, "id_900")}
    # The site number that was drawn becomes the internal id of its own bundle's survey row.
    assert polygons[("JL_1-25", 0)]["internal_id"] == 2 and polygons[("AB_1-25", 0)]["internal_id"] == 1


def test_lines_count_within_a_bundle(tables):
    rows = {(r["source_file"], r["line"]): (r["site_id"], r["image_number"]) for r in tables.labels.collect()}
    assert rows == {("JL_1-25", 0): ("id_900", 1), ("JL_1-25", 1): ("id_900", 2), ("JL_1-25", 2): ("id_1", 1), ("AB_1-25", 0): ("id_900", 1)}
    areas = {(r["source_file"], r["line"]): r["percent_coverage"] for r in tables.labels.collect()}
    assert all(v > 0 for v in areas.values())


def test_later_placemark_takes_the_pixel(tables):
    rings = tables.polygons.where("source_file = 'JL_1-25'").select(
        "source_file", "poly_order", "certainty", F.lit("x").alias("uncertainty_explanation"), F.lit("lawn").alias("category"), G.ring_xy("ring").alias("r"))
    rings = rings.withColumn("xy", F.transform("r", lambda p: F.struct(((p["x"] - 22.0) * 4000).alias("x"), ((p["y"] + 15.5) * 4000).alias("y"))))
    pixels = GE.label_pixels(rings, ["source_file"], 4, 4).select("certainty").distinct().collect()
    assert [r[0] for r in pixels] == [3]


def test_one_named_bundle_still_works(spark, tmp_path):
    (tmp_path / "m.kml").write_text("<kml>" + placemark("JL_1_9.6.2021", "4", 22.0) + "</kml>")
    docs = spark.createDataFrame([("raw/JL_1-25/1/a.xml", plot("id_900", 22.0, (1, 5)))], "path string, xml string")
    out = LT.build(SV.parse_surveys(docs), spark.createDataFrame([("id_900", 1)], "id string, line_no int"), PM.read_placemarks(spark, str(tmp_path / "m.kml")), survey_name="JL_1-25")
    assert [(r["source_file"], r["line"]) for r in out.labels.collect()] == [("JL_1-25", 0)] and LT.pool(out.labels).count() == 1


def test_pooling_measures_no_areas(tables):
    """Who reads no coverage of the pooled rows does not pay for it: what is chosen and numbered is slim, and areas are a join that falls away."""
    pooled = LT.pool(tables.labels)
    few = pooled.select("unique_id", "line", "poly_min_size")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in few and "MapInArrow" in pooled.select("percent_coverage")._jdf.queryExecution().optimizedPlan().toString()
    assert pooled.columns == [*tables.labels.columns, "most_recent", "unique_id"]
    assert all(r["percent_coverage"] > 0 for r in pooled.collect())


def test_pooling_writes_no_rings(spark, tables):
    """Label rows without coverage are at hand before any area is measured; they are the same rows."""
    assert not {"percent_coverage"} & set(tables.rows.columns)
    rows = {(r["source_file"], r["line"]): r["poly_min_size"] for r in tables.rows.collect()}
    assert rows == {(r["source_file"], r["line"]): r["poly_min_size"] for r in tables.labels.collect()}
    slim = {(r["unique_id"], r["source_file"], r["line"]) for r in LT.pool(tables.rows).collect()}
    assert slim == {(r["unique_id"], r["source_file"], r["line"]) for r in LT.pool(tables.labels).collect()}


def test_building_measures_nothing(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(GE, "site_coverage", lambda *a: asked.append(a))
    (tmp_path / "m.kml").write_text("<kml>" + placemark("JL_1_9.6.2021", "4", 22.0) + "</kml>")
    docs = spark.createDataFrame([("raw/JL_1-25/1/a.xml", plot("id_900", 22.0, (1, 5)))], "path string, xml string")
    out = LT.build(SV.parse_surveys(docs), spark.createDataFrame([("id_900", 1)], "id string, line_no int"), PM.read_placemarks(spark, str(tmp_path / "m.kml")), survey_name="JL_1-25")
    assert LT.pool(out.rows).count() == 1 and not asked
