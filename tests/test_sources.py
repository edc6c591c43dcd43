"""Readers and writers on real files."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldweave.plans import label_tables as LT
from fieldweave.sources import placemarks as PM
from fieldweave.sources import sinks as SK
from fieldweave.sources import surveys as SV
from fieldweave.sources import tables as TB


def doc(site, slots, source="true"):
    parts = [f"<id><value>{site}</value></id><location><x>27.1</x><y>-15.2</y><srs>EPSG:4326</srs></location>",
             "<operator><value>Somebody</value></operator><plot_file><value>Zambia_0.05_n_1-25.csv</value></plot_file>",
             f"<natural_dicoloration><value>{source}</value></natural_dicoloration>"]
    for i in range(1, 11):
        y, m, d, c = slots.get(i, (None,) * 4)
        tag = lambda n, k, v: f"<{n}{i}><{k}>{v}</{k}></{n}{i}>" if v is not None else f"<{n}{i}/>"
        parts += [tag("year", "code", y), tag("month", "code", m), tag("day", "value", d), tag("irrigation", "code", c)]
    return "<?xml version='1.0'?><plot>" + "".join(parts) + "</plot>"


SLOTS = {1: (2021, 9, 6, 5), 2: (2021, 2, 30, 4), 3: (2021, 3, 3, None), 4: (None, None, None, 2), 7: (2020, 12, 31, 1)}


def placemark(name, body, desc=None):
    d = f"<description>{desc}</description>" if desc is not None else ""
    return f"<Placemark><name>{name}</name>{d}{body}</Placemark>"


def polygon(*pts):
    c = " ".join(f"{x},{y},0" for x, y in pts)
    return f"<Polygon><outerBoundaryIs><LinearRing><coordinates>\n {c} \n</coordinates></LinearRing></outerBoundaryIs></Polygon>"


@pytest.fixture()
def folder(tmp_path):
    bundle = tmp_path / "raw" / "JL_1-25" / "1"
    bundle.mkdir(parents=True)
    (bundle / "101.xml").write_text(doc("id_500", SLOTS))
    (bundle / "102.xml").write_text(doc("id_501", {}))
    with zipfile.ZipFile(tmp_path / "raw" / "JL_1-25.zip", "w") as z:
        z.write(bundle / "101.xml", "1/101.xml")
        z.write(bundle / "102.xml", "1/102.xml")
        z.writestr("readme.txt", "no survey")
    (tmp_path / "marks.kml").write_text(
        '<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder>'
        + placemark("JL_1_9.6.2021", polygon((27.1, -15.2), (27.101, -15.2), (27.101, -15.199), (27.1, -15.2)), "3\n Uneven")
        + placemark("JL_1_9.6.21", "<Point><coordinates>1,2</coordinates></Point>")
        + placemark("", polygon((0, 0), (1, 0), (0, 1)))
        + placemark("JL_2_9.6.2021", "<Polygon></Polygon>")
        + "</Folder></Document></kml>")
    return tmp_path


def test_survey_folder_and_zip(spark, folder):
    a = SV.answer_rows(SV.read_surveys(spark, str(folder / "raw" / "*" / "1" / "*.xml"))).drop("path").collect()
    b = SV.answer_rows(SV.parse_surveys(SV.read_survey_bundles(spark, str(folder / "raw" / "*.zip")))).drop("path").collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == 2
    r = [x for x in a if x["image_number"] == 1][0]
    assert (r["site_id"], r["operator_initials"], r["year"], r["month"], r["day"], r["irrigation"], r["x"]) == ("id_500", "JL", 2021, 9, 6, 5, 27.1)
    sample = spark.createDataFrame([("id_9", 1), ("id_500", 2)], "id string, line_no int")
    rows = SV.answer_rows(SV.read_surveys(spark, str(folder / "raw" / "*" / "1" / "*.xml")))
    assert {x["internal_id"] for x in SV.internal_ids(rows, sample).collect()} == {2}
    files = rows.select("plot_file").distinct().collect()
    two = spark.createDataFrame([("id_500", files[0][0], 9), ("id_500", "another.csv", 1)], "id string, plot_file string, line_no int")
    assert {x["internal_id"] for x in SV.internal_ids(rows, two).collect()} == {9}


def test_placemarks(spark, folder):
    rows = {r["name"]: r for r in PM.placemark_rows(PM.read_placemarks(spark, str(folder / "marks.kml"))).collect()}
    assert set(rows) == {"JL_1_9.6.2021"} or set(rows) == {"JL_1_9.6.2021", "JL_2_9.6.2021"}
    r = rows["JL_1_9.6.2021"]
    assert len(r["ring"]) == 4 and r["ring"][0]["lat"] == -15.2 and r["geometry_status"] == "ok" and r["internal_id"] == 1


def test_geojson_round_trip(spark, tmp_path):
    ring = [(27.1, -15.2), (27.2, -15.2), (27.1, -15.1), (27.1, -15.2)]
    df = spark.createDataFrame([("a", 3, ring), ("b", None, ring)], "name string, certainty int, ring array<struct<lon:double,lat:double>>")
    SK.write_geojson(df, str(tmp_path / "g"), ["name", "certainty"])
    lines = [json.loads(x) for f in os.listdir(tmp_path / "g") if f.endswith(".txt") for x in open(tmp_path / "g" / f)]
    assert {x["properties"]["name"] for x in lines} == {"a", "b"} and "certainty" in lines[0]["properties"]
    lined = {r["properties"]["name"]: r for r in PM.read_geojson(spark, str(tmp_path / "g")).collect()}
    assert set(lined) == {"a", "b"} and [tuple(p) for p in lined["b"]["ring"]] == ring
    (tmp_path / "bad.json").write_text('{"type": "Point"}')
    with pytest.raises(Exception, match="GeoJSON"):
        PM.read_geojson(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": lines}, indent=2))
    back = {r["properties"]["name"]: r for r in PM.read_geojson(spark, str(tmp_path / "c.geojson")).collect()}
    assert back["a"]["properties"]["certainty"] == "3" and [tuple(p) for p in back["b"]["ring"]] == ring


def test_csv_tables(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    (d / "a.csv").write_text("id,latitude,longitude,agriculture,country\nid_1,-15.0,27.0,0.2,Zambia\n")
    (d / "b.csv").write_text("id,latitude,longitude,agriculture,country\nid_2,-16.0,28.0,0.1,Zambia\n")
    (d / "note.txt").write_text("x")
    assert TB.read_folder(spark, str(d), TB.GRID_SCHEMA).count() == 2
    with pytest.raises(FileNotFoundError):
        empty = tmp_path / "none"
        empty.mkdir()
        TB.read_folder(spark, str(empty), TB.GRID_SCHEMA)
    with pytest.raises(ValueError):
        TB.union_all([])
    (d / "bad.csv").write_text("id,latitude,longitude,agriculture,country\nid_1,north,27.0,0.2,Zambia\n")
    with pytest.raises(Exception):
        TB.read_table(spark, str(d / "bad.csv"), TB.GRID_SCHEMA).collect()


def test_window_metadata(spark, tmp_path):
    w = [{"date_range": ["2021-01-01", "2021-01-11"], "file_exists": True}, {"date_range": ["2021-01-11", "2021-01-21"], "file_exists": False, "masked_fraction": 1.0}]
    (tmp_path / "a_metadata.json").write_text(json.dumps({"file_id": "a", "windows": w}, indent=2))
    (tmp_path / "b_metadata.json").write_text(json.dumps({"file_id": "b", "windows": []}))
    (tmp_path / "c_metadata.json").write_text('{"file_id": "c", "windows": [')
    rows = TB.read_window_metadata(spark, str(tmp_path / "*_metadata.json")).collect()
    assert {r["file_id"] for r in rows} == {"a", "b"} and len(rows) == 3
    from fieldweave.operators.scenes import download_statistics

    s = download_statistics(TB.read_window_metadata(spark, str(tmp_path / "*_metadata.json"))).first()
    assert s["total_samples"] == 2 and s["samples_with_50pct_images"] == 1 and s["median_of_avg_masked_fraction"] == 1.0


def test_ids(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("id_1\n\n  id_2 \n")
    assert sorted(r["id"] for r in TB.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["id_1", "id_2"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source_file string, v int")
    SK.save_table(df, str(tmp_path / "t"), "two rows", "tests", "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2
    rec = spark.read.json(str(tmp_path / "t_metadata")).first()
    assert rec["description"] == "two rows" and rec["file_format"] == "csv"
    with pytest.raises(ValueError):
        SK.save_table(df, str(tmp_path / "u"), "", "", "pickle")
    msg = spark.createDataFrame([("a", "broken")], "source_file string, message string")
    lines = SK.report_lines(df.select("source_file"), msg)
    SK.write_report(lines, str(tmp_path / "r"))
    got = {r["source_file"]: r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()}
    assert got == {"a": "broken", "b": "All checks passed successfully."}
    lab = spark.createDataFrame([("f", "KL", 0, 0, 1)], "file_id string, operator string, row int, col int, category int")
    SK.write_label_pixels(lab, str(tmp_path / "lab"))
    back = spark.read.parquet(str(tmp_path / "lab"))
    assert back.schema["category"].metadata["comment"].startswith("1 small-scale")
    man = spark.createDataFrame([("s", "x", "train", 1), ("t", "y", "test", None)], "site string, stem string, split string, fold int")
    SK.write_split(man, str(tmp_path / "man"))
    assert spark.read.parquet(str(tmp_path / "man")).count() == 2
    m = spark.createDataFrame([("pixel", "overall", "overall", "irrigated", "f1", 0.5), ("pixel", "overall", "overall", "irrigated", "recall", 0.25)],
                              "level string, factor string, category string, class string, metric string, value double")
    assert json.loads(SK.metric_documents(m).first()["document"]) == {"overall": {"overall": {"irrigated": {"f1": 0.5, "recall": 0.25}}}}


def test_label_tables_end_to_end(spark, folder):
    docs = SV.parse_surveys(SV.read_survey_bundles(spark, str(folder / "raw" / "*.zip")))
    sample = spark.createDataFrame([("id_500", 1)], "id string, line_no int")
    marks = PM.read_placemarks(spark, str(folder / "marks.kml"))
    out = LT.build(docs, sample, marks, survey_name="JL_1-25")
    rows = {r["image_number"]: r for r in out.labels.collect()}
    assert set(rows) == {1, 7} and 0 < rows[1]["percent_coverage"] < 100 and rows[7]["percent_coverage"] == 0
    assert rows[1]["poly_min_size"] == pytest.approx(107.5 * 110.6 / 2, rel=0.02)
    rules = {(r["image_number"], r["rule"]) for r in out.issues.collect()}
    assert rules == {(1, 3)}
    p = out.polygons.filter("site_id is not null").first()
    assert p["site_id"] == "id_500" and p["uncertainty_explanation"] == "uneven" and p["category"] == "small-scale"
    pooled = LT.pool(out.labels)
    assert sorted(r["unique_id"] for r in pooled.collect()) == [1, 2]
