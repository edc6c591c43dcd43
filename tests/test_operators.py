"""Table operators on small fixtures and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.functions import geo as G
from fieldweave.operators import agreement as A
from fieldweave.operators import evaluation as E
from fieldweave.operators import geometry as GE
from fieldweave.operators import labels as L
from fieldweave.operators import ranking as R
from fieldweave.operators import raster as RA
from fieldweave.operators import sampling as N
from fieldweave.operators import scenes as S
from fieldweave.operators.balance import nearest_neighbours


def winners(spark, rows):
    df = spark.createDataFrame(rows, "plot_file string, source_file string")
    return sorted(r["source_file"] for r in L.latest_versions(df).collect())


def test_latest_versions(spark):
    assert winners(spark, [("p", "JL_AB_v2_1-25"), ("p", "JL_AB_1-25"), ("p", "AB_v2_1-25"), ("p", "AB_1-25")]) == ["JL_AB_v2_1-25"]
    assert winners(spark, [("p", "JL_AB_26-50"), ("p", "AB_v2_26-50"), ("p", "AB_26-50")]) == ["JL_AB_26-50"]
    assert winners(spark, [("p", "AB_v2_51-75"), ("p", "AB_51-75")]) == ["AB_v2_51-75"]
    assert winners(spark, [("p", "AB_1-25"), ("q", "JL_AB_1-25")]) == ["AB_1-25", "JL_AB_1-25"]
    assert winners(spark, [("p", "JL_AB_v2_1025-1049"), ("p", "PS_1025-1049")]) == ["JL_AB_v2_1025-1049", "PS_1025-1049"]
    assert winners(spark, [("p", "KL_MV_76-100"), ("p", "MV_76-100")]) == []
    assert winners(spark, [("p", "lower_case"), ("p", "DSB_AB_v2_1-25")]) == ["DSB_AB_v2_1-25"]
    assert winners(spark, [("p", "JL_AB_v2_101-125"), ("p", "AB_JL_101-125")]) == ["JL_AB_v2_101-125"]
    assert winners(spark, [("p", "AB_JL_v2_101-125"), ("p", "JL_AB_v2_101-125")]) == ["AB_JL_v2_101-125", "JL_AB_v2_101-125"]


def test_consistency_rules(spark):
    rows = [(1, 1, 2, 3), (2, 3, None, None), (3, 5, 1, 4), (4, 3, 1, 5), (5, 5, 1, 5), (6, 1, None, None), (7, 5, None, None)]
    df = spark.createDataFrame(rows, "line int, irrigation int, n_polygons long, max_certainty int").withColumns(
        {"internal_id": F.lit(7), "year": F.lit(2021), "month": F.lit(9), "day": F.lit(6)})
    got = {(r["line"], r["rule"]) for r in L.consistency_issues(df).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (7, 2), (7, 3)}
    text = L.consistency_issues(df).filter("line = 1").select(L.issue_message().alias("m")).first()["m"]
    assert text == "Row 1 (internal_id 7, 6/9/2021): survey marked irrigation as 1 (no irrigation) but found 2 matching polygon(s)."


def box_rows(spark, rings, certainties, categories):
    im = spark.range(1).select(F.lit(1).alias("k"), F.struct(F.lit(0.0).alias("south"), F.lit(0.0).alias("west"), F.lit(1.0).alias("north"), F.lit(1.0).alias("east")).alias("box"))
    data = [(1, [(float(x), float(y)) for x, y in r], c, cat) for r, c, cat in zip(rings, certainties, categories)]
    return im, spark.createDataFrame(data, "k int, ring array<struct<lon:double,lat:double>>, certainty int, category string")


def test_site_coverage(spark):
    half = [(0, 0), (0.5, 0), (0.5, 1), (0, 1)]
    shifted = [(0.25, 0), (0.75, 0), (0.75, 1), (0.25, 1)]
    bow = [(0, 0), (1, 1), (1, 0), (0, 1)]
    out = [(-1, 0), (0.1, 0), (0.1, 1), (-1, 1)]
    im, p = box_rows(spark, [half, shifted], [5, 2], ["lawn", "covered"])
    r = GE.site_coverage(im, p, "k").first()
    assert r["percent_coverage"] == pytest.approx(75, abs=1e-6) and r["percent_coverage_hc"] == pytest.approx(50, abs=1e-6)
    assert r["percent_coverage_hc_lawn"] == pytest.approx(50, abs=1e-6) and r["percent_coverage_hc_covered"] == 0
    for ring, want in ((bow, 50), (out, 10)):
        im, p = box_rows(spark, [ring], [5], ["industrial;lawn"])
        r = GE.site_coverage(im, p, "k").first()
        assert r["percent_coverage"] == pytest.approx(want, abs=0.1) and r["percent_coverage_hc_industrial"] == pytest.approx(want, abs=0.1)
    im, p = box_rows(spark, [half], [5], ["lawn"])
    assert GE.site_coverage(im, p.filter("certainty > 9"), "k").first()["percent_coverage"] == 0


def test_match_areas_invariants(spark):
    rnd = random.Random(3)
    rows = []
    for op in ("KL", "MV"):
        for _ in range(6):
            x, y, w, h = rnd.uniform(0, .01), rnd.uniform(0, .01), rnd.uniform(.001, .004), rnd.uniform(.001, .004)
            rows.append(("s", op, [(x, y), (x + w, y), (x + w / 2, y + h)]))
    p = spark.createDataFrame(rows, "site_id string, operator_initials string, ring array<struct<lon:double,lat:double>>").withColumn("image_date", F.lit("2021-01-01").cast("date"))
    m = spark.range(1).select(F.lit("MV").alias("comp_op"), F.lit("s").alias("site_id"), F.lit("2021-01-01").cast("date").alias("gt_date"), F.lit("2021-01-01").cast("date").alias("comp_date"))
    a = GE.match_areas(m, p, "KL").first()
    assert a["union_area"] == pytest.approx(a["gt_area"] + a["comp_area"] - a["intersection_area"])
    r = A.image_area_metrics(GE.match_areas(m, p, "KL")).first()
    assert r["iou"] <= min(r["precision"], r["recall"]) + 1e-12


def test_coverage_never_above_100(spark):
    ring = [(0.0, 0.0), (5.0, 0.0), (5.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([("f", ring), ("f", ring)], "file_id string, xy array<struct<x:double,y:double>>")
    c = GE.coverage_percent(df, ["file_id"], 10, 10).agg(F.min("coverage"), F.max("coverage"), F.count("*")).first()
    assert tuple(c) == (100, 100, 20)


def test_points_in_zones(spark):
    z = spark.createDataFrame([("a", [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], "country string, ring array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame([(1, 0.2, 0.2), (2, 0.9, 0.9), (3, 7.0, 7.0)], "id int, x double, y double")
    assert {r["id"]: r["country"] for r in GE.join_zones(p, z, "x", "y", ["country"]).collect()} == {1: "a", 2: None, 3: None}


def test_footprint_share(spark):
    box = F.struct(F.lit(0.0).alias("south"), F.lit(0.0).alias("west"), F.lit(1.0).alias("north"), F.lit(1.0).alias("east"))
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)],), (None,)], "footprint array<struct<lon:double,lat:double>>").withColumn("box", box)
    got = [r[0] for r in df.select(GE.footprint_share(df)).collect()]
    assert got[0] == pytest.approx(50, abs=0.1) and got[1] == 100


@pytest.mark.parametrize("n,accuracy", [(7, 100), (5000, 60), (3000, 10_000)])
def test_group_percentiles(spark, n, accuracy):
    rng = np.random.default_rng(n)
    v = np.round(rng.lognormal(size=n), 2)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(x)) for i, x in enumerate(v)], "g string, v double").repartition(5)
    pts = {"p02": 0.02, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    for r in R.group_percentiles(df, ["g"], "v", pts, accuracy).collect():
        mine = v[[i % 3 != 0 for i in range(n)]] if r["g"] == "a" else v[[i % 3 == 0 for i in range(n)]]
        for name, q in pts.items():
            assert r[name] == pytest.approx(np.percentile(mine, q * 100))
    r = R.group_percentiles(df, [], "v", {"m": 0.5}, accuracy).first()
    assert r["m"] == pytest.approx(np.median(v))


def test_running_totals_and_curve(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.uniform(0, 1, 600), 2)
    p[:50] = rng.uniform(0.5, 0.5000001, 50)
    y = (rng.uniform(0, 1, 600) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int").repartition(6)
    got = {r["threshold"]: r for r in E.score_curve(df, "y", "p").collect()}
    for t in np.unique(p):
        assert got[t]["tp"] == int(y[p >= t].sum()) and got[t]["flagged"] == int((p >= t).sum())
    m = E.curve_metrics(E.score_curve(df, "y", "p")).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert m["roc_auc"] == pytest.approx(auc)


def test_one_class_scores(spark):
    df = spark.createDataFrame([(0.2, 0), (0.2, 0), (0.9, 0)], "p double, y int")
    m = E.curve_metrics(E.score_curve(df, "y", "p")).first()
    assert m["average_precision"] == 0 and m["roc_auc"] is None


def test_hashed_sample_exact_and_stable(spark):
    rows = [(i, "hot" if i < 900 else f"k{i % 7}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, k string")
    a = sorted(r["id"] for r in R.hashed_sample(df.repartition(1), ["k"], 20, 5, ["id"]).collect())
    b = sorted(r["id"] for r in R.hashed_sample(df.repartition(8), ["k"], 20, 5, ["id"]).collect())
    assert a == b
    got = {r["k"]: r["n"] for r in R.hashed_sample(df, ["k"], 20, 5, ["id"]).groupBy("k").agg(F.count("*").alias("n")).collect()}
    have = {}
    for _, k in rows:
        have[k] = have.get(k, 0) + 1
    assert got == {k: min(20, n) for k, n in have.items()}
    assert R.hashed_sample(df, [], 10_000, 5, ["id"]).count() == 1000 and R.hashed_sample(df, [], 0, 5, ["id"]).count() == 0


def test_row_ids(spark):
    df = spark.createDataFrame([("a" if i < 700 else "b", i) for i in range(1000)], "s string, line int").repartition(7)
    got = R.numbered(df, ["s", "line"]).orderBy("unique_id").collect()
    assert [r["unique_id"] for r in got] == list(range(1, 1001)) and [r["line"] for r in got] == list(range(1000))


def test_splits_leak_nothing(spark):
    sites = spark.createDataFrame([(f"s{i}", int(i % 9 == 0)) for i in range(200)], "site string, y int")
    a = N.one_shot_split(sites)
    assert N.shared_sites(a).count() == 0 and a.count() == 200
    n = {(r["y"], r["split"]): r["n"] for r in a.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert n[(1, "test")] == 5 and n[(0, "test")] == 35
    few = N.one_shot_split(spark.createDataFrame([("a", 0), ("b", 1)], "site string, y int"))
    assert [r["split"] for r in few.collect()] == ["train", "train"]
    thin = N.one_shot_split(spark.createDataFrame([(f"s{i}", int(i == 0)) for i in range(20)], "site string, y int"))
    assert thin.filter("stratified").count() == 0 and thin.count() == 20
    f = N.heldout_and_folds(sites)
    assert N.shared_sites(f).count() == 0 and f.filter("split = 'train' and fold is null").count() == 0


def test_windows_and_steps(spark):
    d = spark.sql("select date'2021-09-16' as d")
    w = S.make_windows(d, "d").orderBy("t").collect()
    assert len(w) == 42 and str(w[0]["start"]) == "2020-12-02" and w[0]["end"] == w[1]["start"]
    c = S.make_windows(d, "d", centred=True).filter("start <= d and d < end").collect()
    assert [r["t"] for r in c] == [21]
    assert d.select(S.window_step("d", F.lit("2025-01-01").cast("date"))).first()[0] == 21


def test_crop_pad_outline_rebuild(spark):
    px = spark.createDataFrame([("f", 0, r, c, r * 10 + c) for r in range(4) for c in range(5)], "file_id string, t int, row int, col int, b int")
    got = {(r["row"], r["col"]): r["b"] for r in RA.crop_or_pad(px, 4, 5, 2, ["b"]).collect()}
    assert got == {(0, 0): 11, (0, 1): 12, (1, 0): 21, (1, 1): 22}
    pad = {(r["row"], r["col"]): r["b"] for r in RA.crop_or_pad(px, 4, 5, 7, ["b"]).collect()}
    assert len(pad) == 49 and pad[(1, 1)] == 0 and pad[(0, 0)] is None and pad[(4, 5)] == 34
    edges = RA.outline(spark.createDataFrame([("f", 0, 0), ("f", 0, 1)], "file_id string, row int, col int"))
    assert edges.count() == 6
    g = RA.rebuild_mask(px.select("file_id", "row", "col", F.lit(1).alias("v")), px, 4, 6, "v")
    assert g.filter("v = -1").count() == 4


def test_nearest_neighbours_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in nearest_neighbours(df, "id", "v", 3, blocks=5).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(120):
        assert [got[i][k] for k in (1, 2, 3)] == list(np.argsort(d[i])[:3])


def test_shoelace_needs_no_closing_point(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 3), (0, 3))])
    assert spark.range(1).select(G.shoelace(ring)).first()[0] == 6.0


def test_phrase_hits_are_those_of_the_score():
    """Batches with their bounds against one score at a time, near and far from the threshold."""
    from fieldweave.operators import tagging as TG

    rng = np.random.default_rng(4)
    phrases = ["uneven", "only slightly green", "may be a fishpond", "x", "z" * 70]
    texts = ["", "uneven", "unven", "une", "only slghtly green", "ün even", "a\tb uneven\n"]
    for _ in range(150):
        p = phrases[rng.integers(0, 3)]
        letters = [c for c in p if rng.random() > 0.2]
        texts.append("".join(rng.choice(list("abe nuvxyz"), rng.integers(0, 30))) + "".join(letters) + "".join(rng.choice(list("ghi ly"), rng.integers(0, 30))))
    for threshold in (60.0, 75.0, 100.0):
        assert TG.phrase_hits(texts, phrases, threshold) == [[TG.partial_ratio(t, p) >= threshold for p in phrases] for t in texts]


def test_clip_to_box_is_exact(spark):
    """Slanted and dented rings against areas worked out by hand."""
    rings = [[(-1.0, -1.0), (3.0, -1.0), (1.0, 3.0)], [(0.25, 0.25), (0.75, 0.25), (0.5, 0.75)], [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0)], [(-1.0, 0.0), (0.5, 0.5), (-1.0, 1.0), (2.0, 1.0), (2.0, 0.0)]]
    box = F.struct(F.lit(0.0).alias("south"), F.lit(0.0).alias("west"), F.lit(1.0).alias("north"), F.lit(1.0).alias("east"))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "i int, footprint array<struct<lon:double,lat:double>>").withColumn("box", box)
    got = {r[0]: r[1] for r in df.select("i", GE.footprint_share(df)).collect()}
    # The first covers the box but for a corner: its left side is y = 2x + 1.
    assert got == pytest.approx({0: 100.0, 1: 12.5, 2: 0.0, 3: 100.0 * (1 - 0.5 * (1 / 3) * 0.5)}, abs=1e-9)


def test_zone_tree_is_deep_only_where_zones_are_dense(spark):
    """Many narrow zones in one cell and a few wide ones: the same zone for every point as a plain test of all, in cells with few zones."""
    rows = [(f"n{i}", [(1.0 + i * 0.004, 1.0), (1.0 + i * 0.004 + 0.003, 1.0), (1.0 + i * 0.004 + 0.003, 1.1), (1.0 + i * 0.004, 1.1)]) for i in range(60)] + [("wide", [(3.0, 3.0), (9.0, 3.0), (9.0, 9.0), (3.0, 9.0)])]
    zones = spark.createDataFrame(rows, "name string, ring array<struct<lon:double,lat:double>>")
    rng = np.random.default_rng(8)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.uniform([0.95, 0.98], [1.3, 1.12], (300, 2)), rng.uniform(2, 10, (50, 2))]))] + [(999, None, 1.0)]
    points = spark.createDataFrame(pts, "i int, x double, y double")
    got = {r["i"]: r["name"] for r in GE.join_zones(points, zones, "x", "y", ["name"], 0.5, most=6).collect()}
    want = {i: next((n for n, ring in rows if x is not None and ring[0][0] < x < ring[1][0] and ring[0][1] < y < ring[2][1]), None) for i, x, y in pts}
    assert got == want and len([n for n in want.values() if n]) > 100
    cells, splits = GE.zone_cells(zones, 0.5, most=6)
    assert len(splits) > 2 and cells.groupBy("level", "cx", "cy").count().agg(F.max("count")).first()[0] <= 6
    assert cells.filter("name = 'wide'").select("level").distinct().collect()[0][0] == 0
