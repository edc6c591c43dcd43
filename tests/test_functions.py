"""Scalar rules on hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.functions import geo as G
from fieldweave.functions import keys as K
from fieldweave.functions import series as SR
from fieldweave.functions import text as X
from fieldweave.functions import values as V
from fieldweave.operators import tagging as TG


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("name,want", [
    ("AB_3_9.6.2021", ("AB", 3, 9, 6, 2021, "ok")),
    ("ab_3_9.6.21", ("AB", 3, 9, 6, 2021, "year_fixed")),
    ("AB_3_9.6.202", ("AB", 3, 9, 6, 202, "year_odd")),
    ("AB_3_9.2021", ("AB", 3, None, None, None, "date_parts")),
    ("AB_x_9.6.2021", (None, None, None, None, None, "error")),
    ("AB_3", (None, None, None, None, None, "error")),
])
def test_placemark_name(spark, name, want):
    assert tuple(one(spark, K.placemark_parts(F.lit(name)))) == want


def test_screenshot_names(spark):
    assert tuple(one(spark, K.screenshot_parts(F.lit("a/201-225_13_07-31-23.png")))) == ("201-225", 13, 7, 31, 2023)
    assert tuple(one(spark, K.screenshot_parts(F.lit("201-225_16-06-26-19.png")))) == ("201-225", 16, 6, 26, 2019)
    assert tuple(one(spark, K.screenshot_parts(F.lit("201-225_16-06-26-50.png"))))[4] == 1950
    assert one(spark, K.screenshot_parts(F.lit("holiday.png"))) is None


def test_raw_names(spark):
    assert tuple(one(spark, K.raw_image_parts(F.lit("site_a_b_2020_77.TIF")))) == ("77", "tif")
    assert tuple(one(spark, K.raw_image_parts(F.lit("5_99_2021.09.16_image.json")))) == ("5", "json")
    assert tuple(one(spark, K.raw_mask_parts(F.lit("5_99_2021.09.16_KL_label.tif")))) == ("5", "99", "2021.09.16", "tif")
    assert one(spark, K.raw_mask_parts(F.lit("readme.txt"))) is None


def test_dates(spark):
    assert one(spark, K.ymd_date(F.lit(2021), F.lit(2), F.lit(30))) is None
    assert str(one(spark, K.ymd_date(F.lit(2021), F.lit(2), F.lit(3)))) == "2021-02-03"
    df = spark.createDataFrame([("PS", 2021, 1, 1), ("KL", 2021, 1, 1)], "operator_initials string, year int, month int, day int")
    got = {r[0]: r[1:] for r in V.shift_back_one_day(df).collect()}
    assert tuple(got["PS"]) == (2020, 12, 31) and tuple(got["KL"]) == (2021, 1, 1)


def test_certainty_and_farm_class(spark):
    assert one(spark, X.certainty_of(F.lit("3\n Uneven"))) == 3
    assert one(spark, X.certainty_of(F.lit("Uneven"))) == 5
    assert one(spark, X.certainty_of(F.lit("  "))) == 5
    assert [one(spark, V.farm_class_m2(F.lit(x))) for x in (499.0, 500.0, 5000.0, float("nan"))] == ["smallholder", "medium", "large", "none"]
    assert one(spark, V.farm_class_ha(F.lit(1), F.lit(0.0))) == "unknown"


BOXES = [
    ((-17.146892667882046, 27.1071721513814), (-17.15141029504564, 27.1024730149089, -17.1423747110346, 27.1118710606301)),
    ((-16.15829617864069, 28.18225451770237), (-16.16281425251669, 28.17757942318091, -16.15377779511203, 28.18692939993126)),
]


@pytest.mark.parametrize("centre,want", BOXES)
def test_geodesic_box(spark, centre, want):
    got = one(spark, G.geodesic_box(F.lit(centre[0]), F.lit(centre[1])))
    assert max(abs(a - b) for a, b in zip(got, want)) < 5e-7


def test_utm(spark):
    assert one(spark, G.utm_epsg(F.lit(27.1), F.lit(-17.0))) == 32735
    x, y = G.to_utm(F.lit(27.0), F.lit(0.0), 35)
    assert abs(one(spark, x) - 500_000) < 1e-6 and abs(one(spark, y) - 10_000_000) < 1e-6
    # a meridian arc from the equator: scale 0.9996 of the ellipsoid's arc length to 15 degrees
    _, y = G.to_utm(F.lit(27.0), F.lit(-15.0), 35)
    phi = np.linspace(0, math.radians(15), 200_001)
    m = G.A * (1 - G.E2) / (1 - G.E2 * np.sin(phi) ** 2) ** 1.5
    arc = float(np.trapezoid(m, phi))
    assert abs((10_000_000 - one(spark, y)) - 0.9996 * arc) < 1e-3
    for lon, lat in ((24.2, -9.0), (28.5, -15.4), (30.0, -17.9)):
        zone = 35
        e, n = G.to_utm(F.lit(lon), F.lit(lat), zone)
        back = G.from_utm(e, n, zone)
        assert abs(one(spark, back[0]) - lon) < 1e-9 and abs(one(spark, back[1]) - lat) < 1e-9


def test_box_area(spark):
    ring = G.box_ring(G.geodesic_box(F.lit(-15.0), F.lit(27.2)))
    assert abs(one(spark, G.shoelace(G.ring_to_utm(ring))) / 1e6 - 0.9996**2) < 1e-3
    w = one(spark, G.metric_box(F.lit(27.2), F.lit(-15.0)))
    assert w["minx"] < 27.2 < w["maxx"] and w["miny"] < -15.0 < w["maxy"]


def ring(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_ring_tests(spark):
    bow = ring([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])
    assert one(spark, G.contains(bow, F.lit(0.2), F.lit(1.0))) and not one(spark, G.contains(bow, F.lit(1.0), F.lit(0.2)))
    tri = ring([(0, 0), (4, 0), (0, 4)])
    box = (F.lit(1.9), F.lit(1.9), F.lit(3.0), F.lit(3.0))
    assert one(spark, G.overlaps_box(tri, *box))
    assert not one(spark, G.overlaps_box(tri, F.lit(2.1), F.lit(2.1), F.lit(3.0), F.lit(3.0)))
    assert one(spark, G.overlaps_box(ring([(-9, -9), (9, -9), (9, 9), (-9, 9)]), *box))
    assert one(spark, G.overlaps_box(ring([(2.2, 2.2), (2.4, 2.2), (2.3, 2.4)]), *box))


SERIES = [
    ([None, 1.0, None, 3.0, None], [1.0, 1.0, 2.0, 3.0, 3.0]),
    ([None, None, 4.0, None, None], [4.0] * 5),
    ([None] * 5, [0.0] * 5),
    ([1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0, 3.0, 4.0, 5.0]),
]


@pytest.mark.parametrize("v,want", SERIES)
def test_interpolate(spark, v, want):
    col = F.lit(v) if any(x is not None for x in v) else F.array(*[F.lit(None).cast("double")] * 5)
    df = spark.createDataFrame([(v,)], "v array<double>")
    assert df.select(SR.interpolate("v")).first()[0] == want
    assert col is not None


def test_smooth_and_summary(spark):
    df = spark.createDataFrame([([2.0] * 7,)], "v array<double>")
    assert df.select(SR.smooth("v")).first()[0] == pytest.approx([2.0] * 7)
    v = [float(x) for x in np.random.default_rng(1).normal(size=42)]
    df = spark.createDataFrame([(v,)], "v array<double>")
    s = df.select(SR.summary("v").alias("s")).select("s.*").first()
    a = np.array(v)
    assert s["std"] == pytest.approx(a.std()) and s["slope"] == pytest.approx(np.polyfit(np.arange(42), a, 1)[0])
    assert s["late_minus_early"] == pytest.approx(a[-3:].mean() - a[:3].mean()) and s["n_green"] == (a > 0.4).sum()
    sm = df.select(SR.smooth("v", 3)).first()[0]
    pad = np.concatenate([a[:1], a, a[-1:]])
    assert sm == pytest.approx(np.convolve(pad, np.ones(3) / 3, "valid"))


def test_degrade_repeats(spark):
    df = spark.createDataFrame([(i, [float(j) for j in range(20)]) for i in range(50)], "id int, v array<double>")
    d = SR.degrade("v", ["id"], 0.4, 0.1, 3)
    a = sorted(map(str, df.repartition(1).select("id", d).collect()))
    b = sorted(map(str, df.repartition(8).select("id", d).collect()))
    assert a == b


def naive_partial_ratio(s1, s2):
    """Every window, quadratic subsequence table."""
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    if not s1 or not s2:
        return 100.0 if s1 == s2 else 0.0
    short, long = (s1, s2) if len(s1) <= len(s2) else (s2, s1)
    best = 0.0
    for a, b in ((short, long), (long, short)) if len(s1) == len(s2) else ((short, long),):
        m = len(a)
        spans = [b[i:i + m] for i in range(len(b) - m + 1)] + [b[:k] for k in range(1, m)] + [b[-k:] for k in range(1, m)]
        best = max([best] + [200.0 * lcs(a, w) / (m + len(w)) for w in spans])
    return best


def test_partial_ratio_against_brute_force():
    rnd = random.Random(7)
    for _ in range(300):
        a = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 12)))
        b = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 40)))
        assert TG.partial_ratio(a, b) == pytest.approx(naive_partial_ratio(a, b))
    assert TG.partial_ratio("x" * 70 + "y", "a" * 30 + "x" * 70) == pytest.approx(naive_partial_ratio("x" * 70 + "y", "a" * 30 + "x" * 70))


@pytest.mark.parametrize("text,tags,category", [
    ("5\nuneven", ["uneven"], "small-scale"),
    ("3\n Unevn!", ["uneven"], "small-scale"),
    ("2 only slightly gren", ["only slightly green"], "small-scale"),
    ("uneven, may be a fishpond", ["may be a fishpond", "uneven"], "small-scale"),
    ("4 comercial farm", [], "industrial"),
    ("agroforestry", [], "tree_crop"),
    # "lant" holds three of the four letters of "lawn" in order: 75, just enough
    ("plantation", [], "lawn;tree_crop"),
    ("3 uNCLEAr sings of ag", ["unclear signs of agriculture"], "small-scale"),
    ("3 may be naturally green", ["may naturally be green"], "small-scale"),
    ("4\n", [], "small-scale"),
    ("qqqq", [], "small-scale"),
    ("   ", [], "small-scale"),
    (None, [], "small-scale"),
])
def test_description(spark, text, tags, category):
    df = spark.createDataFrame([(1, text)], "id int, description string")
    r = TG.describe_polygons(df).first()
    assert [t for t in r["uncertainty_explanation"].split(";") if t] == tags
    assert r["category"] == category
    if text is None or not text.strip():
        assert r["certainty"] == 5
