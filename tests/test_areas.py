"""Exact areas: many cells, copies, slivers and slanted rings give what one group or a formula gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import areas as AR

MEASURES = {"a": ("any", ["p"]), "b": ("any", ["q"]), "both": ("all", ["p", "q"]), "one": ("any", ["p", "q"])}


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, xy array<struct<x:double,y:double>>, p int, q int").repartition(3)


def test_slivers_and_copies(spark):
    """Strips a millionth wide, far below any scan line, counted once however often they are drawn."""
    w = 1e-6
    rows = [("s", [(0.0, i * 1e-3), (1.0, i * 1e-3), (1.0, i * 1e-3 + w), (0.0, i * 1e-3 + w)], 1, i % 2) for i in range(50)] * 3
    rows += [(None, [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)], 1, 0), (None, [(1.0, 0.0), (2.0, 2.0), (0.0, 2.0)], 0, 1), ("flat", [(0.0, 0.0), (1.0, 1.0)], 1, 1)]
    got = {r["k"]: r for r in AR.exact_areas(table(spark, rows), ["k"], ["p", "q"], MEASURES).collect()}
    assert set(got) == {"s", None}
    assert got["s"]["a"] == pytest.approx(50 * w, rel=1e-9) and got["s"]["both"] == pytest.approx(25 * w, rel=1e-9)
    # The lines x + y = 2 and y = 2 - 2 (x - 1) .. meet only where worked out here: the triangle left of x + y = 2 inside the tip (1, 0).
    r = got[None]
    assert r["a"] == pytest.approx(2.0) and r["b"] == pytest.approx(2.0) and r["one"] == pytest.approx(r["a"] + r["b"] - r["both"])


def test_many_cells_are_one_site(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        c, r = rng.random(2), rng.random((4, 2)) * 0.3
        rows.append(("s", [tuple(map(float, c + v)) for v in r], i % 2, (i + 1) % 2))
    whole = AR.exact_areas(table(spark, rows), ["k"], ["p", "q"], MEASURES).first()
    monkeypatch.setattr(AR, "CELL_RINGS", 3)
    monkeypatch.setattr(AR, "STEP_PAIRS", 64)
    cut = AR.exact_areas(table(spark, rows), ["k"], ["p", "q"], MEASURES).first()
    for name in MEASURES:
        assert cut[name] == pytest.approx(whole[name], rel=1e-9) and whole[name] > 0
    assert whole["one"] == pytest.approx(whole["a"] + whole["b"] - whole["both"], rel=1e-9)
    box = F.struct(F.lit(0.2).alias("south"), F.lit(0.3).alias("west"), F.lit(0.6).alias("north"), F.lit(0.9).alias("east"))
    small = AR.exact_areas(table(spark, rows).withColumn("box", box), ["k"], ["p", "q"], MEASURES, box="box").first()
    monkeypatch.setattr(AR, "CELL_RINGS", 10_000)
    again = AR.exact_areas(table(spark, rows).withColumn("box", box), ["k"], ["p", "q"], MEASURES, box="box").first()
    assert small["one"] == pytest.approx(again["one"], rel=1e-9) and 0 < small["one"] <= 0.24 + 1e-12
