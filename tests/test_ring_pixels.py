"""Pixels under rings: every cell by hand, small batches, and no spans in the shuffle."""

import random

from pyspark.sql import functions as F

from fieldweave.operators import geometry as GE


def inside(xy, x, y):
    hits = 0
    for (x1, y1), (x2, y2) in zip(xy, xy[1:] + xy[:1]):
        if (y1 <= y) != (y2 <= y):
            hits += x1 + (y - y1) * (x2 - x1) / (y2 - y1) < x
    return hits % 2 == 1


def drawn(n=120, height=70, width=9):
    draw = random.Random(7)
    rows = []
    for i in range(n):
        x, y, tall = draw.uniform(-2, width), draw.uniform(-3, height), draw.choice([1.0, 4.0, 40.0])
        xy = [(x + draw.uniform(0, 5), y + draw.uniform(0, tall)) for _ in range(draw.choice([3, 4, 5]))]
        rows.append((draw.choice(["a", "a", "a", None]), i, xy, draw.choice([None, 0, 2, 3, 5]), draw.choice(["lawn", "covered", None]), draw.choice(["uneven", None])))
    return rows


def test_label_pixels_by_hand(spark):
    height, width, fine = 70, 9, 4
    rows = drawn()
    df = spark.createDataFrame(rows, "site string, poly_order int, xy array<struct<x:double,y:double>>, certainty int, category string, uncertainty_explanation string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {(r["site"], r["row"], r["col"]): (r["category"], r["irrigated"], r["certainty"], r["coverage"])
               for r in GE.label_pixels(df, ["site"], height, width, 3, fine).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for site in ("a", None):
        mine = [r for r in rows if r[0] == site]
        for row in range(height):
            for col in range(width):
                centre = [r for r in mine if inside(r[2], col + 0.5, row + 0.5)]
                sure = [r for r in mine if (r[3] or 0) >= 3]
                n = sum(any(inside([(x * fine, y * fine) for x, y in r[2]], col * fine + j + 0.5, row * fine + i + 0.5) for r in sure) for i in range(fine) for j in range(fine))
                if centre or n:
                    cats = [GE.CATEGORY_CODES.get(r[4] or "", 1) for r in centre if (r[3] or 0) >= 3]
                    half = n * 2 >= fine * fine
                    want[site, row, col] = (cats[-1] if cats and half else 0, int(half), next((r[3] for r in reversed(centre) if r[3]), 0), n * 100 // fine**2)
    assert len(want) > 300 and got == want


def test_rings_are_shuffled_not_spans(spark):
    df = spark.range(200).select(F.lit("a").alias("site"), F.array(*[F.struct((F.col("id") % 5 + a).cast("double").alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (3, 30), (1, 30))]).alias("xy"))
    plan = GE.coverage_percent(df, ["site"], 32, 10)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
