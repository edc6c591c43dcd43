"""Bilinear reading with gaps, extra cells and copies; the source pixels are all that is shuffled."""

import random

from fieldweave.operators import raster as RA


def test_gaps_without_a_join(spark):
    rng = random.Random(2)
    px = [(f, r, c, rng.choice([None, 1.5, -2.0, 4.0])) for f in "ab" for r in range(3) for c in range(4) if rng.random() < 0.7]
    px += [("a", 0, 0, 2.5), ("a", 9, 9, 100.0), ("a", None, 1, 100.0), ("c", None, None, 1.0)]
    df = spark.createDataFrame(px, "file_id string, row int, col int, v double")
    out = RA.resample_bilinear(df, "v", ["file_id"], 3, 4, 5)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["file_id"], r["row"], r["col"]): r["v"] for r in out.collect()}
    assert len(got) == 75
    for (f, r, c), v in got.items():
        y, x = (r + 0.5) * 3 / 5 - 0.5, (c + 0.5) * 4 / 5 - 0.5
        y0, x0, terms = int(y // 1), int(x // 1), []
        for dy in (0, 1):
            for dx in (0, 1):
                w = (y - y0 if dy else 1 - y + y0) * (x - x0 if dx else 1 - x + x0)
                at = (f, min(max(y0 + dy, 0), 2), min(max(x0 + dx, 0), 3))
                terms += [w * p[3] for p in px if p[:3] == at and p[3] is not None]
        assert (v is None) == (not terms) and (v is None or abs(v - sum(terms)) < 1e-9)
