"""Matches of survey rows and polygons against brute force, with repeated keys, missing values and one crowded date."""

import random

from pyspark.sql import functions as F

from fieldweave.operators import labels as L

AT = "internal_id int, year int, month int, day int"


def tables(spark):
    rng = random.Random(5)
    some = lambda *v: rng.choice(v)
    survey = [(rng.randrange(30), f"id_{rng.randrange(1, 6)}", some(1, 2, 3, None), 2020, 1, some(1, 2, None), n) for n in range(40)]
    drawn = [(rng.randrange(45), some(1, 2, 3, 4, 5, None), 2020, 1, some(1, 1, 2, 3, None), some(1, 3, 5, None), some(1.5, 2.0, 7.25, None)) for _ in range(60)]
    return survey, drawn, spark.createDataFrame(survey, f"sid int, site_id string, {AT}, line int"), spark.createDataFrame(drawn, f"pid int, {AT}, certainty int, polygon_area_m2 double")


def brute(survey, drawn):
    return {(s[0], p[0]) for s in survey for p in drawn if s[5] is not None and s[5] == p[4] and p[1] is not None and p[1] in (s[2], int(s[1][3:]))}


def test_matches_against_brute_force(spark):
    survey, drawn, s, p = tables(spark)
    pairs = brute(survey, drawn)
    got = [(r["sid"], r["pid"]) for r in L.survey_polygon_matches(s, p, "sid", "pid").collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    site = {r["pid"]: r["site_id"] for r in L.polygon_site(s, p, "sid", "pid", "line").collect()}
    last = lambda sids: max((x[6], x[0], x[1]) for x in survey if x[0] in sids)[2]
    assert site == {q: last({a for a, b in pairs if b == q}) for q in {b for _, b in pairs}}
    assert {r["pid"] for r in L.unmatched_polygons(s, p, "sid", "pid").collect()} == {x[0] for x in drawn} - {b for _, b in pairs}
    stats = {r["sid"]: tuple(r)[1:] for r in L.polygon_stats(s, p, "sid", "pid").collect()}
    want = {}
    for sid in {a for a, _ in pairs}:
        rows = [x for a, b in pairs if a == sid for x in drawn if x[0] == b]
        areas, high = [x[6] for x in rows if x[6] is not None], [x[6] for x in rows if x[6] is not None and (x[5] or 0) >= 3]
        mean = lambda v: sum(v) / len(v) if v else None
        want[sid] = (len(rows), max((x[5] for x in rows if x[5]), default=None), mean(areas), mean(high), min(areas, default=None), min(high, default=None))
    assert stats.keys() == want.keys()
    for sid, row in want.items():
        assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(stats[sid], row))


def test_crowded_date_makes_no_pairs(spark):
    """300 rows and 300 polygons of one date: stats, sites and the unmatched list never hold the 90,000 pairs, and matches do not shuffle them."""
    one = spark.range(300).select(F.col("id").cast("int").alias("sid"), F.lit("id_9").alias("site_id"), F.lit(1).alias("internal_id"), F.lit(2020).alias("year"), F.lit(1).alias("month"), F.lit(1).alias("day"), F.col("id").alias("line"))
    two = one.select(F.col("sid").alias("pid"), "internal_id", "year", "month", "day", F.lit(5).alias("certainty"), F.lit(2.0).alias("polygon_area_m2"))

    def rows_made(df):
        df.collect()
        nodes, most = [df._jdf.queryExecution().executedPlan()], 0
        while nodes:
            n = nodes.pop()
            kids = n.children()
            nodes += [kids.apply(i) for i in range(kids.size())]
            for inner in ("finalPhysicalPlan", "plan"):
                if n.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec") and hasattr(n, inner):
                    try:
                        nodes.append(getattr(n, inner)())
                    except Exception:
                        pass
            name = n.getClass().getSimpleName()
            if "Join" in name and n.metrics().contains("numOutputRows"):
                most = max(most, n.metrics().apply("numOutputRows").value())
        return most

    assert 0 < rows_made(L.polygon_stats(one, two, "sid", "pid")) <= 300
    assert 0 < rows_made(L.polygon_site(one, two, "sid", "pid", "line")) <= 300
    assert 0 < rows_made(L.unmatched_polygons(one, two, "sid", "pid")) <= 300
    assert L.survey_polygon_matches(one, two, "sid", "pid").count() == 90_000
