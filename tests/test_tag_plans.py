"""Descriptions are tagged where they lie: one pass, no join, and no scores where a full match is asked for."""

import os

import pytest
from fieldweave.functions import text as X
from fieldweave.operators import tagging as TG

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name, scored", [("P4_uncertainty_tags", 1), ("P5_description_fields", 1), ("P5_exact_synonym_tags", 0), ("P4_exact_phrase_tags", 0)])
def test_texts_are_read_and_dealt_once(spark, name, scored):
    from fieldweave.plans.catalog import QUERIES

    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    assert plan.count("ArrowEvalPython") == scored


def test_tags_are_those_of_the_score(spark):
    texts = ["", None, "5", "lawn", "la", "a commercial lown", "unevn", "only slightly gren and covered", "x" * 300 + " plantatoin", "may be a fishpond", "industrial" * 40, "treecrop"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, d string")
    phrases = [*X.UNCERTAINTY_PHRASES, "lawn", "covered", "plantation"]
    for threshold in (60.0, 75.0, 100.0, 101.0):
        got = {r.i: r.u for r in TG.tag_phrases(df, "d", phrases, threshold, "u").select("i", "u").collect()}
        assert got == {i: sorted(p for p in phrases if t and TG._norm(t) and TG.partial_ratio(TG._norm(t), p) >= threshold) for i, t in enumerate(texts)}
    rows = {r.i: r for r in TG.describe_polygons(df, "d").collect()}
    assert (rows[5].category, rows[2].certainty, rows[1].category, rows[9].uncertainty_explanation) == ("industrial;lawn", 5, X.DEFAULT_CATEGORY, "may be a fishpond")
