"""Physical plans keep the shape the scale notes promise."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(spark, name):
    from fieldweave.plans.catalog import QUERIES

    df = QUERIES[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["R2_drop_repeats", "R3_priority_report", "R5_first_per_site_date"])
def test_first_per_key_is_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


@pytest.mark.parametrize("name", ["J1_survey_polygon_match", "J5_nearest_date_match", "J7_zone_of_point", "A15_rating_confusion", "N9_downsample_zero", "P18_unit_detection"])
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(spark, "F1_operators")
    assert "o_totalprice" not in text.split("ReadSchema:")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["A10_size_box", "A20_describe_by_category", "A21_clip_at_p99", "A22_download_statistics", "A35_pixels_per_parcel", "P18_unit_detection"])
def test_percentiles_have_no_window_in_one_task(spark, name):
    import re

    assert not re.search(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan(spark, name))
