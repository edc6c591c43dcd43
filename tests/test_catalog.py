"""A cross-section of the registered queries against their SQL on the smallest tables.

All of them: ``python tests/check_oracles.py``.
"""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "A2_detection_metrics", "A3_match_areas", "A13_labeler_summary", "A20_describe_by_category", "A27_metrics_by_factor", "F7_consistency_rules",
    "G6_site_coverage", "G9_burn_rings", "G11_label_pixels", "G23_spatial_summaries", "J1_survey_polygon_match", "J5_nearest_date_match_30_days",
    "J7_zone_of_point", "M7_best_split_metrics", "N5_one_shot_split", "R1_latest_versions", "R6_row_ids", "S1_S2_survey_documents", "T2_filled_windows",
    "T9_wide_features",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    from check_oracles import compare, connect

    from fieldweave.plans.catalog import ORACLES, QUERIES

    problems, _ = compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name])
    assert not problems


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "comp_op" in e.entry(spark).columns
