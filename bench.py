"""Headline queries, timed warm, one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "A2_detection_metrics", "A3_match_areas", "A10_size_box", "A13_labeler_summary", "A18_location_summary", "A27_metrics_by_factor",
    "F7_consistency_rules", "G6_site_coverage", "G9_burn_rings", "G11_label_pixels", "G19_spread_bad_blocks", "G23_spatial_summaries",
    "J1_survey_polygon_match", "J5_nearest_date_match", "J7_zone_of_point", "M7_curve_metrics", "N2_pixels_per_image", "N5_one_shot_split",
    "N9_downsample_zero", "P4_uncertainty_tags", "R1_latest_versions", "R3_priority_report", "R6_row_ids", "R8_best_scene_good_pixels",
    "S1_S2_survey_documents", "T2_filled_windows", "T5_interpolate", "T7_trajectories", "T9_wide_features", "T15_flatten_pixels", "M1_random_forest",
]


def main() -> None:
    from fieldweave.plans.catalog import QUERIES
    from fieldweave.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, int(cpus))
    spark.range(1000).selectExpr("sum(id)").collect()
    warm, cold = {}, {}
    for name in names:
        for times in (cold, warm):
            t0 = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, warm, summed", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
