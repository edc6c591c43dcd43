"""Equal lines below the length of near ones."""

import pytest

from fieldweave.llm import line_dedup


def test_short_equal_lines_go(spark):
    long = "a line that is long enough for the near step"
    rows = [(1, f"Menu\n\nHome\n{long}"), (2, "Menu\n\nHomE\nMenu"), (3, f"Home\n{long}!\nx"), (4, None), (5, ""), (6, "Menu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs, edits=2, least=32, least_equal=1).collect()}
    assert made == {1: (rows[0][1], 4, 0), 2: ("\nHomE", 4, 2), 3: ("x", 3, 2), 4: (None, 0, 0), 5: ("", 1, 0), 6: ("", 1, 1)}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs, least=32, least_equal=33)


def test_pipeline_stage_takes_short_lines(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "Menu\none", 8), (2, "Menu\ntwo", 8), (3, "Menu", 4)], "doc_id long, text string, n_chars long")
    left = sorted(map(tuple, corpus_pipeline.fresh_lines(spark, docs, "").collect()))
    assert left == [(1, "Menu\none", 8), (2, "two", 3)]
