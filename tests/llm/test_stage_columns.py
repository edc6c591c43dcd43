"""Pipeline stages with columns of odd names, null ids, repeated rows and empty tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from fieldweave.llm import jaccard_join

LONG = " ".join(f"word{i}" for i in range(40))


def test_one_of_each_with_clashing_columns(spark):
    rows = [(1, LONG, 1, "a"), (2, LONG + " more", 2, "b"), (3, "other text of five words here", 3, "c"), (None, LONG, 4, "d"), (3, "other text of five words here", 3, "c"), (4, None, 5, "e"), (5, "", 6, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int, doc string")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_line_stage_without_counts(spark):
    docs = spark.createDataFrame([(1, "Menu\none"), (2, "Menu\ntwo"), (None, "Menu"), (3, None)], "doc_id long, text string").withColumn("who", F.lit("clash"))
    left = sorted(map(tuple, corpus_pipeline.fresh_lines(spark, docs, "").collect()), key=str)
    # The order of documents begins with the null id, so its line is the first one.
    assert left == sorted([(1, "one", "clash"), (2, "two", "clash"), (None, "Menu", "clash"), (3, None, "clash")], key=str)
    assert corpus_pipeline.fresh_lines(spark, docs.limit(0), "").count() == 0
