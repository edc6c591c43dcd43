"""Toxic documents of sf0.1 that the model must find, on rows that it has not seen."""

import os

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import catalog

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_recall_and_precision_held_out(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    held = catalog.op2_toxicity(spark, FOLDER).where("held_out").join(labels, "doc_id").where("toxic is not null")
    n = held.agg(F.count_if(F.expr("toxic = 1")).alias("toxic"), F.count_if(F.expr("predicted = 1")).alias("found"), F.count_if(F.expr("toxic = 1 and predicted = 1")).alias("hits")).first()
    print(n)
    assert n.hits / n.toxic >= 0.8 and n.hits / n.found >= 0.95
