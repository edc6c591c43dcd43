"""The trained operators on held-out rows, and the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import quality, toxicity
from fieldweave.llm.learning import id_remainder

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def area(label, score):
    rank = np.argsort(np.argsort(score)) + 1.0
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@needs_tables
def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(docs, labels, id_remainder("doc_id", 3) != 1)
    held = quality.score(docs, model).join(labels, "doc_id").where(id_remainder("doc_id", 3) == 1).toPandas()
    assert area(held.quality.to_numpy(), held.score.to_numpy()) > 0.98
    assert ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.95
    assert model.pairs and len(model.tables) == len(quality.FEATURES)


def made_up(spark):
    rng = np.random.default_rng(3)
    names = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(900):
        words = list(rng.choice(names, rng.integers(5, 60)))
        if i % 5 == 0:
            words[rng.integers(len(words))] = rng.choice(["Grobian", "grobianes", "lump"])
            words.append("lump" if i % 10 else "grobianisch")
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "lump")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)] + [(3, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = made_up(spark)
    model = toxicity.fit(docs, labels, id_remainder("doc_id", 4) != 2)
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    held = scored.join(labels.where("toxic is not null").distinct(), "doc_id").where(id_remainder("doc_id", 4) == 2).toPandas()
    assert area(held.toxic.to_numpy(), held.score.to_numpy()) > 0.99
    assert ((held.score >= 0.3) == (held.toxic == 1)).all()
    assert (model.share < 0.9).any()  # "grob", "grobi" ... repeat each other


def test_label_model_without_labels_to_trust():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    votes = np.stack([rng.random(3000) < np.where(y, a, 0.03) for a in (0.8, 0.6, 0.7, 0.5)], axis=1)
    label = np.where(rng.random(3000) < 0.1, y, -1).astype(int)
    posterior, rates, _ = toxicity.label_model(votes, label)
    assert np.abs(rates[1] - [0.8, 0.6, 0.7, 0.5]).max() < 0.08
    assert ((posterior > 0.5) == y).mean() > 0.93


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)]])
def test_nothing_to_learn(spark, labels):
    docs = spark.createDataFrame([(1, "a b", 1), (2, None, 2), (None, "", 3)], "doc_id long, text string, x long")
    marks = spark.createDataFrame([(*m, 1) for m in labels], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    for made in (quality.score(docs, quality.fit(docs, marks, every)), toxicity.score(docs, toxicity.fit(docs, marks, every)), quality.score(docs.limit(0), quality.fit(docs, marks, every))):
        assert made.where("score is null").count() == 0
    assert quality.keep_good(docs, quality.fit(docs, marks, every)).columns == docs.columns


def test_additive_tables_learn_steps_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_additive(x, y)
    assert (1, 0) in model.pairs and ((model.score(x) >= 0.5) == y).mean() > 0.95


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = docs.select("doc_id")
    out = corpus_pipeline.run(spark, FOLDER)
    kept = out.count()
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0.6 * docs.count() < kept < docs.count() and out.join(ids, "doc_id", "left_anti").count() == 0
    good = corpus_pipeline.good_documents(spark, docs, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    assert good.columns[:5] == docs.columns and good.where("quality = 0").count() <= 2
