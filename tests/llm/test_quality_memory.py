"""Scoring for a filter sends a text once and counts features of bounded slices."""

import numpy as np
import pyarrow as pa
from fieldweave.llm import quality


def test_features_are_counted_in_bounded_slices(monkeypatch):
    seen, plain = [], quality.text_features
    monkeypatch.setattr(quality, "text_features", lambda body, offsets: seen.append(len(body)) or plain(body, offsets))
    batch = pa.RecordBatch.from_pydict({"text": [f"Some line {i} of text.\n" * 40 for i in range(2000)]})
    rows = quality.feature_rows(batch, "text")
    assert max(seen) <= 1 << 18 and sum(seen) == sum(len(t) for t in batch.column("text").to_pylist())
    assert np.array_equal(rows[:3], quality.feature_rows(batch.slice(0, 3), "text"))


def test_kept_rows_are_picked_where_they_are_scored(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, score string")
    model = quality.AdditiveModel(0.0, [np.zeros(0)] * len(quality.FEATURES), [np.zeros(1)] * len(quality.FEATURES))
    kept = quality.keep_good(docs, model)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan and "named_struct" not in plan and "struct(" not in plan
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and kept.schema == docs.schema
    assert quality.keep_good(docs, model, 0.6).count() == 0
