"""Labelled samples and logistic helpers for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def least_hashes(ids: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` rows with the least hash of ``doc_id``.

    A bound on the hash, from the number of rows, leaves half as many again to be sorted, so the last step is small at every size.
    """
    n = ids.count()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    bound = min((1 << 63) - 1, int((1.5 * rows + 100) / max(n, 1) * (1 << 63)))
    return ids.where(place <= bound).orderBy(place, "doc_id").limit(rows)


def sample_of(docs: DataFrame, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, body) of ``rows`` documents, those with the least hash of the id; null ids and texts are left out, of repeated documents the least text counts."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).where(F.col("doc_id").isNotNull() & F.col("body").isNotNull())
    chosen = least_hashes(docs.select(F.col(doc_id).alias("doc_id")).where(F.col("doc_id").isNotNull()), rows)
    return texts.join(F.broadcast(chosen.distinct()), "doc_id").groupBy("doc_id").agg(F.min("body").alias("body"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, body, label) of at most ``rows`` labelled documents, those with the least hash of the id.

    ``allowed`` is a condition on ``doc_id``. Null labels and ids are left out; of repeated labels the largest counts, of
    repeated documents the least text; null text is empty. The chosen ids are at most ``rows`` small rows, so they are broadcast.
    """
    known = labels.where(allowed & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("label")).where(F.col("label").isNotNull())
    chosen = least_hashes(known, rows)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("body").alias("body"), F.first("label").alias("label"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit_logistic(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton steps for a logistic regression on targets between 0 and 1; the intercept is not penalised."""
    design = np.c_[x.astype(np.float64), np.ones(len(x))]
    ridge = np.r_[np.full(x.shape[1], penalty), 1e-6]
    weights = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = sigmoid(design @ weights)
        slope = design.T @ (p - target) + ridge * weights
        curve = (design.T * np.maximum(p * (1 - p), 1e-6)) @ design + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-7:
            break
    return weights[:-1], float(weights[-1])
