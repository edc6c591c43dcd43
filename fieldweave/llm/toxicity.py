"""Toxicity by weak supervision.

Voters are words and word beginnings that speak for the label. A generative label model, fitted by expectation maximisation,
estimates how often each voter fires in either class and how strongly voters repeat each other; its posterior labels train a linear
classifier over the same votes, which scores every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RollingHash, byte_codes, byte_column, slices
from .learning import fit_logistic, labelled_sample, sample_of, sigmoid

#: Bytes of the word beginnings that are pattern voters.
PREFIXES = (3, 4, 5, 6, 7, 8, 9, 10)
WHOLE = np.uint64(0x5851F42D4C957F2D)


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """(lower case of ASCII letters, whether a byte belongs to a word: ASCII letters and everything beyond ASCII)."""
    lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)
    part = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
    return lower, part


def votes_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start, end) of every word and word beginning."""
    lower, part = letters()
    raw = lower[body]
    inside = part[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    rolling = RollingHash(byte_codes()[raw])
    found = [(rolling.ranges(starts, ends) ^ WHOLE, starts, ends)]
    for size in PREFIXES:
        longer = ends - starts > size
        found.append((rolling.ranges(starts[longer], starts[longer] + size), starts[longer], starts[longer] + size))
    hashes, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, np.searchsorted(offsets, low, "right") - 1, low, high


@dataclass
class VoterModel:
    """Voters (sorted hashes and what they look for), their accuracies and the linear classifier over their votes."""

    hashes: np.ndarray
    patterns: list[str]
    fires: np.ndarray
    share: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, votes: np.ndarray) -> np.ndarray:
        return sigmoid(votes @ self.weights + self.intercept)


def vote_matrix(batch: pa.RecordBatch, text: str, voters: np.ndarray) -> np.ndarray:
    """Which voters fire in which rows."""
    body, offsets = byte_column(batch.column(batch.schema.get_field_index(text)))
    votes = np.zeros((len(batch), len(voters)), bool)
    if not len(voters):
        return votes
    some = np.zeros(1 << 16, bool)
    some[voters >> np.uint64(48)] = True
    for low, high in slices(offsets):
        hashes, row, _, _ = votes_of(body[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        near = np.flatnonzero(some[hashes >> np.uint64(48)])
        hashes, row = hashes[near], row[near]
        at = np.minimum(np.searchsorted(voters, hashes), len(voters) - 1)
        hit = voters[at] == hashes
        votes[row[hit] + low, at[hit]] = True
    return votes


def find_voters(sample: DataFrame, voters: int, least: int) -> tuple[np.ndarray, list[bytes]]:
    """The patterns that speak most for label 1: at least ``least`` documents with it, ordered by smoothed share of label 1."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = byte_column(batch.column("body"))
            label = batch.column("label").to_numpy() > 0
            for low, high in slices(offsets):
                own = body[offsets[low]:offsets[high]]
                hashes, row, start, end = votes_of(own, offsets[low:high + 1] - offsets[low])
                order = np.lexsort((row, hashes))
                hashes, row, start, end = hashes[order], row[order], start[order], end[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
                hashes, row, start, end = hashes[new], row[new], start[new], end[new]
                unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                positive = np.bincount(which, label[row + low], len(unique)).astype(np.int64)
                total = np.bincount(which, minlength=len(unique))
                examples = pa.array([own[a:b].tobytes().lower() if p else b"" for a, b, p in zip(start[first], end[first], positive, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(positive), pa.array(total), examples], ["h", "positive", "total", "example"])

    counted = (
        sample.select("body", "label").mapInArrow(count, "h long, positive long, total long, example binary")
        .groupBy("h").agg(F.sum("positive").alias("positive"), F.sum("total").alias("total"), F.max("example").alias("example")))
    speak = F.col("positive") / (F.col("total") + 5)
    best = counted.where((F.col("positive") >= least) & (speak > 0.5)).orderBy(speak.desc(), F.desc("positive"), "h").limit(voters).collect()
    hashes = np.array([r.h for r in best], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], [bytes(best[k].example) for k in order]


def families(hashes: np.ndarray, patterns: list[bytes]) -> np.ndarray:
    """Which voters may repeat each other: word beginnings of one word. A whole word is a family of its own, so it keeps its evidence."""
    def whole(voter: np.uint64, pattern: bytes) -> bool:
        found = votes_of(np.frombuffer(pattern, np.uint8), np.array([0, len(pattern)]))[0]
        return len(found) > 0 and found[0] == voter

    words = [whole(h, p) for h, p in zip(hashes, patterns, strict=True)]
    same = [[not (words[i] or words[j]) and (a.startswith(b) or b.startswith(a)) for j, b in enumerate(patterns)] for i, a in enumerate(patterns)]
    return np.array(same, bool).reshape(len(patterns), len(patterns)) | np.eye(len(patterns), dtype=bool)


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 120, human: float = 0.98, family: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, firing rates by class, share of its own evidence that each voter keeps).

    The given labels (-1: none) are one more voter of accuracy ``human``. Voters that fire together within a class repeat each other, so
    each one's log likelihood ratio is divided by the sum of its positive correlations, itself included, with the voters of its
    ``family`` (one row of bits a voter; without it, all voters).
    """
    known = label >= 0
    prior = (label[known].sum() + 1.0) / (known.sum() + 2.0)
    voice = np.where(known, np.where(label > 0, 1, -1) * np.log(human / (1 - human)), 0.0)
    posterior = sigmoid(np.where(known, voice, np.log(prior / (1 - prior))))
    share = np.ones(votes.shape[1])
    v = votes.astype(np.float32)
    for turn in range(rounds):
        rates = np.stack([((w @ v) + 0.5 * prior) / (w.sum() + 1.0) for w in (1 - posterior, posterior)])
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        if turn % 10 == 0:
            share = 1.0 / repetition(v, posterior, rates, family)
        on, off = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        evidence = v @ ((on - off) * share) + (off * share).sum()
        after = sigmoid(evidence + voice + np.log(prior / (1 - prior)))
        done = np.abs(after - posterior).max() < 1e-5
        posterior = after
        if done:
            break
    return posterior, rates, share


def repetition(v: np.ndarray, posterior: np.ndarray, rates: np.ndarray, family: np.ndarray | None = None) -> np.ndarray:
    """For each voter, the sum of its correlations with the voters of its family in class 1, where they are at least 0.2."""
    weight = posterior / max(posterior.sum(), 1e-9)
    centred = (v - rates[1]) * np.sqrt(weight)[:, None]
    cov = centred.T @ centred
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    correlation = cov / scale[:, None] / scale
    np.fill_diagonal(correlation, 1.0)
    return np.where((correlation >= 0.2) & (True if family is None else family), correlation, 0.0).sum(0)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", rows: int = 20_000, unlabelled: int = 5_000, voters: int = 384, least: int = 5) -> VoterModel:
    """A model from at most ``rows`` labelled and ``unlabelled`` other documents; the driver gets their votes (bits) only.

    Both are the rows with the least hash of the id; a labelled row may be among the unlabelled ones, then without its label.
    No labelled rows or no voters: every score is the smoothed share of label 1.
    """
    sample = labelled_sample(docs, labels, label, allowed, rows)
    hashes, patterns = find_voters(sample, voters, least)
    more = sample_of(docs, unlabelled).select(F.lit(-1).alias("label"), "body")

    def votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.packbits(vote_matrix(batch, "body", hashes), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([row.tobytes() for row in bits], pa.binary())], ["label", "bits"])

    got = sample.select("label", "body").unionByName(more).mapInArrow(votes, "label int, bits binary").orderBy("label", "bits").toPandas()
    target = got.label.to_numpy(np.int64)
    width = -(-len(hashes) // 8)
    matrix = np.frombuffer(b"".join(bytes(b) for b in got.bits), np.uint8).reshape(len(got), width)
    matrix = np.unpackbits(matrix, axis=1)[:, :len(hashes)].astype(bool) if width else np.zeros((len(got), 0), bool)
    known = target[target >= 0]
    prior = (known.sum() + 1.0) / (len(known) + 2.0)
    if not len(hashes):
        return VoterModel(hashes, [], np.zeros((2, 0)), np.zeros(0), np.zeros(0), float(np.log(prior / (1 - prior))))
    posterior, rates, share = label_model(matrix, target, family=families(hashes, patterns))
    weights, intercept = fit_logistic(matrix, posterior, penalty=0.3)
    return VoterModel(hashes, [p.decode("utf-8", "replace") for p in patterns], rates, share, weights, intercept)


def score(docs: DataFrame, model: VoterModel, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1. Null text counts as empty and gets a score too; a column named ``output`` is replaced."""
    plain = docs.drop(output)
    schema = T.StructType([*plain.schema, T.StructField(output, T.DoubleType())])
    hashes, weights, intercept = model.hashes, model.weights, model.intercept

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(output, pa.array(sigmoid(vote_matrix(batch, text, hashes) @ weights + intercept)))

    return plain.mapInArrow(add, schema)
