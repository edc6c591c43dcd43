"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and adds a shallow tree over its bins to that feature's lookup table, then
does the same for the pairs of features that explain most of what is left. A score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RollingHash, byte_codes, byte_column, slices
from .learning import labelled_sample, sigmoid

FEATURES = [
    "log_bytes", "upper", "exclamation", "pipe", "symbol", "digit", "point", "other_punctuation", "space", "line_end", "non_ascii", "word_length",
    "repeats_previous", "repeats_second", "distinct_words", "symbol_ended", "upper_words", "one_byte_words", "line_words", "distinct_lines"]
#: Bytes of each counted class, fixed values.
CLASSES = {
    "exclamation": b"!", "pipe": b"|", "symbol": b"#$%&*@^~=<>{}[]\\/_+", "digit": b"0123456789", "point": b".", "other_punctuation": b",;:?'\"()-",
    "space": b" \t\r\x0b\x0c", "line_end": b"\n"}


def text_features(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offsets).astype(float)
    if not len(body):
        return out
    column = {name: k for k, name in enumerate(FEATURES)}
    at_least_one = np.maximum(size, 1)

    def share(flags: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(of, 1)

    out[:, column["log_bytes"]] = np.log1p(size)
    for name, members in CLASSES.items():
        flag = np.zeros(256, bool)
        flag[list(members)] = True
        out[:, column[name]] = share(flag[body], offsets, at_least_one)
    high = body >= 128
    lead = body == 0xC3
    after_lead = np.r_[False, lead[:-1]]
    upper = ((body >= 65) & (body <= 90)) | (after_lead & (body >= 0x80) & (body <= 0x9E))
    letters = upper | ((body >= 97) & (body <= 122)) | (after_lead & (body > 0x9E))
    out[:, column["upper"]] = share(upper, offsets, share(letters, offsets, np.ones(n)))
    out[:, column["non_ascii"]] = share(high, offsets, at_least_one)

    gap = np.zeros(256, bool)
    gap[list(b" \t\r\n\x0b\x0c")] = True
    inside = ~gap[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    words = np.searchsorted(starts, offsets)
    n_words = np.diff(words)
    rolling = RollingHash(byte_codes()[body])
    hashes = rolling.ranges(starts, ends)
    first = np.zeros(len(starts) + 1, bool)
    first[words] = True
    out[:, column["word_length"]] = share(inside, offsets, n_words)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & ~first[1:-1]
    out[:, column["repeats_previous"]] = share(same, words, n_words)
    text_of_word = np.repeat(np.arange(n), n_words)
    second = np.zeros(len(starts), bool)
    second[2:] = (hashes[2:] == hashes[:-2]) & (text_of_word[2:] == text_of_word[:-2])
    out[:, column["repeats_second"]] = share(second, words, n_words)
    order = np.lexsort((hashes, text_of_word))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text_of_word[order][1:] != text_of_word[order][:-1])
    out[:, column["distinct_words"]] = share(new, words, n_words)
    symbol = np.zeros(256, bool)
    symbol[list(CLASSES["symbol"] + b"!")] = True
    out[:, column["symbol_ended"]] = share(symbol[body[ends - 1]], words, n_words)
    ups = np.r_[0, np.cumsum(upper)]
    lets = np.r_[0, np.cumsum(letters)]
    out[:, column["upper_words"]] = share((ups[ends] - ups[starts] == lets[ends] - lets[starts]) & (lets[ends] > lets[starts] + 1), words, n_words)
    out[:, column["one_byte_words"]] = share(ends - starts == 1, words, n_words)

    cut = edge[:-1].copy()
    cut[1:] |= body[:-1] == 10
    line_starts = np.flatnonzero(cut)
    line_ends = np.r_[line_starts[1:], len(body)]
    lines = np.searchsorted(line_starts, offsets)
    n_lines = np.diff(lines)
    out[:, column["line_words"]] = n_words / np.maximum(n_lines, 1)
    line_hashes = rolling.ranges(line_starts, line_ends)
    text_of_line = np.repeat(np.arange(n), n_lines)
    order = np.lexsort((line_hashes, text_of_line))
    new = np.ones(len(order), bool)
    new[1:] = (line_hashes[order][1:] != line_hashes[order][:-1]) | (text_of_line[order][1:] != text_of_line[order][:-1])
    out[:, column["distinct_lines"]] = share(new, lines, n_lines)
    out[size == 0] = 0
    return out


@dataclass
class AdditiveModel:
    """Lookup tables: one per feature over its bins, one per pair of features over coarser bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.pair_edges)]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[a], coarse[b]]
        return sigmoid(total)


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]


def best_cut(slope: np.ndarray, curve: np.ndarray, ridge: float) -> tuple[float, int]:
    """(gain, bins left of the cut) of the best split of a run of bins."""
    if len(slope) < 2:
        return 0.0, 0
    g, h = np.cumsum(slope)[:-1], np.cumsum(curve)[:-1]
    whole, weight = slope.sum(), curve.sum()
    gain = g ** 2 / (h + ridge) + (whole - g) ** 2 / (weight - h + ridge) - whole ** 2 / (weight + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def shallow_tree(slope: np.ndarray, curve: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A step for each bin: the best cuts of the bins into at most ``leaves`` runs."""
    runs = [(0, len(slope))]
    while len(runs) < leaves:
        cuts = [(*best_cut(slope[a:b], curve[a:b], ridge), a, b) for a, b in runs]
        gain, at, a, b = max(cuts)
        if gain <= 1e-9:
            break
        runs.remove((a, b))
        runs += [(a, a + at), (a + at, b)]
    step = np.zeros(len(slope))
    for a, b in runs:
        step[a:b] = -slope[a:b].sum() / (curve[a:b].sum() + ridge)
    return step


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 120, rate: float = 0.1, leaves: int = 3, n_pairs: int = 8, pair_bins: int = 12, ridge: float = 5.0) -> AdditiveModel:
    """Cyclic boosting on logistic loss. No rows, or one class only: every score is the (smoothed) share of label 1."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = AdditiveModel(float(np.log(share / (1 - share))), [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    if len(np.unique(y)) < 2:
        return model
    model.edges = bin_edges(x, bins)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for k, bin_of in enumerate(binned):
            p, width = sigmoid(total), len(model.tables[k])
            step = rate * shallow_tree(np.bincount(bin_of, p - y, width), np.bincount(bin_of, p * (1 - p), width), leaves, ridge)
            model.tables[k] += step
            total += step[bin_of]
    model.pair_edges = bin_edges(x, pair_bins)
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def cells(a: int, b: int, weights: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], weights, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    def quadrants(a: int, b: int, slope: np.ndarray, curve: np.ndarray) -> tuple[float, int, int]:
        """The cut of both axes that explains most."""
        g, h = (np.pad(w.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for w in (cells(a, b, slope), cells(a, b, curve)))
        gain = np.zeros(g.shape)
        for w, v in ((g, h), (g[:, -1:] - g, h[:, -1:] - h), (g[-1:] - g, h[-1:] - h), (g[-1:, -1:] - g[-1:] - g[:, -1:] + g, h[-1:, -1:] - h[-1:] - h[:, -1:] + h)):
            gain += w ** 2 / (v + ridge)
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        return float(gain[i, j]), int(i), int(j)

    p = sigmoid(total)
    ranked = sorted(((quadrants(a, b, p - y, p * (1 - p))[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for _, a, b in ranked[:n_pairs]]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(rounds // 3):
        for k, (a, b) in enumerate(model.pairs):
            p = sigmoid(total)
            _, i, j = quadrants(a, b, p - y, p * (1 - p))
            g, h = cells(a, b, p - y), cells(a, b, p * (1 - p))
            step = np.zeros(g.shape)
            for rows in (slice(0, i), slice(i, None)):
                for cols in (slice(0, j), slice(j, None)):
                    step[rows, cols] = -rate * g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


#: Bytes of text whose features are counted at once: some thirty numbers of eight bytes for each of them are held meanwhile.
FEATURE_BYTES = 1 << 18


def feature_rows(batch: pa.RecordBatch, text: str) -> np.ndarray:
    body, offsets = byte_column(batch.column(batch.schema.get_field_index(text)))
    parts = [text_features(body[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in slices(offsets, FEATURE_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", rows: int = 20_000) -> AdditiveModel:
    """A model from at most ``rows`` labelled documents; only their features reach the driver (``rows`` x 20 numbers)."""
    sample = labelled_sample(docs, labels, label, allowed, rows).select("doc_id", "label", "body")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array(list(feature_rows(batch, "body")), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = sample.mapInArrow(features, "doc_id string, label int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(got.x.tolist()).reshape(len(got), len(FEATURES))
    return fit_additive(x, (got.label.to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is good. Null text counts as empty and gets a score too; a column named ``output`` is replaced."""
    plain = docs.drop(output)
    schema = T.StructType([*plain.schema, T.StructField(output, T.DoubleType())])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(output, pa.array(model.score(feature_rows(batch, text))))

    return plain.mapInArrow(add, schema)


def keep_good(docs: DataFrame, model: AdditiveModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose text scores at least ``least``, in the columns of ``docs``. They are picked where they are scored, so a text is sent once and only if kept sent back."""

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(feature_rows(batch, text)) >= least))

    return docs.mapInArrow(pick, docs.schema)
