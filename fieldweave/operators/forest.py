"""Random forests whose trees are grown, kept and walked in tasks, never in the driver.

Spark ML grows every tree level by level from the driver, which holds all nodes. Here rows are cut into bins once and sent to a fixed number of tasks; each grows its own trees whole, and
the trees are written to the shared folder as rows of packed arrays. Scoring deals trees to tasks and streams the rows past them. The driver holds cut points, depths and importances.

Cut points, bins, bagging, feature subsets, Gini gain, leaf votes and importances are those of ``RandomForestClassifier``; labels are 0 and 1.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, settled

#: Bytes of bins in a packed block, cells of the histograms that are held at once, bins that are counted at once, rows that are scored at once, and bytes of trees that a scoring task holds.
BLOCK_BYTES, CELLS, COUNTED, PIECE, TREE_BYTES = 4096, 500_000, 800_000, 20_000, 1 << 25
#: Votes are rounded to this step, so that their sums do not depend on the order of adding.
VOTE = 2.0 ** 40

TREE = "tree int, depth int, nodes int, bytes long, feature binary, bin binary, child binary, vote binary, gain binary"


def cut_points(sample: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds of each column: middles between all different values, or between those next to even shares of the rows when there are more than ``bins``."""
    return [_cuts(np.sort(column), bins) for column in sample.T]


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    different, counts = np.unique(values, return_counts=True)
    if len(different) <= bins:
        return (different[:-1] + different[1:]) / 2.0
    stride, out = len(values) / bins, []
    reached, target = int(counts[0]), stride
    for i in range(1, len(different)):
        before, reached = reached, reached + int(counts[i])
        if abs(before - target) < abs(reached - target):
            out.append((different[i - 1] + different[i]) / 2.0)
            target += stride
    return np.array(out)


def bin_kind(cuts: Sequence[np.ndarray]) -> type:
    return np.uint8 if max((len(c) for c in cuts), default=0) < 256 else np.uint16


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many thresholds lie below it."""
    out = np.empty(values.shape, bin_kind(cuts))
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, values[:, j], "left")
    return out


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), width)


def _packed(values: np.ndarray, rows: int) -> pa.Array:
    """Runs of ``rows`` rows as binary values."""
    flat = np.ascontiguousarray(values).reshape(len(values), -1)
    size = flat.shape[1] * flat.itemsize
    ends = np.minimum(np.arange(-(-len(flat) // rows) + 1) * rows, len(flat)) * size
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.tobytes())])


def _unpacked(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def packed_blocks(cuts: Sequence[np.ndarray], labelled: bool):
    """Batches of (v, and row or y, w) to blocks of a few kilobytes, numbered by task and place."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = 0, max(1, BLOCK_BYTES // max(1, len(cuts)))
        for batch in batches:
            if not len(batch):
                continue
            columns = {"bins": _packed(binned(_matrix(batch["v"], len(cuts)), cuts), rows)}
            if labelled:
                y, w = batch["y"].to_numpy(zero_copy_only=False), batch["w"].to_numpy(zero_copy_only=False)
                if not np.isin(y, (0, 1)).all() or not (w >= 0).all():
                    raise ValueError("labels must be 0 or 1, weights not negative")
                columns |= {"y": _packed(y.astype(np.uint8), rows), "w": _packed(w.astype(float), rows)}
            else:
                columns["row"] = _packed(batch["row"].to_numpy(zero_copy_only=False).astype(np.int64), rows)
            n = len(columns["bins"])
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(n, part, np.int32)), "place": pa.array(np.arange(place, place + n)), **columns})
            place += n

    return pack


@dataclass
class Shape:
    """How trees grow."""

    trees: int
    depth: int
    tried: int
    bins: int
    seed: int
    bagged: bool
    rate: float
    least_rows: int
    least_gain: float


def _counted(bins, rows, node, feats, weights, cells, n_bins):
    """Sums of each of ``weights`` by (node, tried feature, bin)."""
    tried = feats.shape[1]
    out = [np.zeros(cells) for _ in weights]
    step = max(1, COUNTED // tried)
    for i in range(0, len(rows), step):
        at, of = rows[i:i + step], node[i:i + step]
        key = (of[:, None] * tried + np.arange(tried)[None, :]) * n_bins + bins[at[:, None], feats[of]]
        key = key.ravel()
        for total, w in zip(out, weights):
            total += np.bincount(key, None if w is None else np.repeat(w[i:i + step], tried), cells)
    return out


def _split(bins, rows, node, n_nodes, w, y, shape, rng):
    """Best (gain, feature, bin, left weight, left positives, right weight, right positives) of each node."""
    width, b = bins.shape[1], shape.bins
    feats = np.argpartition(rng.random((n_nodes, width)), shape.tried - 1, axis=1)[:, :shape.tried] if shape.tried < width else np.tile(np.arange(width), (n_nodes, 1))
    cells = n_nodes * shape.tried * b
    told = [w, w * y] + ([None] if shape.least_rows > 1 else [])
    hist = [h.reshape(n_nodes, shape.tried, b) for h in _counted(bins, rows, node, feats, told, cells, b)]
    # Sums from both ends: a side without rows is exactly 0.
    left = [np.cumsum(h, axis=2)[:, :, :-1] for h in hist]
    right = [np.cumsum(h[:, :, ::-1], axis=2)[:, :, ::-1][:, :, 1:] for h in hist]
    least = max(1, shape.least_rows)
    valid = (left[0] > 0) & (right[0] > 0) if least == 1 else (left[2] >= least) & (right[2] >= least) & (left[0] > 0) & (right[0] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = sum((p * p + (t - p) * (t - p)) / t for t, p in ((left[0], left[1]), (right[0], right[1])))
    kept = np.where(valid, kept, -np.inf).reshape(n_nodes, -1)
    best = kept.argmax(1)
    at = np.arange(n_nodes)
    lw, lp, rw, rp = (s.reshape(n_nodes, -1)[at, best] for s in (left[0], left[1], right[0], right[1]))
    total, pos = lw + rw, lp + rp
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(np.isfinite(kept[at, best]), (kept[at, best] - (pos * pos + (total - pos) * (total - pos)) / total) / total, 0.0)
    j, cut = np.divmod(best, b - 1)
    return gain, feats[at, j], cut, lw, lp, rw, rp


def _pure(weight, positives):
    return (positives <= 1e-9 * weight) | (weight - positives <= 1e-9 * weight)


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, shape: Shape) -> dict:
    """One tree as arrays in the order of levels: an inner node has its feature, bin and left child (the right one follows it), a leaf -1 - its place among the votes."""
    rng = np.random.default_rng([shape.seed & 0xFFFFFFFF, tree])
    times = rng.poisson(shape.rate, len(y)) if shape.bagged else (rng.random(len(y)) < shape.rate if shape.rate < 1 else np.ones(len(y), np.int8))
    wt = times * w
    rows = np.flatnonzero(wt > 0).astype(np.int32)
    wt, truth = wt[rows], y[rows].astype(float)
    total, pos = wt.sum(), (wt * truth).sum()
    gains = np.zeros(bins.shape[1])
    feature, cut, child, votes = [], [], [], []
    node, weights, positives = np.zeros(len(rows), np.int64), np.array([total]), np.array([pos])
    open_ = np.array([len(rows) > 0 and not _pure(total, pos)])
    depth, known, n_leaves = 0, 1, 0
    while True:
        # The nodes of this level; rows lie in the order of its open nodes.
        size = len(weights)
        f, c, k = np.full(size, -1, np.int16 if bins.shape[1] < 1 << 15 else np.int32), np.zeros(size, np.uint16), np.zeros(size, np.int32)
        inner = np.flatnonzero(open_) if depth < shape.depth else np.zeros(0, np.int64)
        found = []
        starts = np.searchsorted(node, np.arange(len(inner) + 1))
        step = max(1, CELLS // (shape.tried * shape.bins))
        for i in range(0, len(inner), step):
            j = min(i + step, len(inner))
            part = slice(starts[i], starts[j])
            found.append(_split(bins, rows[part], node[part] - i, j - i, wt[part], truth[part], shape, rng))
        if found:
            gain, feat, at, lw, lp, rw, rp = (np.concatenate(x) for x in zip(*found))
            good = (gain > 1e-12) & (gain >= shape.least_gain)
            which = inner[good]
            f[which], c[which], k[which] = feat[good], at[good], known + 2 * np.arange(len(which))
            np.add.at(gains, feat[good], gain[good] * weights[which])
        else:
            good, which = np.zeros(0, bool), inner
        leaves = f < 0
        with np.errstate(divide="ignore", invalid="ignore"):
            votes.append(np.round(np.where(weights > 0, positives / weights, 0.0)[leaves] * VOTE) / VOTE)
        k[leaves] = -1 - (n_leaves + np.arange(leaves.sum()))
        n_leaves += int(leaves.sum())
        feature.append(f)
        cut.append(c)
        child.append(k)
        if not len(which):
            break
        depth += 1
        # Children of this level's split nodes, left and right in turn.
        weights, positives = np.stack([lw[good], rw[good]], 1).ravel(), np.stack([lp[good], rp[good]], 1).ravel()
        known += len(weights)
        open_ = ~_pure(weights, positives)
        rank = np.cumsum(good) - 1
        stay = good[node]
        rows, node, wt, truth = rows[stay], node[stay], wt[stay], truth[stay]
        to = 2 * rank[node] + (bins[rows, feat[node]] > at[node])
        stay = open_[to]
        number = np.cumsum(open_) - 1
        to, rows, wt, truth = number[to[stay]], rows[stay], wt[stay], truth[stay]
        order = np.argsort(to, kind="stable")
        node, rows, wt, truth = to[order], rows[order], wt[order], truth[order]
    share = gains / gains.sum() if gains.sum() > 0 else gains
    return {"tree": tree, "depth": depth, "feature": np.concatenate(feature), "bin": np.concatenate(cut), "child": np.concatenate(child), "vote": np.concatenate(votes), "gain": share}


def _tree_row(tree: dict) -> pa.RecordBatch:
    packed = {c: tree[c].tobytes() for c in ("feature", "bin", "child", "vote", "gain")}
    head = {"tree": pa.array([tree["tree"]], pa.int32()), "depth": pa.array([tree["depth"]], pa.int32()), "nodes": pa.array([len(tree["feature"])], pa.int32()), "bytes": pa.array([sum(map(len, packed.values()))], pa.int64())}
    return pa.RecordBatch.from_pydict(head | {c: pa.array([v], pa.binary()) for c, v in packed.items()})


def growing(shape: Shape, groups: int, width: int, kind: type):
    """Blocks of all rows, once a group of trees, to the trees of the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("group", "part", "place", "bins", "y", "w"))):
                held.setdefault(row[0], []).append(row[1:])
        while held:
            group, blocks = held.popitem()
            blocks.sort(key=lambda r: r[:2])
            columns = list(zip(*blocks))
            del blocks
            bins = np.frombuffer(b"".join(columns[2]), kind).reshape(-1, width)
            y, w = np.frombuffer(b"".join(columns[3]), np.uint8), np.frombuffer(b"".join(columns[4]), float)
            del columns
            for tree in range(group, shape.trees, groups):
                yield _tree_row(grow(bins, y, w, tree, shape))

    return run


def walked(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, vote: np.ndarray) -> np.ndarray:
    """Vote of a tree for each row."""
    out = np.zeros(len(bins))
    rows, node = np.arange(len(bins)), np.zeros(len(bins), np.int64)
    while len(rows):
        to = child[node]
        done = to < 0
        out[rows[done]] = vote[-1 - to[done]]
        rows, node, to = rows[~done], node[~done], to[~done]
        node = to + (bins[rows, feature[node]] > cut[node])
    return out


def walking(bins_kind, width: int):
    """Trees of a group, and then blocks of rows, to (row, votes of the group)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trees, whole = None, [], True
        for batch in batches:
            marks = np.stack([batch["group"].to_numpy(), batch["kind"].to_numpy()], 1)
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for a, b in zip([0, *edges], [*edges, len(marks)]):
                part, (g, kind) = batch.slice(a, b - a), marks[a]
                if g != group:
                    group, trees = g, []
                if kind == 0:
                    of = np.int16 if width < 1 << 15 else np.int32
                    trees += [(np.frombuffer(r["feature"], of), np.frombuffer(r["bin"], np.uint16), np.frombuffer(r["child"], np.int32), np.frombuffer(r["vote"], float)) for r in part.select(["feature", "bin", "child", "vote"]).to_pylist()]
                    continue
                bins, rows = _unpacked(part["bins"], bins_kind).reshape(-1, width), _unpacked(part["row"], np.int64)
                for i in range(0, len(rows), PIECE):
                    some = bins[i:i + PIECE]
                    votes = sum((walked(some, *t) for t in trees), np.zeros(len(some)))
                    yield pa.RecordBatch.from_pydict({"row": pa.array(rows[i:i + PIECE]), "votes": pa.array(votes)})

    return run


def tried_features(strategy: str, width: int, trees: int) -> int:
    """How many features a node tries."""
    if strategy == "auto":
        strategy = "sqrt" if trees > 1 else "all"
    named = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(max(2, width)))), "onethird": math.ceil(width / 3.0)}
    if strategy in named:
        return named[strategy]
    n = float(strategy)
    return min(width, int(n) if strategy.isdigit() else max(1, math.ceil(n * width)))


class Forest(RandomForestClassifier):
    """The parameters of Spark ML's forest; fitted in tasks."""

    def _fit(self, dataset: DataFrame) -> ForestModel:
        get = self.getOrDefault
        if get("impurity") != "gini" or get("minWeightFractionPerNode") > 0 or self.isSet("thresholds"):
            raise ValueError("forests grow by Gini gain, without thresholds and least shares of weight")
        spark = dataset.sparkSession
        weight = F.col(get("weightCol")).cast("double") if self.isSet("weightCol") else F.lit(1.0)
        rows = dataset.select(vector_to_array(get("featuresCol")).alias("v"), F.col(get("labelCol")).cast("double").alias("y"), weight.alias("w"))
        n = rows.count()
        if not n:
            raise ValueError("a forest needs rows")
        # Cut points come from as many rows as Spark ML takes for them; the trees see every row.
        wanted = max(get("maxBins") ** 2, 10_000)
        sample = rows.select("v") if wanted >= n else rows.select("v").sample(wanted / n, get("seed"))
        sample = sample.toArrow()
        sample = sample if len(sample) else rows.select("v").limit(1).toArrow()
        width = len(sample["v"][0])
        bins = min(get("maxBins"), max(2, n))
        cuts = cut_points(_matrix(sample["v"], width), bins)
        trees = get("numTrees")
        shape = Shape(trees, get("maxDepth"), tried_features(get("featureSubsetStrategy"), width, trees), bins, get("seed"), trees > 1 and get("bootstrap"), get("subsamplingRate"), get("minInstancesPerNode"), get("minInfoGain"))
        groups = min(trees, 2 * spark.sparkContext.defaultParallelism)
        blocks = rows.mapInArrow(packed_blocks(cuts, True), "part int, place long, bins binary, y binary, w binary")
        dealt = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionById(groups, F.col("group"))
        folder = scratch(spark, "forest")
        dealt.mapInArrow(growing(shape, groups, width, bin_kind(cuts)), TREE).write.parquet(folder)
        return ForestModel(folder, cuts, get("featuresCol"))._told()


@dataclass
class Tree:
    """What the driver knows of a tree."""

    depth: int
    numNodes: int  # noqa: N815


class ForestModel(Model, MLWritable, MLReadable):
    """Trees in a folder, and how to score rows by them."""

    def __init__(self, folder: str = "", cuts: Sequence[np.ndarray] = (), features: str = "x"):
        super().__init__()
        self.folder, self.cuts, self.features = folder, list(cuts), features

    def _told(self) -> ForestModel:
        told = SparkSession.active().read.schema(TREE).parquet(self.folder).select("tree", "depth", "nodes", "bytes", "gain").toArrow().sort_by("tree").to_pylist()
        self.trees = [Tree(r["depth"], r["nodes"]) for r in told]
        self.bytes = sum(r["bytes"] for r in told)
        total = np.sum([np.frombuffer(r["gain"], float) for r in told], axis=0)
        self.featureImportances = DenseVector(total / total.sum() if total.sum() > 0 else total)
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        # Rows meet their votes by number, so they are written with it.
        rows = settled(dataset.withColumn("__row", F.monotonically_increasing_id()))
        width, kind = len(self.cuts), bin_kind(self.cuts)
        groups = min(len(self.trees), max(spark.sparkContext.defaultParallelism, -(-self.bytes // TREE_BYTES)))
        trees = spark.read.schema(TREE).parquet(self.folder).select((F.col("tree") % groups).cast("int").alias("group"), F.lit(0).alias("kind"), "feature", "bin", "child", "vote", F.lit(None).cast("binary").alias("bins"), F.lit(None).cast("binary").alias("row"))
        blocks = rows.select(vector_to_array(self.features).alias("v"), F.col("__row").alias("row")).mapInArrow(packed_blocks(self.cuts, False), "part int, place long, bins binary, row binary")
        none = [F.lit(None).cast("binary").alias(c) for c in ("feature", "bin", "child", "vote")]
        blocks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), *none, "bins", "row")
        dealt = trees.unionByName(blocks).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "kind")
        votes = dealt.mapInArrow(walking(kind, width), "row long, votes double").groupBy(F.col("row").alias("__row")).agg(F.sum("votes").alias("__votes"))
        share = F.col("__votes") / F.lit(float(len(self.trees)))
        out = rows.join(votes, "__row").drop("__row")
        two = lambda a, b: array_to_vector(F.array(a, b))
        return out.withColumns({
            "rawPrediction": two(F.lit(float(len(self.trees))) - F.col("__votes"), F.col("__votes")), "probability": two(1.0 - share, share), "prediction": (share > 0.5).cast("double")}).drop("__votes")

    def copy(self, extra=None) -> ForestModel:
        return self

    def write(self) -> MLWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return ForestReader()


class ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"cuts": json.dumps([c.tolist() for c in m.cuts]), "features": m.features})
        self.sparkSession.read.schema(TREE).parquet(m.folder).write.parquet(f"{path.rstrip('/')}/trees")


class ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(f"{path.rstrip('/')}/trees", [np.array(c, float) for c in json.loads(told["cuts"])], told["features"])
        return model._resetUid(told["uid"])._told()
