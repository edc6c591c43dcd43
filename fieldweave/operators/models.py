"""Training and scoring of table models on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, settled
from . import evaluation as E
from .balance import oversample
from .forest import Forest
from .sampling import downsample_zero, group_splits

BUILDERS = {
    "random_forest": Forest,
    "gradient_boosting": GBTClassifier,
    "decision_tree": DecisionTreeClassifier,
    "logistic_regression": LogisticRegression,
}
# Defaults of the published models, fixed values. Their forests and trees grow without limit; 30 is the deepest Spark grows.
DEFAULTS = {
    "random_forest": {"numTrees": 100, "maxDepth": 30, "featureSubsetStrategy": "sqrt"},
    "gradient_boosting": {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1},
    "decision_tree": {"maxDepth": 30},
    "logistic_regression": {},
}
EXPERIMENT_TREES = 200
#: Models that train at once (levels of boosting and of small forests are short jobs that leave cores idle), and parts of a training table, at least: small tables come as one part, which is one task a level.
AT_ONCE, PARTS = 3, 12
# The comparison set, fixed values: three forests, boosting, one tree, one linear model.
COMPARISON = {
    "forest_full": ("random_forest", {"numTrees": 400, "maxDepth": 30, "featureSubsetStrategy": "sqrt"}),
    "forest_small": ("random_forest", {"numTrees": 50, "maxDepth": 8, "featureSubsetStrategy": "sqrt"}),
    "forest_tiny": ("random_forest", {"numTrees": 15, "maxDepth": 6, "featureSubsetStrategy": "sqrt"}),
    "boosting": ("gradient_boosting", {"maxIter": 200, "maxDepth": 3}),
    "tree": ("decision_tree", {"maxDepth": 6}),
    "linear": ("logistic_regression", {"maxIter": 2000}),
}


def build(kind: str, params: Mapping | None = None, target: str = "y", weight: str | None = "w", seed: int = 42) -> Estimator:
    """A model by name with the published defaults; parameters it does not have are left out."""
    if kind not in BUILDERS:
        raise ValueError(f"unknown model {kind!r}")
    est = BUILDERS[kind](featuresCol="x", labelCol=target)
    # Cached node ids change no split: rows keep their node, so the grown trees are not sent to every task at every level and not walked again.
    extra = {"seed": seed, "cacheNodeIds": True, **({"weightCol": weight} if weight else {})}
    known = {k: v for k, v in {**extra, **DEFAULTS[kind], **(params or {})}.items() if est.hasParam(k)}
    return est.setParams(**known)


def with_vector(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """Feature vector ``x`` from an array column or from number columns; missing counts as 0."""
    arr = F.transform(columns, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))) if isinstance(columns, str) else F.array(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return df.withColumn("x", array_to_vector(arr))


def balanced_weights(df: DataFrame, target: str = "y", extra: str | None = None) -> DataFrame:
    """Weight n / (2 n_class), times an optional row weight."""
    c = df.agg(F.struct(F.count("*").alias("n"), F.count_if(F.col(target) == 1).alias("p"))).scalar()
    df = df.withColumn("__c", c)
    own = F.when(F.col(target) == 1, F.col("__c.p")).otherwise(F.col("__c.n") - F.col("__c.p"))
    w = F.col("__c.n") / (2.0 * own)
    return df.withColumn("w", w * F.col(extra) if extra else w).drop("__c")


def fit(train: DataFrame, kind: str = "random_forest", params: Mapping | None = None, target: str = "y", scale: bool = False,
        balanced: bool = True, extra_weight: str | None = None, seed: int = 42) -> PipelineModel:
    """Weights, optional scaling, model. ``train`` has the vector ``x`` and the target.

    The scaler divides by the sample deviation; with many rows the difference to
    the population one is nil.
    """
    # Weights, samples of the splits and the bagged rows each read the table, so it is made once.
    parts = max(PARTS, train.sparkSession.sparkContext.defaultParallelism)
    train = settled(train.select("x", target, *([extra_weight] if extra_weight else [])).repartition(parts))
    data = balanced_weights(train, target, extra_weight) if balanced else train.withColumn("w", F.col(extra_weight) if extra_weight else F.lit(1.0))
    est = build(kind, params, target, "w", seed)
    stages: list = []
    if scale:
        stages.append(StandardScaler(inputCol="x", outputCol="xs", withMean=True, withStd=True))
        est = est.setParams(featuresCol="xs")
    return Pipeline(stages=[*stages, est]).fit(data.select("x", target, "w"))


def each(rows: DataFrame, make: Callable, items: Iterable) -> list:
    """``make`` of each item, in order, ``AT_ONCE`` at a time: models that do not wait for each other."""
    ensure_checkpoint_dir(rows.sparkSession)
    with ThreadPool(AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(make), list(items), chunksize=1)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Probability of class 1 as ``p``."""
    out = model.transform(df)
    drop = [c for c in ("rawPrediction", "probability", "prediction", "xs") if c in out.columns]
    return out.withColumn("p", vector_to_array("probability")[1]).drop(*drop)


def standardised(train: DataFrame, other: DataFrame) -> DataFrame:
    """``other`` scaled by the mean and deviation of ``train`` (vector ``x`` to array ``xs``)."""
    m = StandardScaler(inputCol="x", outputCol="xs", withMean=True, withStd=True).fit(train)
    return m.transform(other).withColumn("xs", vector_to_array("xs")).drop("x")


def compare_models(train: DataFrame, test: DataFrame, models: Mapping | None = None) -> DataFrame:
    """Threshold metrics, average precision and ROC AUC of several models on one test set."""
    train, test = settled(train), settled(test)

    def row(item):
        name, (kind, params) = item
        scored = settled(score(fit(train, kind, params, scale=kind == "logistic_regression", balanced=kind != "gradient_boosting"), test).select("y", "p"))
        return E.metrics_at(scored, "y", "p").select(F.lit(name).alias("model"), "*")

    return reduce(DataFrame.unionByName, each(train, row, (models or COMPARISON).items()))


def train_fold(train: DataFrame, val: DataFrame, kind: str = "random_forest", params: Mapping | None = None, ratio: float = 3.0,
               smote: bool = True, key: str = "id", vector: str = "v", seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """Down-sample, over-sample (unless told not to), scale, fit, score, pick the best threshold, measure.

    Returns the model and one row of metrics. Sampling, neighbours, scaling and every level of the trees read the rows again, so both tables are settled first.
    """
    train, val = settled(train), settled(val)
    bal = downsample_zero(train, "y", [key], ratio, seed)
    if smote:
        bal = oversample(bal, "y", key, vector, seed=seed)
    model = fit(with_vector(settled(bal), vector), kind, params, scale=True, seed=seed)
    scored = settled(score(model, with_vector(val, vector)).select("y", "p"))
    return model, fold_metrics(scored)


def fold_metrics(scored: DataFrame, truth: str = "y", proba: str = "p") -> DataFrame:
    """Best-F1 threshold (strict >) and every metric of one scored fold."""
    return E.best_split_metrics(E.score_curve(scored, truth, proba)).withColumnRenamed("positive_ratio", "irrigation_ratio")


def cross_validate(rows: DataFrame, folds: Sequence[int], **options) -> DataFrame:
    """One row of metrics per fold; ``rows`` has ``fold``. Every fold reads the table, so it is settled first."""
    rows = settled(rows)

    def row(f):
        _, m = train_fold(rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f), **options)
        return m.select(F.lit(f).alias("fold"), "*")

    return reduce(DataFrame.unionByName, each(rows, row, folds))


def experiment(rows: DataFrame, config: Mapping) -> DataFrame:
    """Summary of a cross-validated experiment described by a config.

    ``model`` = {type, params}, ``sampling`` = {target_ratio, use_smote}, ``seed``, ``metrics``; all but ``folds`` have defaults. Unknown
    parameters of the model are left out.
    """
    model, sampling = config.get("model", {}), config.get("sampling", {})
    folds = cross_validate(
        rows, config["folds"], kind=model.get("type", "random_forest"), params=model.get("params"), ratio=sampling.get("target_ratio", 3.0),
        smote=sampling.get("use_smote", True), seed=config.get("seed", 42))
    return E.fold_summary(folds, config.get("metrics", ["accuracy", "precision", "recall", "f1_score", "average_precision", "roc_auc"]))


#: Shares of the training rows of a learning curve: six even steps from a tenth to all, fixed values.
SHARES = (0.1, 0.28, 0.46, 0.64, 0.82, 1.0)


def learning_curve(rows: DataFrame, shares: Sequence[float], folds: Sequence[int], key: str = "id", kind: str = "random_forest",
                   params: Mapping | None = None, vector: str = "v", seed: int = 42) -> DataFrame:
    """Train and validation F1 by share of the training rows; shares are nested by hash."""
    from ..functions.keys import hash_uniform

    data = settled(with_vector(rows, vector).withColumn("__u", hash_uniform(seed, key)))

    def point(item):
        s, f = item
        seen = (F.col("fold") != f) & (F.col("__u") < s)
        told = data.withColumn("part", F.when(seen, "train").when(F.col("fold") == f, "validation")).filter("part IS NOT NULL")
        guessed = score(fit(told.filter("part = 'train'"), kind, params), told.select("x", "y", "part")).withColumn("__g", (F.col("p") >= 0.5).cast("int"))
        return settled(E.binary_metrics(guessed, "y", "__g", ["part"]).select(F.lit(s).alias("share"), F.lit(f).alias("fold"), "part", "f1_score"))

    t = reduce(DataFrame.unionByName, each(data, point, [(s, f) for s in shares for f in folds]))
    return t.groupBy("share", "part").agg(F.avg("f1_score").alias("mean"), F.stddev_pop("f1_score").alias("std"))


#: Levels of the robustness sweeps, fixed values: share of steps dropped, deviation of the noise.
DROPS, NOISES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6), (0.0, 0.02, 0.05, 0.08, 0.12, 0.16, 0.2)


def robustness(models: Mapping[str, PipelineModel], test: DataFrame, key: str = "id", vector: str = "v", drops: Sequence[float] = DROPS,
               noises: Sequence[float] = NOISES, seed: int = 42) -> DataFrame:
    """(model, sweep, level, metrics) of trained models on degraded test series.

    ``vector`` is the raw series: its own gaps and the dropped steps are filled together. Every series is degraded to every level in one pass.
    """
    from ..functions.series import degrade

    levels = [("drop", float(d), float(d), 0.0) for d in drops] + [("noise", float(n), 0.0, float(n)) for n in noises]
    level = F.explode(F.array(*[F.struct(F.lit(s).alias("sweep"), F.lit(x).alias("level"), F.lit(d).alias("drop"), F.lit(n).alias("noise")) for s, x, d, n in levels]))
    levelled = test.withColumn("__l", level).select("*", "__l.*").drop("__l")
    bad = settled(with_vector(levelled.withColumn(vector, degrade(vector, [key], F.col("drop"), F.col("noise"), seed)), vector))

    def row(item):
        name, m = item
        return E.metrics_at(settled(score(m, bad).select("sweep", "level", "y", "p")), "y", "p", keys=["sweep", "level"]).select(F.lit(name).alias("model"), "*")

    return reduce(DataFrame.unionByName, each(test, row, models.items()))


def leave_group_out(rows: DataFrame, group: str, groups: Sequence[str] | None = None, kind: str = "random_forest", params: Mapping | None = None) -> DataFrame:
    """Train on all other groups, test on one; without ``groups``, those that ``sampling.group_splits`` finds large enough (a group is a model, so they are few)."""
    rows = settled(rows)
    if groups is None:
        groups = [r[0] for r in group_splits(rows, group, "y").select(group).orderBy(group).collect()]
    out = []
    for g in groups:
        model = fit(rows.filter(F.col(group) != g), kind, params)
        out.append(E.metrics_at(score(model, rows.filter(F.col(group) == g)), "y", "p").select(F.lit(g).alias(group), "*"))
    return reduce(DataFrame.unionByName, out)


def year_transfer(rows: DataFrame, year: str, cut: int, kind: str = "random_forest", params: Mapping | None = None) -> DataFrame:
    """Early years to late years and back, next to the shared split (``split`` = train / test), which mixes years."""
    rows = settled(rows)
    early, late = rows.filter(F.col(year) <= cut), rows.filter(F.col(year) > cut)
    shared = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    out = [
        E.metrics_at(score(fit(a, kind, params), b), "y", "p").select(F.lit(n).alias("setting"), "*")
        for n, a, b in (("in_distribution", *shared), ("early_to_late", early, late), ("late_to_early", late, early))
    ]
    return reduce(DataFrame.unionByName, out)


def variant_columns(columns: Sequence[str], variants: Sequence[str]) -> list[str]:
    """Feature columns that belong to any of the spatial variants."""
    return [c for c in columns if any(f"_{v}_" in c for v in variants)]


def run_experiment(rows: DataFrame, columns: Sequence[str] | str, label: str, params: Mapping | None = None, extra_weight: str | None = None,
                   strata: Sequence[str] = ("smallholder", "medium", "large"), threshold: float = 0.5) -> DataFrame:
    """One row: metrics and recall per stratum of a forest on a shared split (``split`` = train / test)."""
    data = with_vector(rows, columns)
    forest = {"numTrees": EXPERIMENT_TREES, **(params or {})}
    model = fit(data.filter("split = 'train'"), "random_forest", forest, extra_weight=extra_weight)
    scored = settled(score(model, data.filter("split = 'test'")).select("y", "p", "stratum")).withColumn("guess", (F.col("p") >= threshold).cast("int"))
    return experiment_row(scored, label, strata, 1 if isinstance(columns, str) else len(columns))


def experiment_row(scored: DataFrame, label: str, strata: Sequence[str], n_features: int) -> DataFrame:
    hit = F.col("y") == 1
    per = [x for s in strata for x in (
        F.avg(F.when(hit & (F.col("stratum") == s), F.col("guess").cast("double"))).alias(f"recall_{s}"),
        F.count_if(hit & (F.col("stratum") == s)).alias(f"n_{s}"))]
    base = E.binary_metrics(scored, "y", "guess").drop("accuracy")
    ap = E.curve_metrics(E.score_curve(scored, "y", "p")).select("average_precision").scalar()
    return base.withColumns({"auprc": ap, "__s": scored.agg(*per).select(F.struct("*")).scalar()}).select(
        F.lit(label).alias("label"), F.lit(n_features).alias("n_feats"), "*", "__s.*").drop("__s")


def out_of_fold(rows: DataFrame, folds: Sequence[int], params: Mapping | None = None) -> DataFrame:
    """Every row scored by the model that did not see its fold."""
    rows = settled(rows)
    return reduce(DataFrame.unionByName, each(rows, lambda f: settled(score(fit(rows.filter(F.col("fold") != f), "random_forest", params), rows.filter(F.col("fold") == f))), folds))


def stratum_experiment(rows: DataFrame, label: str, folds: Sequence[int], params: Mapping | None = None, strata: Sequence[str] = ("smallholder", "medium", "large")) -> DataFrame:
    """Thresholds per stratum from out-of-fold scores of the training rows (``fold`` by site), a refit on all of them, and one row for the test split."""
    forest = {"numTrees": EXPERIMENT_TREES, **(params or {})}
    rows = settled(rows)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    best = settled(E.stratum_thresholds(out_of_fold(train, folds, forest), "stratum", "y", "p", strata))
    scored = E.apply_thresholds(settled(score(fit(train, "random_forest", forest), test).select("y", "p", "stratum")), best, "stratum", "p")
    return experiment_row(scored, label, strata, 1)


def importances(model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """(pos, feature, importance) of the tree model of a pipeline; one row per feature."""
    from pyspark.sql import SparkSession

    imp = model.stages[-1].featureImportances.toArray()
    spark = SparkSession.active()
    return spark.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(zip(names, imp))], "pos int, feature string, importance double")


def top_features(model: PipelineModel, names: Sequence[str], n: int = 15) -> DataFrame:
    return importances(model, names).orderBy(F.desc("importance"), "pos").limit(n)


def save_model(model: PipelineModel, path: str) -> None:
    """Overwrites; the folder holds every stage and can be read by any Spark session."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def cluster_series(df: DataFrame, vector: str, k: int = 4, seed: int = 42, least_valid: float = 0.5) -> DataFrame:
    """Cluster of every series with at least ``least_valid`` of its steps present; gaps are filled, then smoothed. Adds ``cluster`` and ``curve``."""
    from ..functions.series import interpolate, smooth

    present = F.size(F.filter(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    usable = df.filter(present >= least_valid * F.size(vector)).withColumn("curve", smooth(interpolate(vector)))
    data = with_vector(usable, "curve")
    return KMeans(k=k, seed=seed, featuresCol="x", predictionCol="cluster").fit(data).transform(data).drop("x")


def cluster_report(clustered: DataFrame, irrigated: str, curve: str = "curve") -> DataFrame:
    """Size, share irrigated and mean curve of each cluster."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n_pixels"), F.avg(F.col(irrigated).cast("double")).alias("frac_irrigated"))
    steps = clustered.select("cluster", F.posexplode(curve).alias("step", "value")).groupBy("cluster", "step").agg(F.avg("value").alias("mean"))
    means = steps.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "mean"))), lambda s: s["mean"]).alias("mean_curve"))
    return sizes.join(means, "cluster")
