"""Series per image or pixel: shapes, features, classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as SR
from .ranking import hashed_sample

INDEX_NAMES = {"ndvi": "ndvi", "ndvi_p90": "ndvip90", "ndwi": "ndwi", "evi": "evi"}


def to_series(rows: DataFrame, keys: Sequence[str], value: str, steps: int, step: str = "t") -> DataFrame:
    """One array of ``steps`` values per key; absent steps are NULL.

    The steps are a fixed list, so the array is built from fixed slots without sorting.
    """
    slots = [F.max(F.when(F.col(step) == t, F.col(value))) for t in range(steps)]
    return rows.groupBy(*keys).agg(F.array(*slots).alias(value))


def to_rows(df: DataFrame, keys: Sequence[str], array: str, value: str = "v") -> DataFrame:
    """One row per key and step.

    The outer form matters: for the inner form the optimizer adds a filter on the
    array's size and pushes it below the projection that computes the array, which
    then runs its nested lambdas over and over.
    """
    return df.select(*keys, F.posexplode_outer(array).alias("t", value)).filter(F.col("t").isNotNull())


def with_summary(df: DataFrame, array: str, prefix: str = "", short: bool = False) -> DataFrame:
    """The eleven (or, skipping missing steps, five) summary columns of a series."""
    made = SR.temporal_summary(array, prefix) if short else SR.summary(array, prefix)
    return df.withColumn("__s", made).select("*", "__s.*").drop("__s")


def sample_series(df: DataFrame, cls: str, n: int, ids: Sequence[str], array: str = "v", least_valid: float = 0.5, seed: int = 42) -> DataFrame:
    """Up to n series of each class with enough valid steps."""
    return hashed_sample(df.filter(SR.valid_share(array) >= least_valid), [cls], n, seed, ids)


def mean_curve(df: DataFrame, cls: str, array: str = "v") -> DataFrame:
    """Mean of each step per class, missing steps skipped."""
    return to_rows(df, [cls], array).groupBy(cls, "t").agg(F.avg("v").alias("mean"))


def wide_features(df: DataFrame, keys: Sequence[str], stride: int = 3, windows: int = 42, drop: float = 0.0, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Eleven summaries of four index series, two cross terms and every third raw step.

    Missing steps are interpolated first; a degraded variant drops steps and adds noise.
    """
    def ready(name):
        if drop or noise:
            return SR.degrade(name, [*keys, F.lit(name)], drop, noise, seed)
        return SR.interpolate(name)

    base = df.withColumns({f"__{n}": ready(n) for n in INDEX_NAMES})
    base = base.withColumns({f"__s_{n}": SR.summary(f"__{n}", f"{short}_") for n, short in INDEX_NAMES.items()})
    wide = base.select("*", *[f"__s_{n}.*" for n in INDEX_NAMES])
    wide = wide.withColumns({
        "ndvi_ndwi_late": F.col("ndvi_late") * F.col("ndwi_late"),
        "p90_minus_mean_late": F.col("ndvip90_late") - F.col("ndvi_late"),
    })
    raw = {}
    for t in range(0, windows, stride):
        raw[f"ndvi_t{t:02d}"] = F.get("__ndvi", F.lit(t))
        raw[f"ndwi_t{t:02d}"] = F.get("__ndwi", F.lit(t))
    return wide.withColumns(raw).drop(*[f"__{n}" for n in INDEX_NAMES], *[f"__s_{n}" for n in INDEX_NAMES], *INDEX_NAMES)


def impute(df: DataFrame, cols: Sequence[str], how: str = "mean", value: float = 0.0) -> DataFrame:
    """Missing numbers filled by a constant or by the column mean (one aggregate for all columns)."""
    if how == "constant":
        return df.fillna(value, list(cols))
    if how != "mean":
        raise ValueError(f"unknown imputation {how!r}")
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).select(F.struct(*cols)).scalar()
    return df.withColumn("__m", means).withColumns({c: F.coalesce(F.col(c), F.col(f"__m.{c}")) for c in cols}).drop("__m")
