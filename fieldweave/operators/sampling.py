"""Reproducible draws and site-level splits, all by hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from ..functions.keys import hash_key
from .ranking import first_per_key, hashed_first, hashed_sample

SEED = 42


def not_sampled(grid: DataFrame, sampled: DataFrame, key: str = "id") -> DataFrame:
    return grid.join(sampled.select(key), key, "left_anti")


def draw_points(grid: DataFrame, sampled: DataFrame, n: int, seed: int = SEED, key: str = "id") -> DataFrame:
    """n points never drawn before, sorted by latitude then longitude, for the survey tool."""
    drawn = hashed_first(not_sampled(grid, sampled, key), n, seed, [key])
    return drawn.select(key, F.col("latitude").alias("YCoordinate"), F.col("longitude").alias("XCoordinate")).orderBy(
        "YCoordinate", "XCoordinate", key)


def sample_name(country: str, threshold: float, already: int, n: int) -> str:
    """File name with the running range of drawn points."""
    return f"{country}_{threshold}_n_{already + 1}-{already + n}.csv"


def pixels_per_image(px: DataFrame, n: int, ids: Sequence[str], key: str = "file_id", seed: int = SEED) -> DataFrame:
    """Up to n pixels of each image: one scan, one shuffle, n rows per image and task (see first_per_key)."""
    return first_per_key(px, [key], [hash_key(seed, key, *ids), *ids], n)


def pick_images(rows: DataFrame, n: int, irrigation: bool = True, certainty: int | None = 1, seed: int = SEED) -> DataFrame:
    """n images, optionally only those with coverage and a code above a certainty."""
    if irrigation:
        rows = rows.filter(F.col("percent_coverage") > 0)
        if certainty:
            rows = rows.filter(F.col("irrigation") > certainty)
    return hashed_first(rows, n, seed, ["unique_id"])


def budget_sites(rows: DataFrame, budget: int, must_have: str, key: str = "unique_id", seed: int = SEED) -> DataFrame:
    """Must-have rows plus a year-stratified fill up to the budget.

    Quota of a year: its share of the remaining budget, rounded half to even, at
    least one. If rounding overshoots, the fill is trimmed by hash. ``part`` is 1
    for the chosen rows and 2 for the complement.
    """
    rows = settled(rows)
    must = rows.filter(F.col(must_have))
    rest = rows.filter(~F.col(must_have))
    left = must.agg(F.greatest(F.lit(0), F.lit(budget) - F.count("*"))).scalar()
    per_year = rest.groupBy("year").agg(F.count("*").alias("__n"))
    total = rest.agg(F.count("*")).scalar()
    quota = per_year.withColumns({"__budget": left, "__total": total}).select(
        "year",
        F.when(F.col("__budget") <= 0, 0).otherwise(F.least(
            F.col("__n"), F.greatest(F.lit(1), F.bround(F.col("__budget") * F.col("__n") / F.col("__total")).cast("long")))).alias("__quota"))
    marked = rest.join(F.broadcast(quota), "year")
    fill = settled(hashed_sample(marked, ["year"], "__quota", seed, [key]).drop("__quota"))
    trimmed = hashed_sample(fill.withColumn("__budget", left), [], "__budget", seed, [key]).drop("__budget")
    chosen = must.unionByName(trimmed).withColumn("part", F.lit(1))
    other = rest.join(chosen.select(key), key, "left_anti").withColumn("part", F.lit(2))
    return chosen.unionByName(other)


def downsample_zero(rows: DataFrame, target: str, ids: Sequence[str], ratio: float = 3.0, seed: int = SEED) -> DataFrame:
    """Class 0 cut to ratio : 1 of class 1."""
    ones = rows.filter(F.col(target) == 1)
    n = ones.agg((F.count("*") * ratio).cast("long")).scalar()
    zeros = rows.filter(F.col(target) == 0).withColumn("__q", n)
    return hashed_sample(zeros, [], "__q", seed, ids).drop("__q").unionByName(ones)


def site_labels(sites: DataFrame, table: DataFrame | None, pixels: DataFrame | None) -> DataFrame:
    """Site class: last table value, else any labelled pixel, else 0.

    ``table``: site, line, irrigation. ``pixels``: site, irrigated. Either may be None,
    which gives the three modes.
    """
    out = sites.select("site").distinct()
    parts = []
    if table is not None:
        t = table.filter(F.col("irrigation").isNotNull()).groupBy("site").agg(F.max_by("irrigation", "line").cast("int").alias("__t"))
        out, parts = out.join(t, "site", "left"), [F.col("__t")]
    if pixels is not None:
        p = pixels.groupBy("site").agg(F.bool_or(F.col("irrigated") > 0).cast("int").alias("__p"))
        out = out.join(p, "site", "left")
        parts.append(F.col("__p"))
    return out.select("site", F.coalesce(*parts, F.lit(0)).alias("y"))


def _hash_position(sites: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Exact 0-based position of each site in its class by hash, and the class size.

    Positions come from counts per hash prefix plus a rank inside one prefix, so
    a class of any size is spread over tasks.
    """
    from ..functions.keys import hash_key

    m = sites.withColumn("__h", hash_key(seed, "site")).withColumn("__b", F.substring("__h", 1, 3))
    n = m.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    before = n.select(
        *keys, "__b",
        F.coalesce(F.sum("__n").over(part.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(part).alias("__size"))
    rank = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", "site"))
    return m.join(before, [*keys, "__b"]).select(*sites.columns, (F.col("__before") + rank - 1).alias("pos"), F.col("__size").alias("size"))


def one_shot_split(site_class: DataFrame, test_size: float = 0.2, val_size: float = 0.2, min_per_class: int = 5,
                   seed: int = SEED) -> DataFrame:
    """train / val / test per site; by class when two classes are large enough.

    A class too small for the stratified split is left out of it, as is every class
    when fewer than two qualify (then the split ignores classes). Fewer than three
    sites all train.
    """
    per = site_class.groupBy("y").agg(F.count("*").alias("__k")).withColumn("__ok", F.col("__k") >= min_per_class)
    n_ok = per.agg(F.count_if("__ok")).scalar()
    total = site_class.agg(F.count("*")).scalar()
    m = site_class.join(F.broadcast(per), "y").withColumns({"stratified": n_ok >= 2, "__total": total})
    m = m.filter(~F.col("stratified") | F.col("__ok") | (F.col("__total") < 3))
    m = m.withColumn("cls", F.when(F.col("stratified"), F.col("y")).otherwise(F.lit(-1)))
    p = _hash_position(m.select("site", "y", "cls", "stratified", F.col("__total").alias("total")), ["cls"], seed)
    n_test = F.greatest(F.lit(1), F.round(F.col("size") * test_size).cast("long"))
    share = F.when(F.col("stratified"), F.lit(val_size / (1 - test_size))).otherwise(F.lit(val_size))
    left = F.col("size") - n_test
    n_val = F.when((F.lit(val_size) > 0) & (left > 1), F.greatest(F.lit(1), F.round(left * share).cast("long"))).otherwise(F.lit(0))
    return p.select(
        "site", "y", "stratified",
        F.when(F.col("total") < 3, "train").when(F.col("pos") < n_test, "test").when(F.col("pos") < n_test + n_val, "val")
        .otherwise("train").alias("split"))


def site_folds(site_class: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """Fold 1..k of every site, balanced within each class."""
    p = _hash_position(site_class.select("site", "y"), ["y"], seed)
    return p.select("site", "y", (F.pmod("pos", F.lit(k)) + 1).cast("int").alias("fold"))


def heldout_and_folds(site_class: DataFrame, test_size: float = 0.2, k: int = 5, min_per_class: int = 5, seed: int = SEED) -> DataFrame:
    """Held-out test sites, and a fold for every other site."""
    s = one_shot_split(site_class, test_size, 0.0, min_per_class, seed)
    pool = s.filter(F.col("split") == "train")
    folds = site_folds(pool, k, seed + 1)
    test = s.filter(F.col("split") == "test").select("site", "y", F.lit(None).cast("int").alias("fold"), F.lit("test").alias("split"))
    return folds.withColumn("split", F.lit("train")).unionByName(test)


def group_shuffle(sites: DataFrame, share: float, seed: int = SEED) -> DataFrame:
    """train / test by site; test gets ceil(share * sites)."""
    p = _hash_position(sites.select("site").distinct(), [], seed)
    return p.select("site", F.when(F.col("pos") < F.ceil(F.col("size") * share), "test").otherwise("train").alias("split"))


def shared_sites(split: DataFrame) -> DataFrame:
    """Sites in more than one split; empty when the split leaks nothing."""
    return split.groupBy("site").agg(F.countDistinct("split").alias("n")).filter("n > 1")


def stratum_weights(rows: DataFrame, stratum: str, boosted: str, weight: float) -> DataFrame:
    return rows.withColumn("weight", F.when(F.col(stratum) == boosted, float(weight)).otherwise(1.0))


def group_splits(rows: DataFrame, group: str, target: str, least_rows: int = 20, least_positive: int = 5) -> DataFrame:
    """Groups large enough to be left out, with their sizes."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(target) == 1).alias("pos")).filter(
        (F.col("n") >= least_rows) & (F.col("pos") >= least_positive))
