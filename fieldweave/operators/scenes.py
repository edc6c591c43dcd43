"""Scenes and time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import _c

STEP_DAYS = 10
WINDOWS = 36
BUFFER = 3
FALLBACK_STEP = 21


def candidate_scenes(scenes: DataFrame, start: str, end: str, max_cloud: float, products: Sequence[str]) -> DataFrame:
    """Scenes of a date range under a cloud limit, flagged by access to a product."""
    ok = F.exists("permissions", lambda p: F.coalesce(
        F.array_contains(F.array(*[F.contains(p, F.lit(x)) for x in products]), True), F.lit(False)))
    return scenes.filter(
        F.col("acquired").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("cloud_cover") <= max_cloud)
    ).withColumn("accessible", ok)


def candidate_summary(flagged: DataFrame, *keys: str) -> DataFrame:
    """Candidates kept and dropped for want of access."""
    return flagged.groupBy(*keys).agg(
        F.count("*").alias("in_range"), F.count_if("accessible").alias("accessible"), F.count_if(~F.col("accessible")).alias("dropped"))


def first_window_day(date, start_month: int = 1, buffer: int = BUFFER, step: int = STEP_DAYS, windows: int = WINDOWS,
                     centred: bool = False) -> Column:
    """First day of window 0: three windows before the start month, or centred on the date."""
    if centred:
        return F.date_sub(_c(date), (windows // 2 + buffer) * step)
    return F.date_sub(F.make_date(F.year(_c(date)), F.lit(start_month), F.lit(1)), buffer * step)


def make_windows(rows: DataFrame, date: str, windows: int = WINDOWS, buffer: int = BUFFER, step: int = STEP_DAYS,
                 start_month: int = 1, centred: bool = False) -> DataFrame:
    """One row per row and window: t, start (inclusive), end (exclusive)."""
    n = windows + 2 * buffer
    first = first_window_day(date, start_month, buffer, step, windows, centred)
    return (
        rows.withColumn("__first", first)
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumns({"start": F.date_add("__first", F.col("t") * step), "end": F.date_add("__first", (F.col("t") + 1) * step)})
        .drop("__first")
    )


def window_step(date, first_day, step: int = STEP_DAYS, n: int = WINDOWS + 2 * BUFFER, fallback: int = FALLBACK_STEP) -> Column:
    """Window of a date by arithmetic, no range join; the fallback step outside all windows."""
    k = F.floor(F.datediff(_c(date), _c(first_day)) / step)
    return F.coalesce(F.when((k >= 0) & (k < n), k), F.lit(fallback)).cast("int")


def labelled_step(labels: DataFrame, windows: DataFrame, key: str, date: str, fallback: int = FALLBACK_STEP) -> DataFrame:
    """Window that holds the labelled date, from stored windows of any length; lowest t wins."""
    hit = labels.join(windows.select(key, "t", "start", "end"), key).filter(
        (F.col("start") <= F.col(date)) & (F.col(date) < F.col("end"))).groupBy(key, date).agg(F.min("t").alias("__t"))
    return labels.join(hit, [key, date], "left").withColumn("step", F.coalesce("__t", F.lit(fallback)).cast("int")).drop("__t")


def label_to_window_file(labels: DataFrame, windows: DataFrame, key: str, date: str) -> DataFrame:
    """The one window file that holds the labelled date; none or several is an error row."""
    hit = labels.join(windows, key).filter((F.col("start") <= F.col(date)) & (F.col(date) < F.col("end"))).groupBy(key, date).agg(
        F.count("*").alias("n_files"), F.min("t").alias("t"))
    return labels.join(hit, [key, date], "left").withColumn(
        "status", F.when(F.coalesce("n_files", F.lit(0)) == 1, "matched").when(F.col("n_files") > 1, "several").otherwise("none")
    ).withColumn("t", F.when(F.col("status") == "matched", F.col("t"))).drop("n_files")


def score_columns() -> dict[str, Column]:
    """Sort keys of the three scene choosers, smallest first."""
    inf = F.lit(float("inf"))
    return {
        "good_pixels": -F.col("good_pixels").cast("double"),
        "least_cloud": F.coalesce(F.col("cloud_cover"), inf),
        "effective_coverage": -F.coalesce(F.col("effective_coverage"), F.lit(0.0)),
    }


def best_scene(scenes: DataFrame, keys: Sequence[str], score: Column, scene: str = "scene_id") -> DataFrame:
    """Best scene of each key by a score column; the chooser is the argument.

    ``min_by`` combines on the map side, so a site with a third of all scenes sends
    one candidate per task and window.
    """
    cols = [c for c in scenes.columns if c not in keys]
    return (
        scenes.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(score.alias("s"), F.col(scene).alias("i"))).alias("__b"))
        .select(*keys, "__b.*")
    )


def fill_windows(windows: DataFrame, best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every window of every site; windows without a scene exist = false, masked 1.0."""
    return (
        windows.join(best, [*keys, "t"], "left")
        .withColumn("file_exists", F.col("scene_id").isNotNull())
        .withColumn("masked_fraction", F.when(F.col("file_exists"), F.col("masked_fraction")).otherwise(1.0))
    )


def anchor_scene(best: DataFrame, key: str, coverage: str = "effective_coverage") -> DataFrame:
    """Scene of the highest coverage per site, none when all are zero; the earliest window wins ties."""
    return best.filter(F.col(coverage) > 0).groupBy(key).agg(
        F.max_by("scene_id", F.struct(F.col(coverage), -F.col("t"))).alias("anchor"), F.max(coverage).alias("coverage"))


def effective_coverage(footprint="footprint_coverage", clear="aoi_clear_percent", fallback="clear_percent") -> list[Column]:
    """Footprint (100 when unknown), clear share (scene value when unknown) and their product."""
    fp = F.coalesce(_c(footprint), F.lit(100.0))
    cl = F.coalesce(_c(clear), _c(fallback), F.lit(0.0))
    eff = F.when(_c(clear).isNull(), cl).otherwise(fp * cl / 100.0)
    return [fp.alias("footprint_coverage"), cl.alias("aoi_clear_percent"), eff.alias("effective_coverage")]


def window_centres(windows: DataFrame, labelled: str | None = None, step: int = STEP_DAYS) -> DataFrame:
    """Centre of each stored window; without stored dates, steps counted from the labelled date."""
    half = F.date_add("start", F.floor(F.datediff("end", "start") / 2).cast("int"))
    if labelled is None:
        return windows.withColumn("centre", half)
    guess = F.date_add(F.col(labelled), (F.col("t") - FALLBACK_STEP) * step)
    return windows.withColumn("centre", F.coalesce(half, guess))


def download_statistics(windows: DataFrame) -> DataFrame:
    """Stacks, stacks with at least half their windows, their share, median of mean masked fraction.

    A missing masked fraction counts as fully masked. ``windows``: file_id, file_exists, masked_fraction.
    Stacks without windows count in the total only: give them one row with NULL file_exists.
    """
    from .ranking import group_percentiles

    per = windows.groupBy("file_id").agg(
        F.count("file_exists").alias("n"), F.count_if(F.coalesce("file_exists", F.lit(False))).alias("present"),
        F.avg(F.when(F.col("file_exists").isNotNull(), F.coalesce("masked_fraction", F.lit(1.0)))).alias("masked"))
    med = group_percentiles(per, [], "masked", {"p": 0.5}).scalar()
    return per.agg(
        F.count("*").alias("total_samples"),
        F.count_if((F.col("n") > 0) & (F.col("present") / F.col("n") >= 0.5)).alias("samples_with_50pct_images"),
    ).select(
        "*", (F.col("samples_with_50pct_images") / F.col("total_samples") * 100).alias("percent_with_50pct_images"),
        F.coalesce(med, F.lit(0.0)).alias("median_of_avg_masked_fraction"))


def availability(windows: DataFrame) -> DataFrame:
    """Per stack: share of missing windows, of heavily masked ones, and of those among present ones.

    Here a missing flag counts as present and a missing fraction as 0.
    """
    here = F.coalesce("file_exists", F.lit(True))
    heavy = F.coalesce("masked_fraction", F.lit(0.0)) > 0.5
    return windows.groupBy("file_id").agg(
        F.count("*").alias("total_windows"), F.avg((~here).cast("double")).alias("missing"),
        F.avg(heavy.cast("double")).alias("heavily_masked"),
        F.avg(F.when(here, heavy.cast("double"))).alias("conditional_heavily_masked"))


def cloud_fraction(flags: DataFrame, key: str, flag: str, least_good: float = 0.85) -> DataFrame:
    """Cloud and good share of each image, and whether it is kept."""
    cloud = F.avg(F.col(flag).cast("double"))
    return flags.groupBy(key).agg(cloud.alias("cloud_fraction")).withColumn("good_fraction", 1 - F.col("cloud_fraction")).withColumn(
        "keep", F.col("good_fraction") >= least_good)
