"""Agreement of labelers: date matching, detection and area metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import harmonic, safe_div


def nearest_date_matches(rows: DataFrame, reference: str, others: Sequence[str] | None = None, tolerance: int = 1,
                         site: str = "site_id", date: str = "image_date", labeler: str = "operator_initials") -> DataFrame:
    """For every reference image the closest image of each other labeler within the tolerance.

    Dates are cut into buckets of ``tolerance + 1`` days and the reference side is
    repeated into the three neighbouring buckets, so the join key is (site, bucket):
    a site with a third of all rows still joins only days that can match. Both
    sides are distinct first. The best candidate is an aggregate with map-side
    combine. One comparison image may serve several reference images; ties go to
    the earlier date.
    """
    span = tolerance + 1
    imgs = rows.select(site, F.col(date).alias("__d"), F.col(labeler).alias("__op")).distinct()
    imgs = imgs.withColumn("__b", F.floor(F.unix_date("__d") / span))
    gt = imgs.filter(F.col("__op") == reference).select(
        site, F.col("__d").alias("gt_date"),
        F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)).alias("__b"))
    comp = imgs.filter(F.col("__op") != reference) if others is None else imgs.filter(F.col("__op").isin(*others))
    comp = comp.select(site, F.col("__d").alias("comp_date"), F.col("__op").alias("comp_op"), "__b")
    near = gt.join(comp, [site, "__b"]).withColumn("date_diff", F.abs(F.datediff("gt_date", "comp_date")))
    return (
        near.filter(F.col("date_diff") <= tolerance)
        .groupBy("comp_op", site, "gt_date")
        .agg(F.min(F.struct("date_diff", "comp_date")).alias("__m"))
        .select("comp_op", site, "gt_date", F.col("__m.comp_date").alias("comp_date"), F.col("__m.date_diff").alias("date_diff"))
    )


def polygon_counts(polygons: DataFrame, min_certainty: int = 3) -> DataFrame:
    """Polygons per (site, date, labeler) at or above a certainty."""
    return (
        polygons.filter(F.col("certainty") >= min_certainty)
        .groupBy("site_id", "image_date", "operator_initials")
        .agg(F.count("*").alias("n"))
    )


def attach_counts(matches: DataFrame, counts: DataFrame, reference: str) -> DataFrame:
    """``n_gt`` and ``n_comp`` polygons of every match, zero when none."""
    gt = counts.filter(F.col("operator_initials") == reference).select(
        "site_id", F.col("image_date").alias("gt_date"), F.col("n").alias("n_gt"))
    comp = counts.select(
        "site_id", F.col("image_date").alias("comp_date"), F.col("operator_initials").alias("comp_op"), F.col("n").alias("n_comp"))
    return (
        matches.join(gt, ["site_id", "gt_date"], "left").join(comp, ["site_id", "comp_date", "comp_op"], "left")
        .fillna(0, ["n_gt", "n_comp"])
    )


def confusion(truth: Column, guess: Column) -> list[Column]:
    """tp, fp, fn, tn counts of two boolean columns."""
    return [
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"),
    ]


def with_rates(df: DataFrame) -> DataFrame:
    """Rates of tp, fp, fn, tn; zero where the divisor is zero."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return df.withColumns({
        "precision": p, "recall": r, "f1": harmonic(p, r),
        "fpr": safe_div(fp, fp + tn), "fnr": safe_div(fn, fn + tp),
        "total_images": tp + fp + fn + tn,
    })


def detection_metrics(matches: DataFrame) -> DataFrame:
    """Image-level detection per comparison labeler, all labelers in one pass."""
    return with_rates(
        matches.groupBy("comp_op").agg(*confusion(F.col("n_gt") > 0, F.col("n_comp") > 0))
    )


def overall_area_metrics(areas: DataFrame, key: str = "comp_op") -> DataFrame:
    """Precision, recall, IoU and F1 of summed areas."""
    tot = areas.groupBy(key).agg(*[
        F.sum(c).alias(f"total_{n}") for c, n in (
            ("gt_area", "gt_area"), ("comp_area", "comp_area"),
            ("intersection_area", "intersection"), ("union_area", "union"))
    ])
    p = safe_div("total_intersection", "total_comp_area")
    r = safe_div("total_intersection", "total_gt_area")
    return tot.withColumns({
        "precision": p, "recall": r, "iou": safe_div("total_intersection", "total_union"), "f1": harmonic(p, r)})


def image_area_metrics(areas: DataFrame) -> DataFrame:
    """Per-image precision, recall, IoU, F1 of images where either side drew.

    Precision is missing without a guess, recall is missing without truth.
    """
    gt, comp, both, either = (F.col(c) for c in ("gt_area", "comp_area", "intersection_area", "union_area"))
    p = F.when(comp > 0, both / comp)
    r = F.when(gt > 0, both / gt)
    return areas.filter((gt > 0) | (comp > 0)).withColumns({
        "precision": p, "recall": r,
        "iou": safe_div(both, either),
        "f1": F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(0.0),
    })


def histogram(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Equal-width counts; the last bin is closed on the right."""
    v = F.col(value)
    b = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(v.isNotNull() & v.between(lo, hi)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def weighted_average_row(df: DataFrame, name_col: str, weight: str, sums: Sequence[str], means: Sequence[str],
                         label: str = "Weighted Avg") -> DataFrame:
    """The table plus one row: sums added up, means weighted."""
    total = df.agg(
        F.lit(label).alias(name_col),
        *[F.sum(c).alias(c) for c in [weight, *sums]],
        *[(F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in means],
    )
    cols = [name_col, weight, *sums, *means]
    return df.select(*cols).unionByName(total.select(*cols))


def weighted_metric(df: DataFrame, metric: str, weight: str, labelers: Sequence[str], name_col: str = "comp_op") -> DataFrame:
    """One number: a metric averaged over some labelers by weight."""
    return df.filter(F.col(name_col).isin(*labelers)).agg(
        (F.sum(F.col(metric) * F.col(weight)) / F.sum(weight)).alias(metric))


def rating_confusion(rows: DataFrame, reference: str, threshold: int = 3) -> DataFrame:
    """Confusion of thresholded ratings against a reference labeler.

    Every image of the table counts for every labeler; an image a labeler did not
    rate counts as not irrigated for that labeler. So the cells follow from four counts: images in
    all, positives of each side, and positives of both.
    """
    flags = rows.groupBy("image_id", "operator_initials").agg(F.max(F.col("irrigation") >= threshold).alias("pos"))
    images = flags.select("image_id").distinct().agg(F.count("*")).scalar()
    ref = flags.filter((F.col("operator_initials") == reference) & F.col("pos")).select("image_id", F.lit(True).alias("ref"))
    ref_total = ref.agg(F.count("*")).scalar()
    per = (
        flags.filter(F.col("operator_initials") != reference).join(ref, "image_id", "left")
        .groupBy("operator_initials")
        .agg(F.count_if(F.col("pos")).alias("g"), F.count_if(F.col("pos") & F.coalesce("ref", F.lit(False))).alias("tp"))
        .withColumns({"__n": images, "__r": ref_total})
    )
    tp, g, r, n = (F.col(c) for c in ("tp", "g", "__r", "__n"))
    return per.select(
        "operator_initials", "tp", (g - tp).alias("fp"), (r - tp).alias("fn"), (n - g - r + tp).alias("tn"),
        safe_div(g - tp, n - r).alias("fp_rate"), safe_div(r - tp, r).alias("fn_rate"),
    )


def trend_against(rows: DataFrame, reference: str, value: str) -> DataFrame:
    """Least-squares line and R2 of each labeler's value against the reference labeler's, image by image."""
    v = rows.groupBy("image_id", "operator_initials").agg(F.max(value).alias("v")).filter(F.col("v").isNotNull())
    ref = v.filter(F.col("operator_initials") == reference).select("image_id", F.col("v").alias("ref"))
    return (
        v.filter(F.col("operator_initials") != reference).join(ref, "image_id")
        .groupBy("operator_initials")
        .agg(F.count("*").alias("n"), F.regr_slope("v", "ref").alias("slope"),
             F.regr_intercept("v", "ref").alias("intercept"), F.regr_r2("v", "ref").alias("r2"))
    )


def images_with_polygons(matches: DataFrame) -> DataFrame:
    """Matched reference images where anyone drew, sorted."""
    return (
        matches.filter((F.col("n_gt") > 0) | (F.col("n_comp") > 0))
        .select("site_id", "gt_date").distinct().orderBy("site_id", "gt_date")
    )


def image_comparison(matches: DataFrame, labelers: Sequence[str]) -> DataFrame:
    """One row per matched image: reference count and one column per labeler, NULL where unseen."""
    return matches.groupBy("site_id", "gt_date", "n_gt").pivot("comp_op", list(labelers)).agg(F.max("n_comp"))


def screenshot_stack(shots: DataFrame, labels: DataFrame) -> DataFrame:
    """Label row of each screenshot: exact date first, else any row of the id; earliest row wins ties.

    ``shots``: shot_id, survey_id, internal_id, image_date. ``labels``: survey_id,
    internal_id, image_date, site_id, unique_id. The label side is reduced before
    the joins (first row per id, and per id and date), so a repeated id stays one row.
    """
    ids = ["survey_id", "internal_id"]
    exact = labels.groupBy(*ids, "image_date").agg(F.min_by("site_id", "unique_id").alias("exact_site"))
    loose = labels.groupBy(*ids).agg(F.min_by("site_id", "unique_id").alias("loose_site"))
    return (
        shots.join(exact, [*ids, "image_date"], "left").join(loose, ids, "left")
        .withColumn("site_id", F.coalesce("exact_site", "loose_site"))
        .withColumn("match_rank", F.when(F.col("exact_site").isNotNull(), 1).when(F.col("loose_site").isNotNull(), 2))
        .drop("exact_site", "loose_site")
    )


def polygons_near_date(images: DataFrame, polygons: DataFrame, tolerance: int = 1) -> DataFrame:
    """Polygon count per image within a day tolerance, any labeler.

    Polygons are counted per (site, date) first; the tolerance is a repeat of
    those counts onto the neighbouring days and an equi join.
    """
    daily = polygons.groupBy("site_id", "image_date").agg(F.count("*").alias("__n"))
    spread = daily.select(
        "site_id", F.explode(F.array(*[F.date_add("image_date", k) for k in range(-tolerance, tolerance + 1)])).alias("image_date"),
        "__n").groupBy("site_id", "image_date").agg(F.sum("__n").alias("n_polygons"))
    return images.join(spread, ["site_id", "image_date"], "left").fillna(0, ["n_polygons"])

