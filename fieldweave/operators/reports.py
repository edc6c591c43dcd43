"""Counts and summaries behind the figures and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import _c, range_start, survey_id
from ..functions.values import safe_div
from .ranking import group_percentiles

LABELER = "operator_initials"


def size_in_hectares(rows: DataFrame, size: str, positive: Column, limit: float = 100.0) -> DataFrame:
    """Size in hectares; a median of the positives at or above the limit means square metres."""
    med = group_percentiles(rows.filter(positive), [], size, {"p": 0.5}).scalar()
    return rows.withColumn("__m", med).withColumn(
        "size_ha", F.when(F.col("__m") < limit, F.col(size)).otherwise(F.col(size) / 10_000.0)).drop("__m")


def label_overlap(rows: DataFrame, labeler: str) -> DataFrame:
    """Labelers per image and whether one labeler, the others or both rated it."""
    mine = F.bool_or(F.col(LABELER) == labeler)
    theirs = F.bool_or(F.col(LABELER) != labeler)
    return rows.groupBy("image_id").agg(
        F.countDistinct(LABELER).alias("n_labelers"),
        F.when(mine & theirs, "both").when(mine, F.lit(f"only_{labeler.lower()}")).otherwise("only_others").alias("overlap"))


def images_per_labeler(rows: DataFrame) -> DataFrame:
    """Images per labeler, also divided by the surveys of the labeler."""
    return rows.groupBy(LABELER).agg(
        F.count("*").alias("images"), F.countDistinct("source_file").alias("surveys")
    ).withColumn("images_per_survey", F.col("images") / F.col("surveys"))


def label_shares(rows: DataFrame, codes: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Share of each code within each labeler, one column per code."""
    n = F.count("*")
    return rows.groupBy(LABELER).agg(*[(F.count_if(F.col("irrigation") == c) / n).alias(f"code_{c}") for c in codes])


def box_statistics(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, and whiskers at the last value within 1.5 IQR of the box."""
    q = group_percentiles(rows, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumns({"__lo": F.col("q1") - 1.5 * iqr, "__hi": F.col("q3") + 1.5 * iqr})
    v = F.col(value)
    w = rows.select(*keys, value).join(q, list(keys)).groupBy(*keys).agg(
        F.min(F.when(v >= F.col("__lo"), v)).alias("whisker_low"), F.max(F.when(v <= F.col("__hi"), v)).alias("whisker_high"),
        F.count_if((v < F.col("__lo")) | (v > F.col("__hi"))).alias("outliers"))
    return q.select(*keys, "q1", "q2", "q3").join(w, list(keys))


def outlier_shares(rows: DataFrame, value: str, threshold: float) -> DataFrame:
    """Values above a threshold per labeler: share of all such values, and share of the labeler's own."""
    hits = F.count_if(F.col(value) > threshold)
    per = rows.groupBy(LABELER).agg(hits.alias("n"), F.count("*").alias("__all"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return per.filter("n > 0").select(
        LABELER, "n", (F.col("n") / total).alias("share_of_outliers"), (F.col("n") / F.col("__all")).alias("share_of_labeler"))


def survey_location_image_counts(rows: DataFrame) -> DataFrame:
    """Distinct surveys, locations, images per labeler, in all, and summed over labelers.

    One row per distinct (labeler, survey, site, image number) comes first, so the
    distinct counts run on the reduced table.
    """
    image = F.concat_ws("_", "site_id", F.col("image_number").cast("string"))
    base = rows.select(LABELER, "plot_file", "site_id", image.alias("__image")).distinct()
    counts = [F.countDistinct("plot_file").alias("surveys"), F.countDistinct("site_id").alias("locations"), F.countDistinct("__image").alias("images")]
    per = base.groupBy(LABELER).agg(*counts)
    unique = base.agg(*counts).select(F.lit("Total (unique)").alias(LABELER), "surveys", "locations", "images")
    added = per.agg(*[F.sum(c).alias(c) for c in ("surveys", "locations", "images")]).select(
        F.lit("Total (not unique)").alias(LABELER), "surveys", "locations", "images")
    return per.unionByName(unique).unionByName(added)


def labeler_summary(images: DataFrame, polygons: DataFrame) -> DataFrame:
    """Locations, images, irrigated share, polygons and area per labeler with a Total row."""
    def sets(df, aggs):
        return df.groupingSets([[LABELER], []], LABELER).agg(*aggs).withColumn(LABELER, F.coalesce(LABELER, F.lit("Total")))

    irrigated = F.count_if(F.col("irrigation") >= 3)
    a = sets(images, [F.countDistinct("site_id").alias("locations"), F.count("*").alias("images"), irrigated.alias("irrigated_images"),
                      (irrigated / F.count("*") * 100).alias("pct_irrigated")])
    b = sets(polygons, [F.count("*").alias("polygons"), F.sum("polygon_area_m2").alias("total_area_m2")])
    return a.join(b, LABELER, "left").fillna({"polygons": 0, "total_area_m2": 0.0})


def split_statistics(rows: DataFrame, split: str = "split") -> DataFrame:
    """Images, sites, irrigated images and sites, small-scale and industrial images per split."""
    wet = F.col("irrigation") >= 3
    return rows.groupBy(split).agg(
        F.count("*").alias("images"), F.countDistinct("site_id").alias("locations"), F.count_if(wet).alias("irrigated"),
        F.round(F.avg(wet.cast("double")) * 100, 1).alias("pct_irrigated"),
        F.countDistinct(F.when(wet, F.col("site_id"))).alias("irrigated_sites"),
        F.count_if(F.col("coverage_small_scale") > 0).alias("small_scale"), F.count_if(F.col("coverage_industrial") > 0).alias("industrial"))


def detections_per_image(rows: DataFrame, labelers: Sequence[str]) -> DataFrame:
    """Rows of each image by labeler, zero when none."""
    return rows.groupBy("image_id").agg(*[F.count_if(F.col(LABELER) == n).alias(n) for n in labelers])


def location_summary(rows: DataFrame, keys: Sequence[str], order: str = "unique_id") -> DataFrame:
    """Per location: most images, first date, means, labelers and the commonest water source (ties by name)."""
    src = rows.filter(F.col("water_source").isNotNull()).groupBy(*keys, "water_source").agg(F.count("*").alias("__n"))
    top = src.groupBy(*keys).agg(F.min(F.struct(-F.col("__n"), F.col("water_source").alias("w")))["w"].alias("water_source_mode"))
    first = F.min_by(F.struct("year", "month", "day"), order)
    s = rows.groupBy(*keys).agg(
        F.max("image_number").alias("images"), first.alias("__f"), F.avg("irrigation").alias("avg_certainty"),
        F.avg("percent_coverage").alias("avg_percent_coverage"), F.avg("percent_coverage_hc").alias("avg_percent_coverage_high"),
        F.countDistinct(LABELER).alias("n_labelers"))
    return s.join(top, list(keys), "left").select(*s.columns[:len(keys)], "images", "__f.*", "avg_certainty", "avg_percent_coverage",
                                                  "avg_percent_coverage_high", "n_labelers", "water_source_mode")


def yearly_band(rows: DataFrame, value: str, year: str = "year") -> DataFrame:
    """Yearly mean with a 95 percent band; the divisor counts all rows, as the mean skips missing ones."""
    s = rows.groupBy(year).agg(F.avg(value).alias("mean_coverage"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"))
    return s.withColumns({"lower": F.col("mean_coverage") - 1.96 * F.col("se"), "upper": F.col("mean_coverage") + 1.96 * F.col("se")})


def describe(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, sample std, min, quartiles, max."""
    base = rows.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = group_percentiles(rows, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    if keys:
        return base.join(q, list(keys))
    return base.withColumn("__q", q.select(F.struct("p25", "p50", "p75")).scalar()).select("*", "__q.*").drop("__q")


def value_counts(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.groupBy(*cols).agg(F.count("*").alias("n"))


def polygons_per_image(polygons: DataFrame, last: int = 30) -> DataFrame:
    """Images by number of polygons; the last bin is open."""
    per = polygons.groupBy("image_id").agg(F.count("*").alias("n"))
    return per.groupBy(F.least("n", F.lit(last)).alias("polygons")).agg(F.count("*").alias("images"))


def log_bins(rows: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Log-spaced counts between the least and the greatest value of each key (+0.01, as zero has no log)."""
    v = F.log10(F.col(value) + 0.01)
    span = rows.groupBy(*keys).agg(F.min(v).alias("__a"), F.max(v).alias("__b"))
    width = (F.col("__b") - F.col("__a")) / bins
    b = F.least(F.floor(F.round((v - F.col("__a")) / width, 9)), F.lit(bins - 1)).cast("int")
    return rows.join(span, list(keys)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def clip_at_percentile(rows: DataFrame, value: str, p: float = 0.99) -> DataFrame:
    """Rows at or below the p-th percentile of the whole table."""
    cut = group_percentiles(rows, [], value, {"p": p}).scalar()
    return rows.filter(F.col(value) <= cut)


def survey_industrial(rows: DataFrame) -> DataFrame:
    """Industrial and irrigated images per survey in order of the range start."""
    s = rows.withColumn("survey_id", survey_id()).filter(F.col("survey_id").isNotNull())
    return s.groupBy("survey_id").agg(
        F.count_if(F.col("coverage_industrial") > 0).alias("industrial"), F.count_if(F.col("irrigation") >= 3).alias("irrigated")
    ).filter("industrial > 0").orderBy(range_start("survey_id"))


def outcome_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def pixels_per_parcel(rows: DataFrame, stratum: str, size_ha: str, per_hectare: float = 100.0) -> DataFrame:
    """Describe the estimated pixel count of parcels by stratum."""
    return describe(rows.withColumn("__px", F.col(size_ha) * per_hectare), [stratum], "__px")


def recall_by_stratum(scored: DataFrame, stratum: str, truth: str, guess: str, proba: str | None = None, least: int = 1) -> DataFrame:
    """Recall and mean score of the positives of each stratum; small strata dropped."""
    aggs = [F.count("*").alias("n_pos"), F.avg(F.col(guess).cast("double")).alias("recall")]
    if proba:
        aggs.append(F.avg(proba).alias("mean_proba"))
    return scored.filter(F.col(truth) == 1).groupBy(stratum).agg(*aggs).filter(F.col("n_pos") >= least)


def parity_gap(recalls: DataFrame) -> DataFrame:
    return recalls.agg((F.max("recall") - F.min("recall")).alias("gap"))


def class_report(rows: DataFrame, keys: Sequence[str], truth: str, guess: str, classes: dict[int, str], n=None) -> DataFrame:
    """Precision, recall, F1 and support of each class, one aggregate for all keys.

    ``n`` is a weight column for rows that stand for several pixels.
    """
    w = F.lit(1) if n is None else _c(n)
    aggs = []
    for c in classes:
        t, g = F.col(truth) == c, F.col(guess) == c
        aggs += [F.coalesce(F.sum(F.when(t & g, w)), F.lit(0)).alias(f"tp_{c}"), F.coalesce(F.sum(F.when(t, w)), F.lit(0)).alias(f"t_{c}"),
                 F.coalesce(F.sum(F.when(g, w)), F.lit(0)).alias(f"g_{c}")]
    s = rows.groupBy(*keys).agg(*aggs)
    parts = F.array(*[F.struct(F.lit(name).alias("class"), F.col(f"tp_{c}").alias("tp"), F.col(f"t_{c}").alias("support"), F.col(f"g_{c}").alias("g"))
                      for c, name in classes.items()])
    s = s.select(*keys, F.explode(parts).alias("c")).select(*keys, "c.*")
    p, r = safe_div("tp", "g"), safe_div("tp", "support")
    return s.select(*keys, "class", p.alias("precision"), r.alias("recall"), safe_div(2 * F.col("tp"), F.col("g") + F.col("support")).alias("f1_score"), "support")
