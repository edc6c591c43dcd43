"""Survey rows and drawn polygons: matching, checks, versions, duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import final_operator, image_id, site_number
from ..functions.values import contains_any
from .ranking import by_priority, first_per_key

DATE = ["year", "month", "day"]

# Survey files kept or dropped by hand.
ALWAYS_IN = ["AB_JL_v2_101-125", "PS_101-125", "PS_1025-1049"]
ALWAYS_OUT = "MV_76-100"


def _places(survey: DataFrame, polygons: DataFrame, survey_key: str, polygon_key: str, keys: Sequence[str], once: bool = False) -> tuple[list[str], DataFrame, DataFrame]:
    """(place columns, distinct survey rows by place, polygon rows by place). A survey row has two places, one by internal id and one by site number: labelers
    sometimes typed the site number instead of the internal id. What has no place matches nothing. ``once``: every key names one row, so nothing is to be made distinct."""
    at = ["__id", *DATE, *keys]
    known = [F.col(c).isNotNull() for c in at]
    rows = survey.withColumn("__id", F.explode(F.array_distinct(F.array(F.col("internal_id"), site_number()))))
    left = rows.select(survey_key, *at).filter(reduce(Column.__and__, known))
    left = left if once else left.distinct()
    right = polygons.withColumn("__id", F.col("internal_id")).withColumn("__at", F.when(reduce(Column.__and__, known), F.struct(*at)))
    return at, left, right


def survey_polygon_matches(survey: DataFrame, polygons: DataFrame, survey_key: str, polygon_key: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct pairs (survey_key, polygon_key) on the date and the internal id or the site number, and on ``keys`` (bundles of surveys share internal ids).

    The OR is an equality on places. Pairs grow with the square of a date's rows and are not shuffled: both sides are distinct before the join, so only
    polygon keys that stand at several places can meet a survey row twice. What needs no pairs asks ``polygon_stats``, ``polygon_site`` or ``unmatched_polygons``.
    """
    at, left, right = _places(survey, polygons, survey_key, polygon_key, keys)
    drawn = right.filter(F.col("__at").isNotNull()).groupBy(polygon_key).agg(F.collect_set("__at").alias("__places"))
    several = F.size("__places") > 1
    where = lambda part: part.select(polygon_key, F.explode("__places").alias("__at")).select(polygon_key, "__at.*")
    once = left.join(where(drawn.filter(~several)), at).select(survey_key, polygon_key)
    return once.unionByName(left.join(where(drawn.filter(several)), at).select(survey_key, polygon_key).distinct())


def polygon_site(survey: DataFrame, polygons: DataFrame, survey_key: str, polygon_key: str, line: str, keys: Sequence[str] = ()) -> DataFrame:
    """Site of each matched polygon; the last matching survey row wins. The last row of a place is known before polygons meet it, so there are no pairs."""
    at, left, right = _places(survey, polygons, survey_key, polygon_key, keys)
    order = F.struct(F.col(line), F.col(survey_key))
    info = survey.groupBy(survey_key).agg(F.max(order).alias("__order"), F.max_by("site_id", order).alias("__site"))
    last = left.join(info, survey_key).groupBy(*at).agg(F.max("__order").alias("__order"), F.max_by("__site", "__order").alias("__site"))
    return right.select(polygon_key, *at).join(last, at).groupBy(polygon_key).agg(F.max_by("__site", "__order").alias("site_id"))


def with_polygon_site(survey: DataFrame, polygons: DataFrame, survey_key: str, line: str, keys: Sequence[str] = ()) -> DataFrame:
    """``polygons`` with the ``site_id`` that ``polygon_site`` finds, where every row of both tables is one survey answer or one polygon: they are sent once, by place."""
    at = ["__id", *DATE, *keys]
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in at])
    rows = survey.withColumn("__id", F.explode(F.array_distinct(F.array(F.col("internal_id"), site_number())))).filter(known)
    last = rows.groupBy(*at).agg(F.max_by("site_id", F.struct(line, survey_key)).alias("site_id"))
    return polygons.withColumn("__id", F.col("internal_id")).join(last, at, "left").select(*polygons.columns, "site_id")


def unmatched_polygons(survey: DataFrame, polygons: DataFrame, survey_key: str, polygon_key: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct polygon keys that no survey row matches at any of their places."""
    at, left, right = _places(survey, polygons, survey_key, polygon_key, keys)
    met = right.select(polygon_key, *at).join(left.select(*at).distinct().withColumn("__met", F.lit(True)), at, "left")
    met = met.groupBy(polygon_key).agg(F.coalesce(F.bool_or("__met"), F.lit(False)).alias("__met"))
    return met.filter(~F.col("__met") | F.col(polygon_key).isNull()).select(polygon_key)


def polygon_stats(survey: DataFrame, polygons: DataFrame, survey_key: str, polygon_key: str, keys: Sequence[str] = (), cutoff: int = 3, once: bool = False) -> DataFrame:
    """Mean and least polygon area per survey row with a match, for all and for certain polygons.

    Polygons are added up by key and then by place, and survey rows add up their places, so there are no pairs but those of polygon keys at several places. Where every key names
    one row (``once``), polygons are added up by place at once.
    """
    at, left, right = _places(survey, polygons, survey_key, polygon_key, keys, once)
    sure, area = F.col("certainty") >= cutoff, F.col("polygon_area_m2")
    parts = {"__n": F.sum, "__top": F.max, "__sum": F.sum, "__count": F.sum, "__sum_hc": F.sum, "__count_hc": F.sum, "__min": F.min, "__min_hc": F.min}
    added = [how(c).alias(c) for c, how in parts.items()]
    high = F.when(sure, area)
    if once:
        each = {"__n": F.lit(1).cast("long"), "__top": F.col("certainty"), "__sum": area, "__count": area.isNotNull().cast("long"), "__sum_hc": high, "__count_hc": high.isNotNull().cast("long"), "__min": area, "__min_hc": high}
        rows = right.filter(F.col("__at").isNotNull()).select("__at.*", *[c.alias(n) for n, c in each.items()])
        return _summed(left.join(rows.groupBy(*at).agg(*added), at).select(survey_key, *parts), survey_key, added)
    drawn = right.filter(F.col(polygon_key).isNotNull()).groupBy(polygon_key).agg(
        F.collect_set("__at").alias("__places"), F.count("*").alias("__n"), F.max("certainty").alias("__top"), F.sum(area).alias("__sum"), F.count(area).alias("__count"),
        F.sum(high).alias("__sum_hc"), F.count(high).alias("__count_hc"), F.min(area).alias("__min"), F.min(high).alias("__min_hc"))
    several = F.size("__places") > 1
    where = lambda part: part.withColumn("__at", F.explode("__places")).select(polygon_key, "__at.*", *parts)
    single = left.join(where(drawn.filter(~several)).groupBy(*at).agg(*added), at).select(survey_key, *parts)
    pairs = left.join(where(drawn.filter(several)), at).dropDuplicates([survey_key, polygon_key]).select(survey_key, *parts)
    return _summed(single.unionByName(pairs), survey_key, added)


def _summed(met: DataFrame, survey_key: str, added: Sequence[Column]) -> DataFrame:
    c = F.col
    return met.groupBy(survey_key).agg(*added).select(
        survey_key, c("__n").alias("n_polygons"), c("__top").alias("max_certainty"),
        F.try_divide("__sum", "__count").alias("poly_avg_size"), F.try_divide("__sum_hc", "__count_hc").alias("poly_avg_size_hc"),
        c("__min").alias("poly_min_size"), c("__min_hc").alias("poly_min_size_hc"))


def consistency_issues(rows: DataFrame) -> DataFrame:
    """One row per broken rule between the survey code and its polygons.

    Input: one row per survey answer with ``irrigation``, ``n_polygons`` and
    ``max_certainty`` (NULL without polygons).
    """
    n = F.coalesce(F.col("n_polygons"), F.lit(0))
    code, top = F.col("irrigation"), F.col("max_certainty")
    rules = [
        (1, (code == 1) & (n > 0)),
        (2, (code > 1) & (n == 0)),
        (3, (code == 5) & ((n == 0) | (top < 5))),
        (4, code.isin(2, 3, 4) & (n > 0) & (top > 4)),
    ]
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(i)) for i, cond in rules]))
    return rows.withColumn("rule", F.explode(broken))


def issue_message(row: str = "line") -> Column:
    """Report line of a broken rule; the wording, spelling included, is a fixed value of the report format."""
    where = F.format_string("Row %d (internal_id %d, %d/%d/%d): ", F.col(row), "internal_id", "day", "month", "year")
    code = F.col("irrigation").cast("string")
    n = F.coalesce(F.col("n_polygons"), F.lit(0)).cast("string")
    text = (
        F.when(F.col("rule") == 1, F.concat(F.lit(
            "survey marked irrigation as 1 (no irrigation) but found "), n, F.lit(" matching polygon(s).")))
        .when(F.col("rule") == 2, F.concat(F.lit("survey marked irrigation "), code, F.lit(
            " (possible irrigation) but no matching polygons found.")))
        .when(F.col("rule") == 3, F.lit(
            "survey marked irrigation 5 (definitely irrgation) but no polygon with certainty 5 found."))
        .otherwise(F.concat(F.lit("survey marked irrigation "), code, F.lit(
            " (uncertain) but found a polygon with certainty 5 (certain).")))
    )
    return F.concat(where, text)


def repair_internal_id(polygons: DataFrame, survey: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Internal id from the survey (its own bundle, with ``keys``) where the polygon carries the site number; operator from the file name.

    Rows without a site stay as they are.
    """
    ids = survey.groupBy("site_id", *keys).agg(F.max("internal_id").alias("__fixed"))
    wrong = F.col("internal_id") == site_number()
    return (
        polygons.join(ids, ["site_id", *keys], "left")
        .withColumn("internal_id", F.when(wrong, F.coalesce("__fixed", "internal_id")).otherwise(F.col("internal_id")))
        .withColumn("operator_initials", final_operator())
        .drop("__fixed")
    )


def attach_survey_info(polygons: DataFrame, survey: DataFrame, info: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Site-level columns onto polygons by site, internal id and date, and ``keys``."""
    keys = ["site_id", "internal_id", *DATE, *keys]
    return polygons.join(survey.select(*keys, *info).distinct(), keys, "left")


def version_class(source_file="source_file") -> Column:
    """1 corrected second version, 2 corrected, 3 uncorrected second version, 4 the rest."""
    s = F.col(source_file)
    return (
        F.when(s.rlike(r"^[A-Z]+_[A-Z]+_v2"), 1)
        .when(s.rlike(r"^[A-Z]+_[A-Z]+_") & ~s.contains("v2"), 2)
        .when(s.rlike(r"^[A-Z]+_v2"), 3)
        .otherwise(4)
    )


def latest_versions(
    rows: DataFrame, always_in: Sequence[str] = tuple(ALWAYS_IN), always_out: str = ALWAYS_OUT
) -> DataFrame:
    """Rows of the best version class of each plot file, plus hand-made includes and excludes.

    The class is decided on the distinct (plot file, source file) list; the label
    rows themselves are only filtered by a join, never sorted per plot file.
    """
    files = rows.select("plot_file", "source_file").distinct().withColumn("__class", version_class())
    best = files.groupBy("plot_file").agg(F.min("__class").alias("__best"))
    keep = files.join(best, "plot_file").filter(
        (F.col("__class") == F.col("__best")) | F.col("source_file").isin(*always_in)
    ).filter(~F.col("source_file").contains(always_out)).select("plot_file", "source_file")
    return rows.join(keep, ["plot_file", "source_file"]).withColumn("most_recent", F.lit(1))


def drop_repeats(rows: DataFrame, tie: Sequence[str] = ("unique_id",)) -> DataFrame:
    """One row per image and labeler, the lowest image number."""
    return first_per_key(rows, [image_id(), "operator_initials"], ["image_number", *tie])


def one_per_image(rows: DataFrame, priority, key: str = "image_id", tie: str = "unique_id", unknown: int = 1_000_000) -> DataFrame:
    """One row per image by labeler priority (lower wins); the map is a parameter."""
    return first_per_key(rows, [key], [by_priority("operator_initials", priority, unknown), tie])


def assessed_labelers(polygons: DataFrame, assessed: DataFrame) -> DataFrame:
    """(image, labeler) pairs that get a label raster.

    Labelers with polygons; for images nobody drew on, every labeler of the table.
    """
    drawn = polygons.select("image_id", "operator_initials").distinct().withColumn("has_polygons", F.lit(True))
    empty = (
        assessed.select("image_id", "operator_initials").distinct()
        .join(drawn.select("image_id").distinct(), "image_id", "left_anti")
        .withColumn("has_polygons", F.lit(False))
    )
    return drawn.unionByName(empty)


def rule_split(rows: DataFrame, ps_surveys: Sequence[str], extra_surveys: Sequence[str], ps_first, train_order) -> DataFrame:
    """Test base, its duplicates, extra test surveys and train, by survey membership.

    ``split`` is ``test_base``, ``test_duplicates``, ``test_extra`` or ``train``;
    train and the extra surveys keep one row per image.
    """
    in_ps = contains_any("source_file", ps_surveys)
    in_extra = contains_any("source_file", extra_surveys)
    ps = rows.filter(in_ps)
    base = one_per_image(ps, ps_first)
    dup = ps.join(base.select("unique_id"), "unique_id", "left_anti")
    extra = one_per_image(rows.filter(in_extra), train_order)
    train = one_per_image(rows.filter(~in_ps & ~in_extra), train_order)
    out = None
    for name, part in (("test_base", base), ("test_duplicates", dup), ("test_extra", extra), ("train", train)):
        part = part.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out

