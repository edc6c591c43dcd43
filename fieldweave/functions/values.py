"""Small value rules: classes, ratios, missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import _c

# Coverage categories, code names, labeler priorities, centroids.
CATEGORIES = ["tree_crop", "industrial", "lawn", "covered", "small-scale"]
CODE_NAMES = {
    1: "No irrigation",
    2: "Low certainty",
    3: "Medium certainty",
    4: "High certainty",
    5: "Very high certainty",
}
PRIORITY_REPORT = {"KL": 1, "MV": 2, "DSB": 3, "JL": 4}
PRIORITY_TRAIN = {"KL": 1, "MV": 2, "DSB": 3, "JL": 4, "AB": 5}
PRIORITY_PS_FIRST = {"PS": 0, "DSB": 1, "JL": 2, "KL": 3, "MV": 4, "AB": 5}
WEIGHT_MODEL = {"KL": 5, "MV": 4, "DSB": 3, "JL": 2, "PS": 1, "AB": 1}
PROVINCE_CENTROIDS = {
    "Central": (28.5, -14.5), "Copperbelt": (27.8, -13.0), "Eastern": (32.0, -13.5),
    "Luapula": (29.0, -11.0), "Lusaka": (28.7, -15.4), "Muchinga": (32.0, -11.5),
    "Northern": (31.3, -10.0), "North-Western": (25.0, -13.0), "Southern": (27.0, -16.5),
    "Western": (23.5, -15.0),
}
INDUSTRIAL_MIN_M2 = 100_000.0


def safe_div(a, b) -> Column:
    """a / b, zero when b is zero."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * p * r, p + r), F.lit(0.0))


def clamp(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


def lookup(c, table: Mapping, default=None) -> Column:
    """Literal map lookup; never a join."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    got = F.try_element_at(m, _c(c))
    return got if default is None else F.coalesce(got, F.lit(default))


def code_name(code="irrigation") -> Column:
    return lookup(code, CODE_NAMES, "Unknown")


def class_key(name) -> Column:
    """Lower case with underscores for blanks and dashes."""
    return F.regexp_replace(F.lower(_c(name)), "[ -]", "_")


def is_positive(code="irrigation", minimum: int = 2) -> Column:
    """1 when the code reaches the minimum: 2 for models, 3 for reports."""
    return (_c(code) >= minimum).cast("int")


def area_category(category="category", area="polygon_area_m2") -> Column:
    return F.when(
        (_c(category) == "small-scale") & (_c(area) > INDUSTRIAL_MIN_M2), F.lit("industrial")
    ).otherwise(_c(category))


def farm_class_m2(size, small: float = 500.0, medium: float = 5000.0) -> Column:
    s = _c(size)
    return (
        F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), "none").when(s < small, "smallholder")
        .when(s < medium, "medium").otherwise("large")
    )


def farm_class_ha(target, size_ha, small: float = 2.0, medium: float = 10.0) -> Column:
    s = _c(size_ha)
    return (
        F.when(_c(target) == 0, "none").when(s.isNull() | F.isnan(s) | (s <= 0), "unknown")
        .when(s < small, "smallholder").when(s < medium, "medium").otherwise("large")
    )


def nearest_centroid(x, y, centroids: Mapping[str, Sequence[float]] = PROVINCE_CENTROIDS) -> Column:
    """Name of the closest centroid by squared degrees to nine digits; ties by name.

    Without rounding the last bits would decide between equal distances. The centroids are a literal array, so there is no join at all.
    """
    options = F.array(*[
        F.struct(
            F.round((_c(x) - lon) * (_c(x) - lon) + (_c(y) - lat) * (_c(y) - lat), 9).alias("d"),
            F.lit(name).alias("name"),
        )
        for name, (lon, lat) in centroids.items()
    ])
    return F.array_min(options)["name"]


def log1p_or_zero(c) -> Column:
    return F.when(_c(c) == 0, F.lit(0.0)).otherwise(F.log1p(_c(c)))


def missing(c, *sentinels) -> Column:
    """NULL for the sentinel values of a source (0, -9999, -1) and for NaN."""
    col = _c(c)
    return F.when(~col.isin(*sentinels), col)


def shift_back_one_day(df, operator_col: str = "operator_initials", operator: str = "PS"):
    """One labeler's dates, written a day late, moved back; year, month, day rewritten."""
    from .keys import ymd_date

    moved = F.date_sub(ymd_date(), 1)
    hit = F.col(operator_col) == operator
    return df.withColumns({
        "year": F.when(hit, F.year(moved)).otherwise(F.col("year")),
        "month": F.when(hit, F.month(moved)).otherwise(F.col("month")),
        "day": F.when(hit, F.dayofmonth(moved)).otherwise(F.col("day")),
    })


def contains_any(c, needles: Sequence[str]) -> Column:
    """True when the text holds any of the given substrings; false for NULL."""
    return F.coalesce(F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(_c(c), n)), F.lit(False))
