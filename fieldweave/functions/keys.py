"""Identifiers, dates and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the label project.
SITE_PREFIX = "id_"
SURVEY_RANGE = r"(\d+-\d+)"
STEM = r"^(\d+)_(\d+)_(\d{4}\.\d{2}\.\d{2})_(image|label)$"
RAW_IMAGE = r"(?i)^(?:site_[^_]+_[^_]+_\d{4}_(\d+)|(\d+)_\d+_\d{4}\.\d{2}\.\d{2}_image)\.(tif|json)$"
RAW_MASK = r"(?i)^(\d+?)_(\d+)_(\d{4}\.\d{2}\.\d{2})(?:_[A-Za-z]+)?_label(?:_metadata)?\.(tif|json)$"
SHOT_UNDERSCORE = r"^(\d+-\d+)_(\d+)_(\d+)-(\d+)-(\d+)"
SHOT_DASH = r"^(\d+-\d+)_(\d+)-(\d+)-(\d+)-(\d+)"
YEAR_PIVOT = 50


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pad2(c) -> Column:
    return F.lpad(_c(c).cast("string"), 2, "0")


def ymd_date(year="year", month="month", day="day") -> Column:
    """DATE of three integer columns; NULL when the three are no calendar day."""
    text = F.concat(
        F.lpad(_c(year).cast("string"), 4, "0"), F.lit("-"), _pad2(month), F.lit("-"), _pad2(day)
    )
    return F.try_to_date(text, "yyyy-MM-dd")


def image_id(site="site_id", year="year", month="month", day="day") -> Column:
    """``site_YYYY-MM-DD``."""
    return F.concat(
        _c(site), F.lit("_"), _c(year).cast("string"), F.lit("-"), _pad2(month), F.lit("-"), _pad2(day)
    )


def file_id(site="site_id", year="year", month="month", day="day") -> Column:
    """``site_YYYY.MM.DD`` without the site prefix."""
    return F.concat(
        F.replace(_c(site), F.lit(SITE_PREFIX), F.lit("")),
        F.lit("_"), _c(year).cast("string"), F.lit("."), _pad2(month), F.lit("."), _pad2(day),
    )


def regex_or_null(text, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that yields NULL, not '', when nothing matches."""
    return F.when(_c(text).rlike(pattern), F.nullif(F.regexp_extract(_c(text), pattern, group), F.lit("")))


def survey_id(source_file="source_file") -> Column:
    return regex_or_null(source_file, SURVEY_RANGE)


def range_start(survey) -> Column:
    """Number before the dash, for sorting survey ranges as numbers."""
    return F.element_at(F.split(_c(survey), "-"), 1).try_cast("int")


def site_number(site="site_id") -> Column:
    return F.replace(_c(site), F.lit(SITE_PREFIX), F.lit("")).try_cast("int")


def final_operator(source_file="source_file") -> Column:
    """First initials of the file name once the version mark is gone."""
    return F.element_at(F.split(F.replace(_c(source_file), F.lit("_v2_"), F.lit("_")), "_"), 1)


def operator_from_path(path) -> Column:
    """Initials of the bundle folder, two levels above the survey document."""
    return F.element_at(F.split(F.element_at(F.split(_c(path), "/"), -3), "_"), 1)


def screenshot_parts(filename) -> Column:
    """Struct(survey, internal_id, month, day, year) of a screenshot name, or NULL."""
    name = F.regexp_replace(F.regexp_replace(_c(filename), r"^.*/", ""), r"\.[^.]*$", "")

    def part(i: int) -> Column:
        return F.coalesce(regex_or_null(name, SHOT_UNDERSCORE, i), regex_or_null(name, SHOT_DASH, i))

    yy = part(5).try_cast("int")
    return F.when(
        part(1).isNotNull(),
        F.struct(
            part(1).alias("survey"),
            part(2).try_cast("int").alias("internal_id"),
            part(3).try_cast("int").alias("month"),
            part(4).try_cast("int").alias("day"),
            (yy + F.when(yy < YEAR_PIVOT, 2000).otherwise(1900)).alias("year"),
        ),
    )


def stem_parts(stem) -> Column:
    """Struct(uid, site, date, kind) of a standard stem, or NULL."""
    s = _c(stem)
    return F.when(
        s.rlike(STEM),
        F.struct(*[F.regexp_extract(s, STEM, i).alias(n)
                   for i, n in enumerate(("uid", "site", "date", "kind"), 1)]),
    )


def raw_image_parts(name) -> Column:
    s = _c(name)
    return F.when(
        s.rlike(RAW_IMAGE),
        F.struct(
            F.coalesce(regex_or_null(s, RAW_IMAGE, 1), regex_or_null(s, RAW_IMAGE, 2)).alias("uid"),
            F.lower(F.regexp_extract(s, RAW_IMAGE, 3)).alias("ext"),
        ),
    )


def raw_mask_parts(name) -> Column:
    s = _c(name)
    return F.when(
        s.rlike(RAW_MASK),
        F.struct(
            F.regexp_extract(s, RAW_MASK, 1).alias("uid"),
            F.regexp_extract(s, RAW_MASK, 2).alias("site"),
            F.regexp_extract(s, RAW_MASK, 3).alias("date"),
            F.lower(F.regexp_extract(s, RAW_MASK, 4)).alias("ext"),
        ),
    )


def pair_id(stem) -> Column:
    """Stem without its ``_image`` / ``_label`` / ``_XX_label`` ending."""
    s = F.regexp_replace(_c(stem), r"_[A-Za-z]+_label$", "")
    s = F.regexp_replace(s, r"_label$", "")
    return F.regexp_replace(s, r"_image$", "")


def placemark_parts(name) -> Column:
    """Struct of a placemark name ``AB_3_9.6.2021``.

    ``parse_status`` is ``ok``, ``year_fixed`` (two digits, century added),
    ``year_odd`` (neither two nor four digits), ``date_parts`` (the date has not
    three parts) or ``error``. The three date fields are NULL for the last two:
    the untouched name stays next to them for repair by hand.
    """
    bits = F.split(F.trim(_c(name)), "_")
    date_bits = F.split(F.try_element_at(bits, F.lit(3)), r"\.")
    number = F.try_element_at(bits, F.lit(2)).try_cast("int")
    month, day, year = (F.try_element_at(date_bits, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    three = F.size(date_bits) == 3
    digits = F.length(year.cast("string"))
    broken = (
        (F.size(bits) < 3) | number.isNull()
        | (three & (month.isNull() | day.isNull() | year.isNull()))
    )
    status = (
        F.when(broken, "error")
        .when(~three, "date_parts")
        .when(digits == 4, "ok")
        .when(digits == 2, "year_fixed")
        .otherwise("year_odd")
    )
    good = ~broken & three
    return F.struct(
        F.when(~broken, F.upper(F.element_at(bits, 1))).alias("operator_initials"),
        F.when(~broken, number).alias("internal_id"),
        F.when(good, month).alias("month"),
        F.when(good, day).alias("day"),
        F.when(good, F.when(digits == 2, year + 2000).otherwise(year)).alias("year"),
        status.alias("parse_status"),
    )


def hash_key(seed: int, *ids) -> Column:
    """Hex digest that orders rows as if shuffled; equal on every engine and cluster."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *[_c(i).cast("string") for i in ids]))


def hash_uniform(seed: int, *ids) -> Column:
    """Uniform number in [0, 1) from the first 12 hex digits of ``hash_key``."""
    digits = F.conv(F.substring(hash_key(seed, *ids), 1, 12), 16, 10).cast("double")
    return digits / F.lit(float(16**12))


def hash_normal(seed: int, *ids) -> Column:
    """Standard normal number by Box-Muller from two hashed uniforms."""
    u = hash_uniform(seed, *ids, F.lit("a"))
    v = hash_uniform(seed, *ids, F.lit("b"))
    return F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(2.0 * F.pi() * v)
