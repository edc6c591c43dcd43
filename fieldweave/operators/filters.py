"""Filters and rule checks on tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_operators(rows: DataFrame, operators: Sequence[str], col: str = "operator_initials") -> DataFrame:
    return rows.filter(F.col(col).isin(*operators))


def min_certainty(polygons: DataFrame, least: int = 3, col: str = "certainty") -> DataFrame:
    """Polygons at or above a certainty; all of them, with a warning, when the column is absent."""
    if col not in polygons.columns:
        warnings.warn(f"no {col!r} column: every polygon is kept", stacklevel=2)
        return polygons
    return polygons.filter(F.col(col) >= least)


def grid_filter(grid: DataFrame, threshold: float, country: str = "All") -> DataFrame:
    """Cells with cropland above the threshold, of one country or of all."""
    out = grid.filter((F.col("agriculture") > 0) & (F.col("agriculture") > threshold))
    return out if country == "All" else out.filter(F.col("country") == country)


def dashboard_filter(rows: DataFrame, coverage: str = "avg_percent_coverage", certainty: str = "avg_certainty",
                     years: tuple[int, int] | None = None, least_certainty: float | None = None,
                     water_source: str = "All", show_zero: bool = True, province: str = "All Provinces") -> DataFrame:
    """The optional filters of the map and time-series views."""
    if not show_zero:
        rows = rows.filter(F.col(coverage) > 0)
    if water_source != "All":
        rows = rows.filter(F.col("water_source") == water_source)
    if years is not None:
        rows = rows.filter(F.col("year").between(*years))
    if least_certainty is not None:
        rows = rows.filter(F.col(certainty) >= least_certainty)
    if province != "All Provinces":
        rows = rows.filter(F.col("province") == province)
    return rows


def latest_with_warnings(issues: DataFrame, latest: DataFrame) -> DataFrame:
    """Warnings per survey file, latest files only."""
    return issues.join(latest, "source_file", "left_semi").groupBy("source_file").agg(F.count("*").alias("n_warnings"))


def not_latest(files: DataFrame, latest: DataFrame) -> DataFrame:
    """Files outside the latest set."""
    return files.distinct().join(latest, "source_file", "left_anti")


def duplicate_coordinates(rows: DataFrame) -> DataFrame:
    """Sites that carry more than one coordinate pair."""
    return rows.groupBy("site_id").agg(F.countDistinct(F.struct("x", "y")).alias("n_unique_coords")).filter("n_unique_coords > 1")


def repeated_ids(rows: DataFrame, col: str) -> DataFrame:
    return rows.groupBy(col).agg(F.count("*").alias("n")).filter("n > 1")


def split_alarms(stats: DataFrame, least_sites: int = 30, least_industrial: int = 5) -> DataFrame:
    """Flags of splits too small to trust."""
    return stats.withColumns({
        "few_irrigated_sites": F.col("irrigated_sites") < least_sites,
        "few_industrial": F.col("industrial") < least_industrial,
    })


def choice_list(rows: DataFrame, col: str, all_entry: str) -> DataFrame:
    """Sorted distinct values under an All entry."""
    spark = rows.sparkSession
    head = spark.range(1).select(F.lit(all_entry).alias("choice"), F.lit(0).alias("__o"))
    body = rows.select(F.col(col).alias("choice")).distinct().withColumn("__o", F.lit(1))
    return head.unionByName(body).orderBy("__o", "choice").drop("__o")
