"""Writers: tables with a side record, GeoJSON, reports, metric documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS_LINE = "All checks passed successfully."


def save_table(df: DataFrame, path: str, description: str, source: str, file_format: str = "parquet",
               mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """A table and, next to it, one JSON record of what it is and where it came from."""
    if file_format not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported format {file_format!r}")
    w = df.write.mode(mode).format(file_format)
    if file_format == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    record = df.sparkSession.range(1).select(
        F.current_timestamp().alias("date"), F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("file"),
        F.lit(description).alias("description"), F.lit(file_format).alias("file_format"), F.lit(source).alias("source"))
    record.coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "_metadata")


def geojson_feature(properties: Sequence[str], ring: str = "ring") -> Column:
    """One feature as text from a ring column and property columns."""
    coords = F.array(F.transform(ring, lambda p: F.array(p["lon"], p["lat"])))
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry")), {"ignoreNullFields": "false"})


def write_geojson(df: DataFrame, path: str, properties: Sequence[str], ring: str = "ring", mode: str = "overwrite") -> None:
    """Newline-delimited features, written in parallel; no file holds the whole collection."""
    df.select(geojson_feature(properties, ring).alias("value")).write.mode(mode).text(path)


def report_lines(surveys: DataFrame, messages: DataFrame, key: str = "source_file") -> DataFrame:
    """Messages per survey; one pass line for a survey without any."""
    return surveys.join(messages, key, "left").select(key, F.coalesce("message", F.lit(PASS_LINE)).alias("message"))


def write_report(lines: DataFrame, path: str, key: str = "source_file", mode: str = "overwrite") -> None:
    lines.write.mode(mode).partitionBy(key).text(path)


def metric_documents(metrics: DataFrame, level: str = "level") -> DataFrame:
    """Long metric rows (level, factor, category, class, metric, value) to one nested JSON document per level, keys in order."""
    names = ["factor", "category", "class", "metric"]
    rows = metrics.select(level, *names, F.col("value").alias("inner"))
    for depth in range(len(names), 0, -1):
        # Keys of a level are unique, so the order never reaches the values.
        entries = F.array_sort(F.collect_list(F.struct(F.col(names[depth - 1]).alias("key"), "inner")), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        rows = rows.groupBy(level, *names[:depth - 1]).agg(F.map_from_entries(entries).alias("inner"))
    return rows.select(level, F.to_json("inner").alias("document"))


def write_split(manifest: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One manifest, a folder per split and fold."""
    manifest.write.mode(mode).partitionBy("split", "fold").parquet(path)


def split_metadata(manifest: DataFrame) -> DataFrame:
    """Sites and files per split and fold."""
    return manifest.groupBy("split", "fold").agg(F.countDistinct("site").alias("sites"), F.count("*").alias("files"))


LABEL_BAND_NOTES = {
    "category": "1 small-scale, 2 tree crop, 3 industrial, 4 lawn, 5 covered",
    "irrigated": "1 where coverage is at least half",
    "unclear": "unclear signs of agriculture", "slightly_green": "only slightly green", "uneven": "uneven",
    "natural": "may naturally be green", "fishpond": "may be a fishpond",
    "certainty": "certainty 1 to 5", "coverage": "percent of the pixel covered",
}


def write_label_pixels(labels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Label pixels with a comment on every band, one folder per labeler."""
    noted = labels.select(*[
        F.col(f.name).alias(f.name, metadata={"comment": LABEL_BAND_NOTES[f.name]}) if f.name in LABEL_BAND_NOTES else F.col(f.name)
        for f in labels.schema.fields])
    noted.write.mode(mode).partitionBy("operator").parquet(path)


def unfinished(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys not yet in the finished table, for a restart that appends."""
    return todo.join(done.select(*keys), list(keys), "left_anti")
