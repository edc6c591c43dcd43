"""CSV tables, folders, window metadata, id lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_SCHEMA = (
    "unique_id bigint, site_id string, internal_id int, plot_file string, operator string, operator_initials string, x double, y double, "
    "water_source string, image_number int, year int, month int, day int, irrigation int, percent_coverage double, percent_coverage_hc double, "
    "poly_avg_size double, poly_avg_size_hc double, poly_min_size double, poly_min_size_hc double, source_file string, most_recent int"
)
GRID_SCHEMA = "id string, latitude double, longitude double, agriculture double, country string"
WINDOW = "struct<date_range:array<string>,file_exists:boolean,masked_fraction:double,item_id:string,cloud_cover:double>"
METADATA_SCHEMA = f"file_id string, lat double, lon double, year int, collection string, timestep_days int, windows array<{WINDOW}>, _corrupt_record string"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a fixed schema; a column of the wrong type fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def comparison_inputs(spark: SparkSession, table: str, polygons: str, images: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The label table and the two GeoJSON inputs of a labeler comparison."""
    from .placemarks import read_geojson

    return read_table(spark, table, LABEL_SCHEMA), read_geojson(spark, polygons), read_geojson(spark, images)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of every part; columns a part lacks are NULL. No parts is an error."""
    if not parts:
        raise ValueError("nothing to read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every CSV of a folder as one table, with the file name as provenance."""
    df = spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    if not df.inputFiles():
        raise FileNotFoundError(f"no CSV file under {path}")
    return df.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def read_window_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per window of every readable stack record; broken files are left out."""
    docs = spark.read.schema(METADATA_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return window_rows(docs.filter(F.col("_corrupt_record").isNull()))


def parse_window_metadata(df: DataFrame, text: str = "json") -> DataFrame:
    docs = df.select(F.from_json(text, METADATA_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("d")).select("d.*")
    return window_rows(docs.filter(F.col("_corrupt_record").isNull()))


def window_rows(docs: DataFrame) -> DataFrame:
    """A stack without windows keeps one row with NULL t."""
    w = docs.select("file_id", F.posexplode_outer("windows").alias("t", "w"))
    return w.select(
        "file_id", "t", F.to_date(F.col("w.date_range")[0]).alias("start"), F.to_date(F.col("w.date_range")[1]).alias("end"),
        F.col("w.file_exists").alias("file_exists"), F.col("w.masked_fraction").alias("masked_fraction"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, trimmed, blanks dropped."""
    return clean_ids(spark.read.text(path), "value")


def clean_ids(lines: DataFrame, col: str) -> DataFrame:
    return lines.select(F.trim(col).alias("id")).filter(F.col("id") != "")
