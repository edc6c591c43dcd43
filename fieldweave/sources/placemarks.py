"""Placemark (KML) and GeoJSON polygons to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import _c, placemark_parts
from .elements import elements_in_order, file_stem, whole_files

_TEXT = T.StringType()


def _nest(*names: str) -> T.DataType:
    inner: T.DataType = _TEXT
    for n in reversed(names):
        inner = T.StructType([T.StructField(n, inner)])
    return inner


PLACEMARK_SCHEMA = T.StructType([
    T.StructField("name", _TEXT),
    T.StructField("description", _TEXT),
    T.StructField("Point", _nest("coordinates")),
    T.StructField("LineString", _nest("coordinates")),
    T.StructField("Polygon", _nest("outerBoundaryIs", "LinearRing", "coordinates")),
])

FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>"
COLLECTION_SCHEMA = f"type string, features array<{FEATURE}>"


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("xml").option("rowTag", "Placemark").schema(PLACEMARK_SCHEMA).load(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def read_placemark_files(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of whole files with ``path``, ``source_file`` (its stem) and ``position`` in the file."""
    return placemarks_in_order(whole_files(spark, path).withColumn("source_file", file_stem()))


def placemarks_in_order(files: DataFrame) -> DataFrame:
    """The same from rows with ``content``."""
    return parse_placemarks(elements_in_order(files, "Placemark"))


def parse_placemarks(df: DataFrame, xml: str = "xml") -> DataFrame:
    """The same from a text column; other columns stay."""
    return df.withColumn("__p", F.from_xml(F.col(xml), PLACEMARK_SCHEMA.simpleString(), {"rowTag": "Placemark"})).select(
        *[c for c in df.columns if c != xml], "__p.*")


def ring_of(text) -> Column:
    """``lon,lat[,alt] ...`` to a ring; NULL for NULL."""
    parts = F.filter(F.split(_c(text), r"\s+"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        F.element_at(F.split(p, ","), 1).try_cast("double").alias("lon"), F.element_at(F.split(p, ","), 2).try_cast("double").alias("lat")))


def placemark_rows(raw: DataFrame) -> DataFrame:
    """Named polygons with their parsed name and ring.

    ``geometry_status`` is ``ok`` or ``no_outer_ring``; points, lines and unnamed
    placemarks are skipped.
    """
    ring = ring_of("Polygon.outerBoundaryIs.LinearRing.coordinates")
    named = raw.filter(
        F.col("name").isNotNull() & (F.col("name") != "") & F.col("Point").isNull() & F.col("LineString").isNull() & F.col("Polygon").isNotNull())
    rest = [c for c in raw.columns if c not in ("Point", "LineString", "Polygon")]
    return named.select(*rest, placemark_parts("name").alias("__n"), ring.alias("ring")).select(
        *rest, "__n.*", "ring", F.when(F.col("ring").isNull(), "no_outer_ring").otherwise("ok").alias("geometry_status"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows from either layout: one feature a line (as ``write_geojson`` makes) or one collection a file. Anything else is an error.

    The first line that is not blank tells the layout, so files of both kinds are read apart.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.get_json_object("value", "$.type").alias("kind")).first()
    if first is not None and first["kind"] == "Feature":
        rows = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", FEATURE).alias("f"))
        good = F.when(F.col("f.type") == "Feature", F.col("f")).otherwise(F.raise_error(F.lit("a line is no GeoJSON feature")).cast(FEATURE))
        return feature_columns(rows.select(good.alias("f")))
    docs = spark.read.schema(COLLECTION_SCHEMA).option("multiLine", True).json(path)
    good = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(F.raise_error(F.lit("a file is no GeoJSON collection")).cast(f"array<{FEATURE}>"))
    return feature_rows(docs.withColumn("features", good))


def parse_geojson(df: DataFrame, text: str = "json") -> DataFrame:
    return feature_rows(df.withColumn("__j", F.from_json(text, COLLECTION_SCHEMA)).select(*[c for c in df.columns if c != text], "__j.features"))


def feature_rows(docs: DataFrame) -> DataFrame:
    """Properties (a text map) and the outer ring of every feature."""
    rest = [c for c in docs.columns if c not in ("type", "features")]
    return feature_columns(docs.select(*rest, F.explode("features").alias("f")))


def feature_columns(f: DataFrame) -> DataFrame:
    rest = [c for c in f.columns if c != "f"]
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return f.select(*rest, F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("geometry_type"), ring.alias("ring"))
