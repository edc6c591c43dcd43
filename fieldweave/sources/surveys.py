"""Survey answer documents (XML, one per site) to label rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import _c, operator_from_path
from .elements import elements_in_order, whole_files

SLOTS = 10


def _coded(name: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType())])


SURVEY_SCHEMA = T.StructType(
    [
        T.StructField("id", _coded("value")),
        T.StructField("location", T.StructType([
            T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("srs", T.StringType())])),
        T.StructField("operator", _coded("value")),
        T.StructField("plot_file", _coded("value")),
        T.StructField("natural_dicoloration", _coded("value")),
    ]
    + [
        T.StructField(f"{what}{i}", _coded("value" if what == "day" else "code"))
        for i in range(1, SLOTS + 1) for what in ("year", "month", "day", "irrigation")
    ]
)


def read_surveys(spark: SparkSession, path: str, row_tag: str = "plot") -> DataFrame:
    """Documents of a folder with their path; the operator comes from the bundle folder."""
    return (
        spark.read.format("xml").option("rowTag", row_tag).schema(SURVEY_SCHEMA).load(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )


#: Columns that say where a document comes from; kept where they are given.
PLACE = ("source_file", "position")


def bundle_of(path="path"):
    """Name of the bundle folder, two levels above the survey document."""
    return F.element_at(F.split(_c(path), "/"), -3)


def read_survey_files(spark: SparkSession, path: str, row_tag: str = "plot") -> DataFrame:
    """Documents of whole files with ``path``, ``source_file`` (the bundle folder) and ``position`` in the file."""
    return surveys_in_order(whole_files(spark, path).withColumn("source_file", bundle_of()), row_tag)


def surveys_in_order(files: DataFrame, row_tag: str = "plot") -> DataFrame:
    """The same from rows with ``content``."""
    return parse_surveys(elements_in_order(files, row_tag), row_tag=row_tag)


def parse_surveys(docs: DataFrame, xml: str = "xml", path: str = "path", row_tag: str = "plot") -> DataFrame:
    """The same documents from a text column."""
    own = [c for c in PLACE if c in docs.columns]
    return docs.select(path, *own, F.from_xml(F.col(xml), SURVEY_SCHEMA.simpleString(), {"rowTag": row_tag}).alias("d")).select("d.*", F.col(path).alias("path"), *own)


def read_survey_bundles(spark: SparkSession, path: str) -> DataFrame:
    """XML text of every document inside zip bundles: one row (path, xml) per document."""
    return unpack_bundles(spark.read.format("binaryFile").load(path).select("path", "content"))


def unpack_bundles(blobs: DataFrame) -> DataFrame:
    """Bundles are unpacked in the tasks that hold them, one document at a time."""

    def unpack(batches):
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            docs = []
            for name, content in zip(pdf["path"], pdf["content"]):
                stem = name[:-4] if name.endswith(".zip") else name
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    docs += [(f"{stem}/{e}", z.read(e).decode("utf-8", "replace")) for e in z.namelist() if e.endswith(".xml")]
                if len(docs) >= 1000:
                    yield pd.DataFrame(docs, columns=["path", "xml"])
                    docs = []
            yield pd.DataFrame(docs, columns=["path", "xml"])

    return blobs.mapInPandas(unpack, "path string, xml string")


def answer_rows(docs: DataFrame) -> DataFrame:
    """The ten answer slots as rows; kept with a real date and a code."""
    slots = F.array(*[
        F.struct(
            F.lit(i).alias("image_number"),
            F.col(f"year{i}.code").alias("y"), F.col(f"month{i}.code").alias("m"), F.col(f"day{i}.value").alias("d"),
            F.col(f"irrigation{i}.code").alias("irrigation"),
        )
        for i in range(1, SLOTS + 1)
    ])
    own = [c for c in PLACE if c in docs.columns]
    rows = docs.select(
        F.col("id.value").alias("site_id"), F.col("plot_file.value").alias("plot_file"), F.col("operator.value").alias("operator"),
        operator_from_path("path").alias("operator_initials"), F.col("location.x").alias("x"), F.col("location.y").alias("y"),
        F.col("natural_dicoloration.value").alias("water_source"), "path", *own, F.explode(slots).alias("s"),
    )
    date = valid_date("s.y", "s.m", "s.d")
    return rows.withColumn("__date", date).filter(F.col("__date").isNotNull() & F.col("s.irrigation").isNotNull()).select(
        "site_id", "plot_file", "operator", "operator_initials", "x", "y", "water_source", F.col("s.image_number").alias("image_number"),
        F.year("__date").alias("year"), F.month("__date").alias("month"), F.dayofmonth("__date").alias("day"),
        F.col("s.irrigation").try_cast("int").alias("irrigation"), "path", *own,
    )


def valid_date(year: str, month: str, day: str):
    """DATE of three text fields with or without leading zeros; NULL otherwise."""
    return F.try_to_date(F.concat_ws("-", F.when(F.col(year).isNotNull() & F.col(month).isNotNull() & F.col(day).isNotNull(), F.col(year)), month, day), "yyyy-M-d")


def internal_ids(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """Internal id = line number of the site in its sample file; unknown sites are dropped.

    With ``plot_file`` in the sample, a site is looked up in the file that its row names; without it, the sample is one file.
    """
    own = ["plot_file"] if "plot_file" in sample.columns else []
    first = sample.groupBy(F.col("id").alias("site_id"), *own).agg(F.min("line_no").alias("internal_id"))
    return rows.join(first, ["site_id", *own]).select(*rows.columns, "internal_id")


def internal_id_from_name(path: str = "path"):
    """Fallback without a sample file: the file stem."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1).try_cast("int")
