"""Elements of whole documents in the order in which they stand there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import _c


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def file_stem(path="path") -> Column:
    """File name without its ending."""
    return F.regexp_extract(_c(path), r"([^/]+?)(\.[^./]*)?$", 1)


def elements_in_order(files: DataFrame, tag: str, content: str = "content") -> DataFrame:
    """One row for each ``tag`` element of ``content``: ``position`` (from 0, as they stand in the file) and ``xml``. Other columns stay.

    Splitting a file by its elements, as row readers do, loses their order, and a sort by what they say is another order. So a file is one row until its elements are
    numbered. Comments hold no elements; files without any give no rows.
    """
    text = F.regexp_replace(F.col(content), r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"), F.lit(0))
    return files.select(*[c for c in files.columns if c not in (content, "position", "xml")], F.posexplode(found).alias("position", "xml"))
