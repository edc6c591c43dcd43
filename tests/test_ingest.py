"""Restartable ingest."""

from fieldweave.streaming.ingest import ingest_new_files


def test_only_new_files_and_keys(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    schema = "site string, v int"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).coalesce(1).write.mode("append").parquet(src)
    ingest_new_files(spark, src, schema, out, chk, ["site"])
    spark.createDataFrame([("b", 9), ("c", 3)], schema).coalesce(1).write.mode("append").parquet(src)
    ingest_new_files(spark, src, schema, out, chk, ["site"])
    ingest_new_files(spark, src, schema, out, chk, ["site"])
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2), ("c", 3)]
