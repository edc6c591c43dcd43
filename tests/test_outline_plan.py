"""Edges are counted after they are dealt, not in the tasks that make them."""

from fieldweave.operators import raster as RA


def test_edges_are_dealt_before_they_are_counted(spark):
    cells = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", 0, 1), ("b", 5, 5)], "file_id string, row int, col int")
    found = RA.outline(cells)
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    dealt = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line and "x1#" in line.split("hashpartitioning")[1]]
    assert len(dealt) == 1 and "Aggregate" not in lines[dealt[0] + 1]
    assert {r.file_id: r["count"] for r in found.groupBy("file_id").count().collect()} == {"a": 6, "b": 4}
