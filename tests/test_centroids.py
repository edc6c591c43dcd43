"""Equal distances are equal whatever their last bits."""

from fieldweave.functions import values as V


def test_equally_near_centroids_go_by_name(spark):
    """0.1 + 0.2 is not 0.3: the last bits of equal distances differ."""
    at = spark.createDataFrame([(0.3, 0.0)], "x double, y double")
    near = V.nearest_centroid("x", "y", {"b": (0.2, 0.0), "a": (0.4, 0.0)})
    assert at.select(near.alias("n")).first()["n"] == "a"
