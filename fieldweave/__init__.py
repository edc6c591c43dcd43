"""Table operators for land-observation labels and features on Apache Spark.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
inside an operator, so the same call works on a laptop sample and on a cluster.
"""

__version__ = "0.1.0"
