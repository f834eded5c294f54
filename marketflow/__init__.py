"""marketflow: Spark-native market-data and investor-profiling operators.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, joins, windows and aggregates (writers and model
fitting excepted).  See README.md for the operator map.
"""

from marketflow.session import get_spark, scratch_path

__all__ = ["get_spark", "scratch_path"]
