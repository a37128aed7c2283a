"""Settings of a session that results and memory rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between Spark and Python; texts may be long, so rows alone don't bound it.
BATCH_BYTES = "4m"


def prepare(spark: SparkSession) -> SparkSession:
    """Sets what the library needs of a session; the views, tables and unions of this repository start with it.

    Spark 4.1 lets a union of equally partitioned inputs count as partitioned by their keys, and a
    grouping on those keys then goes without a shuffle; adaptive execution may have merged the inputs'
    partitions in different ways, which splits groups. That is switched off.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark
