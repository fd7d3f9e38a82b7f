"""Row numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.scratch import scratch


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``row``, from 0 in ``order`` (which tells all rows apart).

    Rows are dealt by ranges and written once; then the ranges' sizes, one row each, are summed up and
    rows are numbered inside their range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "numbered")
    df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    # one row per range, so the broadcast is bounded by the number of ranges
    return ranged.join(F.broadcast(ahead), "_part").withColumn("row", (F.col("_ahead") + inside).cast("long")).drop("_part", "_ahead")
