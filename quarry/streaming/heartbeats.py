"""Replay of a folder of heartbeats through a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.scratch import scratch
from quarry.streaming.watch import latest_beats


def replay(spark: SparkSession, path: str) -> DataFrame:
    """(id, last_heartbeat) after all files have gone through the stream; state and result lie in the shared folder."""
    schema = spark.read.parquet(path).schema
    folder = scratch(spark, f"watch-{uuid.uuid4().hex[:6]}")
    reader = spark.readStream.schema(schema)
    # a single file is watched through its folder
    stream = reader.option("pathGlobFilter", path.rsplit("/", 1)[-1]).parquet(path.rsplit("/", 1)[0]) if _is_file(spark, path) else reader.parquet(path)
    beats = latest_beats(stream.select(F.col("user_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts")))

    def keep(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{folder}/result")

    run = beats.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    # updates of later batches win, and beats only grow
    return spark.read.parquet(f"{folder}/result").groupBy("id").agg(F.max("last_heartbeat").alias("last_heartbeat"))


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
