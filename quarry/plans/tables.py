"""The driver's tables seen as the engine's: documents as sources, embeddings as vectors, events as heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, content): a path for each document."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("source"), F.col("text").alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("type"), F.concat(F.lit("src"), F.pmod("vec_id", F.lit(20)).cast("string")).alias("source_id"))


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tracked files."""
    rows = sources(spark, sf_dir)
    return rows.select("doc_id", F.col("source").alias("path"), (F.col("doc_id") * 7).alias("last_modified"), F.octet_length("content").cast("long").alias("file_size"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same folder some time later: a seventh gone, an eleventh touched, a thirteenth under new names."""
    rows = tracked(spark, sf_dir).where("pmod(doc_id, 7) <> 3")
    touched = F.when(F.pmod("doc_id", F.lit(11)) == 5, F.col("last_modified") + 1).otherwise(F.col("last_modified"))
    path = F.when(F.pmod("doc_id", F.lit(13)) == 6, F.concat(F.lit("new/"), "path")).otherwise(F.col("path"))
    return rows.select(path.alias("path"), touched.alias("last_modified"), "file_size")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as heartbeats of instances: (id, ts in seconds)."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
