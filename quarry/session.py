"""Session defaults for clusters and for a single machine."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarry.ship import ship

#: Bytes of one Arrow batch: texts differ in length a millionfold, so rows don't bound batches.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
DEFAULTS = BOUNDS | {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "quarry", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's defaults; a cluster's own settings are left as they are."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """For entry points that are given a session: workers know the package, and bounds that the session leaves open are set. Nothing else changes a caller's session."""
    ship(spark)
    for key in BOUNDS.keys() - spark.conf.getAll.keys():
        spark.conf.set(key, BOUNDS[key])
    return spark
