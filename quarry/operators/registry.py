"""Instances and their heartbeats: liveness, eviction, lookups."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions.paths import standardize
from quarry.operators import changes

ACTIVE_S, STALE_S, BEAT_S = 30, 120, 10


def latest(beats: DataFrame) -> DataFrame:
    """(id, last_heartbeat): the latest beat of each instance; partial maxima before the shuffle."""
    return beats.groupBy("id").agg(F.max("ts").alias("last_heartbeat"))


def registered(instances: DataFrame, rows: DataFrame) -> DataFrame:
    """The registry with ``rows`` put in, each in place of an older one of its id."""
    return changes.upsert(instances, rows, "id")


def unregistered(instances: DataFrame, ids: DataFrame) -> DataFrame:
    return changes.delete_keys(instances, ids, "id")


def beaten(instances: DataFrame, beats: DataFrame) -> DataFrame:
    """The registry after heartbeats (id, ts): known instances move on, never back; beats of unknown ones count for nothing."""
    late = latest(beats).withColumnRenamed("last_heartbeat", "_late")
    now = F.greatest("last_heartbeat", "_late")
    return instances.join(late, "id", "left").withColumn("last_heartbeat", now).select(*instances.columns)


def with_keys(instances: DataFrame, keys: DataFrame) -> DataFrame:
    """Instances that have a key of their own in ``keys`` (id, app_key); the others are left out."""
    return instances.join(keys.select("id", "app_key"), "id")


def active(instances: DataFrame, now: Column, within: int = ACTIVE_S) -> DataFrame:
    return instances.where(now - F.col("last_heartbeat") < within).orderBy(F.desc("last_heartbeat"), "id")


def stale(instances: DataFrame, now: Column, own_id: str | int, after: int = STALE_S) -> DataFrame:
    """Other instances without a beat for too long."""
    return instances.where((F.col("id") != own_id) & (now - F.col("last_heartbeat") > after))


def evict(instances: DataFrame, gone: DataFrame, now: Column, event: str = "stale") -> tuple[DataFrame, DataFrame]:
    """(instances left, audit rows of those evicted)."""
    audit = gone.select(now.alias("ts"), F.col("id").alias("instance_id"), F.lit(event).alias("event"), F.lit("evicted").alias("message"), F.lit("").alias("extra"))
    return instances.join(gone.select("id"), "id", "left_anti"), audit


def dead(instances: DataFrame, alive: Column) -> DataFrame:
    """Instances whose process isn't alive, by a predicate that the caller gives."""
    return instances.where(~alive)


def parse_params(params: Column, schema: str) -> Column:
    """JSON parameters; anything unreadable is an empty object."""
    return F.coalesce(F.from_json(params, schema), F.from_json(F.lit("{}"), schema))


def with_projects(projects: DataFrame, instances: DataFrame) -> DataFrame:
    """Projects with the first instance (least id) of the same path, slashes and case aside."""
    first = Window.partitionBy("key").orderBy("id")
    own = instances.withColumn("key", standardize(F.col("config_path"))).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return projects.withColumn("key", standardize(F.col("path"))).join(own.select("key", F.col("id").alias("instance_id")), "key", "left").drop("key")


def orphans(instances: DataFrame, projects: DataFrame) -> DataFrame:
    """Instances of no listed project."""
    listed = projects.select(standardize(F.col("path")).alias("key")).distinct()
    return instances.withColumn("key", standardize(F.col("config_path"))).join(listed, "key", "left_anti").drop("key")


class Registry:
    """Instances kept under ``path``, on any file system that Spark reaches, by any number of processes.

    Writers only append: registrations, removals and beats, each with the time at which it was made. What is registered is what these add up to:
    of each id the last registration, unless a removal is later, with its latest beat since. So writers can't lose each other's rows, and
    one that stops halfway leaves nothing half done.
    """

    EVENTS = schemas.INSTANCES + ", at bigint, kind string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _events(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.EVENTS).parquet(f"{self.path}/events")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.EVENTS)

    def _append(self, rows: DataFrame, kind: str) -> None:
        fields = self.spark.createDataFrame([], self.EVENTS).schema
        whole = rows.withColumns({"at": F.lit(time.time_ns()), "kind": F.lit(kind)})
        columns = [(F.col(f.name) if f.name in whole.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        whole.select(*columns).write.mode("append").parquet(f"{self.path}/events")

    def register(self, rows: DataFrame) -> None:
        """Put instances in, each in place of an older one of its id."""
        self._append(rows, "in")

    def unregister(self, ids: DataFrame) -> None:
        self._append(ids.select("id"), "out")

    def beat(self, beats: DataFrame) -> None:
        """Beats (id, ts); those of unknown instances count for nothing, and no instance's time goes back."""
        self._append(latest(beats), "beat")

    def instances(self) -> DataFrame:
        names = schemas.names(schemas.INSTANCES)
        events = self._events()
        last = events.where("kind <> 'beat'").groupBy("id").agg(F.max_by(F.struct("kind", "at", *names), "at").alias("r")).where("r.kind = 'in'")
        beats = events.where("kind = 'beat'").select("id", F.col("last_heartbeat").alias("beat"), F.col("at").alias("beat_at"))
        since = last.join(beats, "id", "left").groupBy("id").agg(F.any_value("r").alias("r"), F.max(F.when(F.col("beat_at") > F.col("r.at"), F.col("beat"))).alias("beat"))
        return since.select(*[(F.greatest(f"r.{c}", "beat") if c == "last_heartbeat" else F.col(f"r.{c}")).alias(c) for c in names])

    def evict(self, now: int, own_id: str = "", after: int = STALE_S, event: str = "stale") -> DataFrame:
        """Remove the other instances without a beat for too long; returns their audit rows, which are kept, too."""
        _, audit = evict(self.instances(), stale(self.instances(), F.lit(now), own_id, after), F.lit(now), event)
        rows = self.spark.createDataFrame(audit.collect(), audit.schema)  # of instances, not of beats
        self.unregister(rows.select(F.col("instance_id").alias("id")))
        rows.write.mode("append").parquet(f"{self.path}/audit")
        return rows

    def compact(self) -> None:
        """Write what is registered as registrations of now, and drop the rest; only for times when nobody else writes."""
        rows = self.spark.createDataFrame(self.instances().collect(), schemas.INSTANCES)
        self._events().limit(0).write.mode("overwrite").parquet(f"{self.path}/events")
        self.register(rows)
