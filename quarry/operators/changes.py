"""Change detection and keyed maintenance of tables, as functions from frames to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detect_changes(current: DataFrame, tracked: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """(path, change_type): new, modified, deleted or unchanged, by time of change and size.

    Both have path, last_modified, file_size. Ignored paths are left out on both sides; paths listed twice count once.
    """
    if ignored is not None:
        current, tracked = (x.join(ignored.select("path"), "path", "left_anti") for x in (current, tracked))
    now = current.groupBy("path").agg(F.max(F.struct("last_modified", "file_size")).alias("now"))
    then = tracked.select("path", F.struct("last_modified", "file_size").alias("then"))
    kind = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "modified").otherwise("unchanged")
    return now.join(then, "path", "full_outer").select("path", kind.alias("change_type"))


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def unchanged(current: DataFrame, tracked: DataFrame) -> DataFrame:
    keys = ["path", "last_modified", "file_size"]
    return current.select(*keys).intersect(tracked.select(*keys))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key; the last of equal new rows by all columns."""
    new = rows.select(*table.columns)
    by = Window.partitionBy(key).orderBy(*[F.desc(c) for c in table.columns if c != key])
    latest = new.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
    return table.join(new.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(latest)


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def exists_in(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.join(table.select(key), key, "left_semi")


def new_only(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(key), key, "left_anti")


def failures(events: DataFrame, least: int = 3) -> DataFrame:
    """(path, failures) of paths that failed ``least`` times or more since their last success.

    ``events`` has path, ts and ok.
    """
    last_ok = events.groupBy("path").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"))
    since = events.join(last_ok, "path").where(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("ts") > F.col("last_ok"))))
    return since.groupBy("path").agg(F.count(F.lit(1)).alias("failures")).where(F.col("failures") >= least)


def dedupe_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    by = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


IMPORTED = "already imported"


def import_outcome(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``error``: IMPORTED where the key is in ``done`` or has come in an earlier row (by ``place``), else null."""
    known = done.select(key).distinct().withColumn("_known", F.lit(True))
    first = F.min("place").over(Window.partitionBy(key)) == F.col("place")
    return rows.join(known, key, "left").withColumn("error", F.when(F.col("_known") | ~first, IMPORTED)).select(*rows.columns, "error")
