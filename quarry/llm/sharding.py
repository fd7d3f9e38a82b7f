"""Sharding by minimax contiguous partition.

Documents with equal texts form atomic groups, ordered by their least doc_id. Running sums over the
groups are made in two levels (inside ranges, then over the ranges' totals). The smallest capacity at
which a greedy pass needs no more than the given number of shards is found by binary search on the driver over a
sample of the groups' ends, POINTS of them at most. A greedy pass that rounds each cut down to a sampled end tells capacities that
surely suffice, one that rounds up as far as the next sampled end those that surely don't. What lies between leaves a narrow
window for each cut, which is sampled anew, more closely, until every end in the windows is known and the two searches meet.
The cuts of the smallest capacity are the shards' borders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, settle

SHARDS = 16
#: Ends sampled at once; equal rows made from one array.
POINTS, NUMBERED = 1 << 16, 4096


def ordered_groups(base: DataFrame) -> DataFrame:
    """(text_key, bytes, members, upto, before, nth): atomic groups with running bytes (own included), running members (own not) and number."""
    groups = base.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("members"))
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = groups.repartitionByRange(n, F.col("first").asc_nulls_last(), "text_key")
    ranged = settle(ranged.withColumn("part", F.spark_partition_id()), "groups")
    totals = ranged.groupBy("part").agg(F.sum("bytes").alias("part_bytes"), F.sum("members").alias("part_members"), F.count(F.lit(1)).alias("part_groups"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *[F.coalesce(F.sum(f"part_{x}").over(earlier), F.lit(0)).alias(f"{x}_before") for x in ("bytes", "members", "groups")])
    inside = Window.partitionBy("part").orderBy(F.col("first").asc_nulls_last(), "text_key")
    upto = F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("bytes_before")
    nth = F.row_number().over(inside).cast("long") + F.col("groups_before")
    before = F.coalesce(F.sum("members").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("members_before")
    placed = ranged.join(F.broadcast(offsets), "part").select("text_key", "first", "bytes", "members", upto.alias("upto"), before.alias("before"), nth.alias("nth"))
    return settle(placed.sortWithinPartitions("upto"), "prefix")


class Ends:
    """Known group ends, and between which of them all ends are known."""

    def __init__(self, total: int):
        self.known = np.array([0, total], np.int64)
        self.closed: list[tuple[int, int]] = []

    def add(self, ends: np.ndarray, closed: list[tuple[int, int]]) -> None:
        self.known = np.unique(np.r_[self.known, ends])
        self.closed += closed

    def down(self, x: int) -> int:
        """The last known end up to x: no later than the last end."""
        return int(self.known[np.searchsorted(self.known, x, side="right") - 1])

    def up(self, x: int) -> int:
        """No earlier than the last end up to x."""
        i = int(np.searchsorted(self.known, x, side="right"))
        low = int(self.known[i - 1])
        if low == x or i == len(self.known) or any(a <= low and x <= b for a, b in self.closed):
            return low
        return min(x, int(self.known[i]) - 1)


def _cuts(reach: Callable[[int], int], shards: int, capacity: int) -> list[int]:
    path = [0]
    for _ in range(shards):
        path.append(max(path[-1], reach(path[-1] + capacity)))
    return path[1:]


def greedy_cuts(reach: Callable[[int], int], total: int, shards: int, capacity: int) -> list[int] | None:
    """The borders that greedy packing gives, None where it needs more shards."""
    path = _cuts(reach, shards, capacity)
    return path if path[-1] >= total else None


def _least(reach: Callable[[int], int], total: int, shards: int, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy_cuts(reach, total, shards, middle) else (middle + 1, high)
    return low


def smallest_capacity(prefix: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least feasible capacity, and the ends of its shards; one job for each round of samples."""
    total, largest = prefix.agg(F.max("upto"), F.max("bytes")).first()
    if total is None:
        return 0, [0]
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    ends, windows, every = Ends(total), [(0, total)], None
    while True:
        inside = prefix.where(" or ".join(f"(upto >= {a} and upto <= {b})" for a, b in windows))
        every = max(1, min(-(-inside.count() // POINTS), every // 2 if every else 1 << 62))
        found = inside.where(F.pmod("nth", F.lit(every)) == 0).select("upto").toArrow().column(0).to_numpy()
        ends.add(found, windows if every == 1 else [])
        high = _least(ends.down, total, shards, low, high)
        low = _least(ends.up, total, shards, low, high)
        if every == 1 and low == high:
            return high, greedy_cuts(ends.down, total, shards, high)
        # between the least cuts of the least capacity in question and the greatest of the greatest
        first, last = _cuts(ends.down, shards, low), _cuts(ends.up, shards, high)
        windows = _merged([(min(a, b), max(a, b)) for a, b in zip(first, last, strict=True)])


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """The rows, each with its rank by doc_id among those of its text_key (no id: last; rows equal in both, in any order).

    Rows equal in both are counted first and made again at the end, and ranges of (text_key, doc_id) are numbered
    apart, so a group of any size, with ids or without, is ranked by many tasks.
    """
    same = rows.groupBy("text_key", "doc_id").agg(*[F.first(c).alias(c) for c in rows.columns if c not in ("text_key", "doc_id")], F.count(F.lit(1)).alias("times"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_last()
    ranged = settle(same.repartitionByRange(n, "text_key", order).withColumn("part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("text_key", "part").agg(F.sum("times").alias("own"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("text_key", "part", F.coalesce(F.sum("own").over(earlier(Window.partitionBy("text_key").orderBy("part"))), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("times").over(earlier(Window.partitionBy("text_key", "part").orderBy(order))), F.lit(0))
    numbered = ranged.withColumn("inside", inside).join(parts, ["text_key", "part"])
    last = F.col("times") - 1
    blocks = numbered.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / NUMBERED))))
    each = F.sequence(F.lit(0).cast("long"), F.least(last - F.col("block") * NUMBERED, F.lit(NUMBERED - 1)))
    made = blocks.withColumn("nth", F.explode(each)).withColumn("rank", F.col("ahead") + F.col("inside") + F.col("block") * NUMBERED + F.col("nth"))
    return made.select(*rows.columns, "rank")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    Size is the text's UTF-8 bytes plus 1, however long; a null text counts as an empty one. Equal texts share a shard; a group larger than a
    fair share sets the capacity. A group's rows lie side by side, by doc_id. Slots run from 0 in each shard without gaps; repeated rows have slots of their own. Groups without
    a doc_id come last, by their hash. Texts are held equal by SHA-256. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(text.cast("binary"), 256))
    base = settle(
        docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("text_key")),
        "sizes",
    )
    prefix = ordered_groups(base)
    _, ends = smallest_capacity(prefix, shards)
    shard = sum((F.when(F.col("upto") > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0)).cast("int")
    placed = prefix.select("text_key", "members", "before", shard.alias("shard"))
    starts = {r.shard: r.start for r in placed.groupBy("shard").agg(F.min("before").alias("start")).collect()}
    start = F.coalesce(*[F.when(F.col("shard") == s, F.lit(b)) for s, b in starts.items()], F.lit(0))
    rows = base.join(placed, "text_key")
    single = rows.where("members = 1").withColumn("rank", F.lit(0).cast("long"))
    several = ranked(rows.where("members > 1"))
    columns = ["doc_id", "size", "text_crc32", "shard", (F.col("before") - start + F.col("rank")).cast("long").alias("slot")]
    return single.select(*columns).union(several.select(*columns))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_sharding": op5_sharding}
# CRC-32 byte by byte, with a table that is made first; the capacity by halving, each greedy pass a fold over the groups' sizes
SQL = {
    "op5_sharding": f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, list_transform(range(8), lambda k: k::UBIGINT)),
    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) AS step),
d AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 1 AS size, sha256(coalesce(text, '')) AS text_key,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT) AS bytes
  FROM documents),
summed AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda a, b: xor(a >> 8, step[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS text_crc32
  FROM d, crc),
g AS (SELECT text_key, min(doc_id) AS first, sum(size)::BIGINT AS bytes FROM d GROUP BY text_key),
placed AS (SELECT *, sum(bytes) OVER (ORDER BY first NULLS LAST, text_key)::BIGINT AS upto FROM g),
sizes AS (
  SELECT sum(bytes)::BIGINT AS total, max(bytes) AS largest, list({{used: 1::BIGINT, held: bytes}} ORDER BY upto) AS parts FROM placed),
halves AS (
  SELECT greatest((total + {SHARDS - 1}) // {SHARDS}, largest) AS low, (total + {SHARDS - 1}) // {SHARDS} + largest AS high FROM sizes WHERE total IS NOT NULL
  UNION ALL
  SELECT CASE WHEN fits THEN low ELSE middle + 1 END, CASE WHEN fits THEN middle ELSE high END FROM (
    SELECT low, high, middle, list_reduce(parts, lambda a, x: CASE WHEN a.held + x.held > middle
      THEN {{used: a.used + 1, held: x.held}} ELSE {{used: a.used, held: a.held + x.held}} END).used <= {SHARDS} AS fits
    FROM (SELECT low, high, (low + high) // 2 AS middle, parts FROM halves, sizes WHERE low < high))),
capacity AS (SELECT min(high) AS most FROM halves),
cuts AS (
  SELECT 0 AS k, 0::BIGINT AS upto
  UNION ALL
  SELECT k + 1, greatest(c.upto, (SELECT max(p.upto) FROM placed p, capacity WHERE p.upto <= c.upto + most)) FROM cuts c WHERE k < {SHARDS - 1}),
sharded AS (
  SELECT text_key, first, (SELECT count(*) FROM cuts WHERE k > 0 AND cuts.upto < placed.upto)::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY first NULLS LAST, text_key, doc_id NULLS LAST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN summed USING (r) JOIN sharded USING (text_key)
"""
}
