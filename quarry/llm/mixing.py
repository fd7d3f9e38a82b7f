"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Token counts are summed by source and hash bucket (partial sums before the shuffle), the bucket in
which a source's budget ends is found from cumulative sums, and only that bucket is refined by the next
hash bits. The mix is then one comparison of each document's hash with its source's threshold: nothing
is sorted. Thresholds are nested: a larger budget keeps all that a smaller one keeps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, documents, settle, small
from quarry.operators.numbering import numbered

#: Bits of hash used at each refinement, and the number of refinements; 40 bits in all.
BITS, LEVELS, HASH_BITS = 10, 4, 40


def size_of(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """40 bits of MD5 of the id as text, a colon and the text, nulls being empty: the same in every run and engine."""
    digest = F.md5(F.concat(*[F.coalesce(x, F.lit("")).cast("binary") for x in (doc_id.cast("string"), F.lit(":"), text.cast("string"))]))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for every source.

    Sources by code point, null last, have ``weights`` in turn. Together the targets are ``share`` of
    all sizes. No target is above ``most`` times its source's size; what is above is shared among the
    others by weight until none is above: each round caps the sources that the level of the others overruns, and
    two sums of a round come to the driver. No task sees all sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("absent", F.col("source").isNull())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("row") % len(weights) + 1).cast("int"))
    ranked = numbered(totals, "absent", "source").select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("ceiling"))
    ranked = settle(ranked, "sources")
    size, open_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    capped, level, before = 0.0, None, None
    while size is not None and open_weight and (capped, open_weight) != before:
        before, level = (capped, open_weight), (share * size - capped) / open_weight
        above = F.lit(level) * F.col("weight") > F.col("ceiling")
        row = ranked.agg(F.sum(F.when(above, F.col("ceiling"))), F.sum(F.when(~above, F.col("weight")))).first()
        capped, open_weight = row[0] or 0.0, row[1] or 0.0
    target = F.least(F.col("ceiling"), F.lit(level) * F.col("weight")) if open_weight else F.col("ceiling")
    return ranked.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash) of every row; a table without sources has the null source."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("hash"))


def thresholds(base: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(s, whole, target, source_size, limit) of every source: how many times all its documents are taken, and below which hash once more."""
    targets = settle(source_targets(base, weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    #: floor is the least hash not yet decided, got the words below it.
    edge = budget.select("source", "budget", "whole", "target", "source_size", F.lit(0).cast("long").alias("floor"), F.lit(0).cast("long").alias("got"), F.lit(0).cast("long").alias("step"))
    for level in range(LEVELS):
        width = 1 << (HASH_BITS - BITS * (level + 1))
        e = edge.select(F.col("source").alias("s"), "floor")
        inside = base.join(e, F.col("source").eqNullSafe(F.col("s")))
        if level:
            inside = inside.where((F.col("hash") >= F.col("floor")) & (F.col("hash") < F.col("floor") + width * (1 << BITS)))
        bucket = F.floor((F.col("hash") - F.col("floor")) / F.lit(width)).cast("long") if level else F.shiftright("hash", HASH_BITS - BITS)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(running)).select(F.col("source").alias("s"), "bucket", "words", "upto")
        over = F.col("got") + F.col("upto") > F.col("budget")
        first = F.min(F.when(over, F.struct("bucket", (F.col("upto") - F.col("words")).alias("below"), "words")))
        joined = edge.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").groupBy(*edge.columns).agg(first.alias("cut"), F.max("upto").alias("all"))
        edge = joined.select(
            "source", "budget", "whole", "target", "source_size",
            F.coalesce(F.col("floor") + F.col("cut.bucket") * width, F.col("floor") + F.lit(width * (1 << BITS))).alias("floor"),
            (F.col("got") + F.coalesce(F.col("cut.below"), F.col("all"), F.lit(0))).alias("got"),
            F.coalesce(F.when(F.col("cut").isNull(), 0).otherwise(F.lit(width)), F.lit(0)).cast("long").alias("step"),
            F.coalesce(F.col("cut.words"), F.lit(0)).alias("next"),
        )
        edge = settle(edge, "edge").select("source", "budget", "whole", "target", "source_size", "floor", "got", "step", *(["next"] if level == LEVELS - 1 else []))
    # the last bucket is taken if that comes nearer
    nearer = (F.col("got") + F.col("next") - F.col("budget")) < (F.col("budget") - F.col("got"))
    limits = edge.select(F.col("source").alias("s"), "whole", "target", "source_size", (F.col("floor") + F.when(nearer, F.col("step")).otherwise(F.lit(0))).alias("limit"))
    return settle(limits, "limits")


def _copies() -> Column:
    return (F.col("whole") + F.when(F.col("hash") < F.col("limit"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` whole repeats of a document are taken: the source's whole repeats, plus one for hashes
    below its threshold. ``taken`` is their words. Rows equal in doc_id and text share a hash, so these fall together; rows that only share a
    doc_id, or have none, are told apart by their texts. Null
    and empty texts have size 0, long ones are counted whole; a null source is a source of its own, the last; an empty
    table gives no rows. Other columns are not read, whatever their names.
    """
    base = settle(sized(docs), "sizes")
    limits = small(thresholds(base, weights, share, most))
    out = base.join(limits, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents of the mix, each as often as it is taken (see ``mix``); columns unchanged.

    Only hashes are compared with their source's threshold: thresholds are broadcast while they are few (``small``),
    so no text moves. Documents of no words have no part in the budget and follow their source's threshold as the others.
    """
    limits = small(thresholds(settle(sized(docs), "sizes"), weights, share, most)).select(*[F.col(c).alias(f"__mix_{c}") for c in ("s", "whole", "limit")])
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    taken = F.col("__mix_whole") + F.when(hash_of(F.col("doc_id"), F.col("text")) < F.col("__mix_limit"), 1).otherwise(0)
    joined = docs.withColumn("__mix_source", source).join(limits, F.col("__mix_source").eqNullSafe(F.col("__mix_s"))).withColumn("__mix_copies", taken.cast("int"))
    repeated = joined.where("__mix_copies > 0").withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("__mix_copies"))))
    return repeated.select(*docs.columns)


QUERIES = {"op6_mixing": op6_mixing}
SQL = {
    "op6_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 10) AS BIGINT) AS hash
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS ceiling,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(ceiling) OVER rising, 0)) /
            (sum(weight) OVER () - coalesce(sum(weight) OVER rising, 0)) AS level
  FROM weighed
  WINDOW rising AS (ORDER BY ceiling / weight, weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least(ceiling, coalesce(max(CASE WHEN level * weight <= ceiling THEN level END) OVER () * weight, ceiling)) AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT s.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.hash) AS words
  FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
edges AS (
  SELECT *, min(CASE WHEN upto > budget THEN hash END) OVER (PARTITION BY source) AS cut FROM placed),
cuts AS (
  SELECT *, CASE WHEN cut IS NULL OR hash < cut THEN 1
                 WHEN hash = cut AND (upto - budget) < (budget - (upto - words)) THEN 1 ELSE 0 END AS extra
  FROM edges)
SELECT doc_id, size, source_size, target, CAST((whole + extra) * size AS BIGINT) AS taken FROM cuts
"""
}
