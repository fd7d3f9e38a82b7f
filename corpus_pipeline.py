"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage works on all rows that the one before kept; results are written as Parquet and read again in
between, so a lost executor repeats one stage at most. Registered as query ``pipeline``.

Of every stage: a null text counts as an empty one; texts are read whole, however long; an empty table gives no rows; the
columns are those of the input, whatever their names, and nothing is read but doc_id, text and (in mixing) source. Rows are told
apart by doc_id and text, so a doc_id may repeat or be null. What stages do beyond that is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import copies, decontaminate, mixing, quality, queries, sharding
from quarry.llm.common import documents, settle
from quarry.session import prepare


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the rules or lose too much text (so null and empty ones). Each row is judged by itself."""
    prepare(spark)
    return quality.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id, rows without one last; of equal rows one. Texts without words are one group."""
    prepare(spark)
    return copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with or without a doc_id; items without an id count. An empty benchmark holds nothing."""
    prepare(spark)
    return decontaminate.clean_of_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: no, one or two rows. Rows that share a doc_id, or have none, share a hash and so a verdict within their source."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of the mix; equal texts share a shard, each row has a slot of its own."""
    prepare(spark)
    return sharding.shard_documents(docs)


STAGES = [("quality", clean), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]
#: SQL can't express the fingerprints of the second stage; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the whole table of documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {**queries.QUERIES, "pipeline": run}
SQL = {**queries.SQL, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
