"""Packing ranked results into a token budget: running sums over a window, no loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.paths import filename
from quarry.functions.text import comment_lines
from quarry.functions.tokens import estimate_tokens


def label_for(source_id: Column, fmt: str) -> Column:
    name = F.when(filename(source_id) != "", filename(source_id)).when(source_id != "", source_id).otherwise("source")
    return F.replace(F.lit(fmt), F.lit("{}"), name)


def pack_context(
    results: DataFrame, budget: int, base_tokens: int, label_format: str = "[Source: {}]\n", divider: str = "", comment_out: bool = False
) -> DataFrame:
    """(query_id, rank, source_id, piece, tokens, is_excerpt) of the results that fit.

    ``results`` has query_id, rank, source_id, content. Labels are charged unless the content begins with
    its own; whole results are taken while the running sum stays within ``budget``; the first that doesn't
    fit gives an excerpt, if more than its label has room, and is the last. Excerpts are cut before a
    character that would be split.
    """
    label = label_for(F.col("source_id"), label_format)
    labelled = F.startswith("content", label)
    rows = results.select(
        "query_id", "rank", "source_id", "content", F.when(labelled, "").otherwise(label).alias("label"),
        estimate_tokens(F.col("content")).alias("content_tokens"), F.when(labelled, 0).otherwise(estimate_tokens(label)).cast("long").alias("label_tokens"),
    )
    by = Window.partitionBy("query_id").orderBy("rank")
    cost = F.col("content_tokens") + F.col("label_tokens")
    upto = F.lit(base_tokens).cast("long") + F.sum(cost).over(by.rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.withColumn("upto", upto).withColumn("first_over", F.min(F.when(F.col("upto") > budget, F.col("rank"))).over(Window.partitionBy("query_id")))
    before = F.col("upto") - cost
    room = F.greatest(F.lit(budget).cast("long") - before, F.lit(0).cast("long"))
    excerpt = F.col("rank") == F.col("first_over")
    taken = summed.withColumn("room", room).withColumn("is_excerpt", F.coalesce(excerpt, F.lit(False)))
    taken = taken.where(F.col("first_over").isNull() | (F.col("rank") < F.col("first_over")) | (F.col("is_excerpt") & (F.col("room") > F.col("label_tokens"))))
    n_bytes = F.when(F.col("content_tokens") > 0, F.expr("octet_length(content) * (room - label_tokens) div content_tokens")).otherwise(F.octet_length("content"))
    raw = F.expr("substring(encode(content, 'UTF-8'), 1, cast(n_bytes as int))")
    cut = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�+\\z", "")
    body = F.when(F.col("is_excerpt"), cut).otherwise(F.col("content"))
    piece = F.concat("label", body)
    if comment_out:
        piece = comment_lines(piece, filename(F.col("source_id")))
    tokens = F.when(F.col("is_excerpt"), estimate_tokens(piece)).otherwise(cost)
    return taken.withColumn("n_bytes", n_bytes).select("query_id", "rank", "source_id", F.concat(F.lit(divider), piece, F.lit("\n\n")).alias("piece"), tokens.alias("tokens"), "is_excerpt")


def context_text(packed: DataFrame) -> DataFrame:
    """(query_id, context, tokens): the pieces of each query in order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "piece")))
    return packed.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x.piece), "").alias("context"), F.sum("tokens").alias("tokens"))
