"""Near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more, or fingerprints within three bits.

``minhash`` links the sets: an inverted join on the coordinates of their signatures, whole sets deciding. The fingerprints
of ``simhash`` also link some less similar texts; each fingerprint stands for the least of its sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import minhash, simhash
from quarry.llm.common import LAST, row_key, settle, small
from quarry.llm.components import components

SHINGLE, PERCENT = 5, 80
LISTED, BLOCK_BYTES = minhash.LISTED, minhash.BLOCK_BYTES


def _fingerprint_links(marked: DataFrame) -> DataFrame:
    """(u, v) with u > v: links between sets that have a fingerprint in common, or fingerprints within three bits."""
    hubs = settle(marked.groupBy("fp").agg(F.min("node").alias("hub")), "copy-hubs")
    same = marked.join(hubs, "fp").select("node", "hub")
    near = simhash.links(hubs.select("fp"))
    ends = hubs.select(F.col("fp").alias("u"), F.col("hub").alias("node")), hubs.select(F.col("fp").alias("v"), "hub")
    both = same.union(near.join(ends[0], "u").join(ends[1], "v").select("node", "hub"))
    return both.where("node <> hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (doc, same, node), one row per row of ``docs``, and (node, head), head being the first (doc, same) reachable over links."""
    rows = minhash.keyed_texts(docs)
    marked = settle(minhash.marked(rows, SHINGLE, fp=simhash.fingerprint), "shingles")
    nodes = minhash.nodes_of(marked)
    links = minhash.links(rows, nodes, SHINGLE, PERCENT, LISTED, BLOCK_BYTES)
    roots = components(links.union(_fingerprint_links(marked)).distinct()).withColumnRenamed("node", "linked")
    labelled = nodes.join(roots, nodes.node == roots.linked, "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    heads = labelled.groupBy("root").agg(F.min("first").alias("head"))
    return marked.select("doc", "same", "node"), settle(labelled.join(heads, "root").select("node", "head"), "copy-heads")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable over links of near copies.

    Words are lower-cased (A-Z) and split at white space; a null text is an empty one, and texts without
    words are copies of each other; long texts are taken whole; an empty table gives no rows. Every row is reported,
    those that repeat a doc_id too; rows without a doc_id take part, and name a component only among themselves.
    """
    rows, heads = classes(docs)
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return rows.join(heads, "node").select(known("doc").alias("doc_id"), known("head.doc").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the first by doc_id (rows without one come last); columns unchanged.

    Texts that share a doc_id are documents of their own; of rows equal in doc_id and text one stays. Only keys are
    joined: those of the rows that go, and of those that repeat, are broadcast while they are few (``small``), so texts don't move.
    """
    rows, heads = classes(docs)
    gone = rows.join(heads, "node").where((F.col("doc") != F.col("head.doc")) | (F.col("same") != F.col("head.same"))).select("doc", "same").distinct()
    gone = small(settle(gone, "copies-gone")).select(F.col("doc").alias("__gone_doc"), F.col("same").alias("__gone_same"))
    twice = settle(rows.groupBy("doc", "same").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("doc", "same"), "copies-twice")
    keyed = docs.select("*", *row_key(docs, "__row_doc", "__row_same"))
    left = keyed.join(gone, (F.col("__row_doc") == F.col("__gone_doc")) & (F.col("__row_same") == F.col("__gone_same")), "left_anti")
    if not twice.take(1):
        return left.select(*docs.columns)
    on = (F.col("__row_doc") == F.col("__gone_doc")) & (F.col("__row_same") == F.col("__gone_same"))
    twice = small(twice).select(F.col("doc").alias("__gone_doc"), F.col("same").alias("__gone_same"))
    one = left.join(twice, on, "left_semi").dropDuplicates(["__row_doc", "__row_same"])
    return left.join(twice, on, "left_anti").union(one).select(*docs.columns)
