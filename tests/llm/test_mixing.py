import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies string"


def water(sizes, weights, share, most):
    """Targets by resharing the excess until none is left above its ceiling."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, budget = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = budget - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        above = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not above:
            return target
        capped |= above


def rows():
    out = []
    for i in range(400):
        source = [None, "a", "b", "é", "z", "hot"][i % 5 if i % 3 else 5]
        out.append((i, "w " * (i % 37), source, "x", "y"))
    return [*out, (400, None, "a", "x", "y"), (401, "", "only-empty", "x", "y"), (7, "w " * 7, "b", "x", "y"), (None, "n n", "a", "x", "y")]


def test_targets_and_words_taken(spark):
    data = rows()
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    sizes, words = {}, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, t, s, *_ in data:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = water(sizes, (5, 2, 1), 1.5, 2.0)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 37
        assert all(r.taken <= 2 * r.size and r.source_size == sizes[s] for r in own)
    again = mixing.mix(spark.createDataFrame(data[::-1], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == sorted((r.doc_id or -1, r.size, r.taken) for r in again)


def test_threshold_is_nested_by_hash(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    text = F.concat(F.repeat(F.lit("w "), F.col("size").cast("int")))
    taken = mixing.mix(docs.where("doc_id < 400")).withColumn("h", mixing.hash_of(F.col("doc_id"), text))
    for r in taken.groupBy("source").agg(F.collect_list(F.struct("h", "copies")).alias("all")).collect():
        ordered = [c for _, c in sorted((x.h, x.copies) for x in r["all"])]
        assert ordered == sorted(ordered, reverse=True)


def test_rows_without_an_id_or_that_share_one_come_near_the_target(spark):
    data = [(None, f"word{i} " * 10, "a", "", "") for i in range(40)] + [(5, f"other{i} " * (1 + i % 9), "b", "", "") for i in range(200)] + [(i, "w " * 30, "c", "", "") for i in range(200)]
    docs = spark.createDataFrame(data, SCHEMA)
    by = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert len(by) == 3 and all(abs(r.taken - r.target) <= r.most for r in by)
    words = mixing.mixed_documents(docs).groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in words} == {r.source: r.taken for r in by}


def test_sql_agrees(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA).select("doc_id", "text", "source")
    documents = docs.toPandas().astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(((d, *x) for d, *x in con.execute(mixing.SQL["op6_mixing"]).fetchall()), key=str)
    got = sorted((tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    assert got == want


def test_empty_table_and_repeats(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert mixing.mixed_documents(docs).columns == docs.columns
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert mixing.mixed_documents(docs.where("doc_id is not null and not (doc_id = 7)")).count() > 0
    assert taken > 0
