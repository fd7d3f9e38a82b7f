"""The driver's contract, and row numbers."""

import __spark_entry__ as entry_point
from pyspark.sql import functions as F

from quarry.operators.numbering import numbered
from quarry.session import BOUNDS, prepare


def test_contract(spark):
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(q) for q in queries.values())
    assert entry_point.entry(spark).count() > 0


def test_numbered(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.lit("x").alias("v"))
    got = {r.k: r.row for r in numbered(rows, "k").collect()}
    assert got == {k: k for k in range(500)}
    assert numbered(rows.limit(0), "k").count() == 0


def test_ship(spark, monkeypatch, tmp_path):
    from quarry import ship

    assert ship.found_by_workers(spark.sparkContext.master) and not ship.found_by_workers("yarn")
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("PYTHONPATH", raising=False)
    assert not ship.found_by_workers("local[2]")
    ship.ship(spark)
    ship.ship(spark)
    assert spark.sparkContext.applicationId in ship._done


def test_building_a_query_leaves_settings_alone(spark):
    entry_point.queries()  # registering builds nothing
    before = dict(spark.conf.getAll)
    prepare(spark)
    added = {k: v for k, v in spark.conf.getAll.items() if before.get(k) != v}
    assert added.keys() <= BOUNDS.keys()
    key = next(iter(BOUNDS))
    spark.conf.set(key, "1m")
    assert prepare(spark).conf.get(key) == "1m"
    spark.conf.unset(key)
