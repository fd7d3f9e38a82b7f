import itertools
import random
import zlib

import duckdb
import pandas as pd
import pytest

from quarry.llm import sharding

SCHEMA = "doc_id long, text string, shard string, upto string"


def least_capacity(sizes, shards):
    def fits(c):
        used, at = 1, 0
        for s in sizes:
            if at + s > c:
                used, at = used + 1, 0
            at += s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def rows(n, seed):
    rng = random.Random(seed)
    texts = ["é" * rng.randrange(60) for _ in range(n // 2)]
    out = [(i, rng.choice(texts) if rng.random() < 0.4 else f"{i} " + "x" * rng.randrange(90)) for i in range(n)]
    return [*out, (n, None), (n + 1, None), (n + 2, ""), (3, out[3][1]), (3, out[3][1]), (None, "lost"), *[(n + 3 + i, "hot") for i in range(n // 3)]]


@pytest.mark.parametrize("numbered", [4096, 7])
def test_smallest_capacity_and_slots(spark, monkeypatch, numbered):
    monkeypatch.setattr(sharding, "NUMBERED", numbered)
    monkeypatch.setattr(sharding, "POINTS", 4096 if numbered == 4096 else 9)
    data = rows(200, 4)
    got = sharding.shard_documents(spark.createDataFrame([(d, t, "x", "y") for d, t in data], SCHEMA)).collect()
    assert len(got) == len(data)
    groups = {}
    for d, t in data:
        t = t or ""
        first, size = groups.get(t, (float("inf"), 0))
        groups[t] = (min(first, d if d is not None else float("inf")), size + len((t or "").encode()) + 1)
    capacity = least_capacity([s for _, s in sorted(groups.values())], 16)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    assert max(sum(r.size for r in x) for x in by_shard.values()) == capacity
    assert set(by_shard) <= set(range(16))
    for x in by_shard.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    text = dict(data)
    for r in got:
        assert r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
    assert len({(text[r.doc_id] or "", r.shard) for r in got}) == len({text[r.doc_id] or "" for r in got})


@pytest.mark.parametrize("data", [rows(200, 4), rows(60, 5), [(i, "same") for i in range(40)], [(None, None), (None, ""), (1, "a"), (1, "a"), (1, "b")], []])
def test_equals_sql(spark, tmp_path, data):
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op5_sharding(spark, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"}))
    want = con.execute(sharding.SQL["op5_sharding"])
    assert [c[0] for c in want.description] == got.columns
    by = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got.collect()), key=by) == sorted(want.fetchall(), key=by)


def test_empty_and_one_giant(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    got = sharding.shard_documents(spark.createDataFrame([(i, "same", "", "") for i in range(50)], SCHEMA)).collect()
    assert {r.shard for r in got} == {0} and sorted(r.slot for r in got) == list(range(50))


def test_group_without_ids_is_numbered_by_ranges(spark, monkeypatch):
    """Rows with one id, without an id and with ids of their own, all of one text: ranks follow the ids, and equal rows take several arrays."""
    monkeypatch.setattr(sharding, "NUMBERED", 16)
    data = [(None, "same")] * 300 + [(7, "same")] * 250 + [(i, "same") for i in range(100, 400)] + [(5, "other")]
    got = sharding.shard_documents(spark.createDataFrame([(d, t, "", "") for d, t in data], SCHEMA)).collect()
    ranks = sorted((r.slot, r.doc_id) for r in got if r.size == 5)
    want = sorted((d for d, t in data if t == "same"), key=lambda d: (d is None, d))
    assert [d for _, d in ranks] == want and len({s for s, _ in ranks}) == 850
    assert [s for s, _ in ranks] == list(range(ranks[0][0], ranks[0][0] + 850))


@pytest.mark.parametrize("seed", range(12))
def test_capacity_from_samples(spark, monkeypatch, seed):
    """Sizes of many kinds, a few ends known at a time."""
    rng = random.Random(seed)
    sizes = [rng.choice((1, 2, rng.randrange(1, 50), rng.randrange(1, 5000) if seed % 2 else 3)) for _ in range(rng.randrange(1, 3000))]
    if seed % 3 == 0:
        sizes[rng.randrange(len(sizes))] = sum(sizes) // 3 + 1
    upto = list(itertools.accumulate(sizes))
    prefix = spark.createDataFrame([(u, s, i) for i, (u, s) in enumerate(zip(upto, sizes, strict=True), 1)], "upto long, bytes long, nth long")
    monkeypatch.setattr(sharding, "POINTS", 40)
    shards = rng.choice((2, 5, 16))
    capacity, ends = sharding.smallest_capacity(prefix, shards)
    assert capacity == least_capacity(sizes, shards)
    assert ends[-1] == sum(sizes) and set(ends) <= set(upto) and max(b - a for a, b in zip([0, *ends], ends, strict=False)) == capacity
