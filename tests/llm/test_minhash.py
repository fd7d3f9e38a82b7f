import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, minhash

SCHEMA = "doc_id long, text string, node string, n long"


def shingles(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, percent=85):
    """doc -> (size of its set, least doc reachable), by comparing all pairs."""
    root = {d: d for d, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = [(d, shingles(t)) for d, t, *_ in rows]
    for i, (d, a) in enumerate(own):
        for e, b in own[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in own}


def corpus(n=220, seed=4):
    rng = random.Random(seed)
    vocab = [f"Word{i}" for i in range(200)] + ["Éa", "x\x1fy"]
    out = []
    # one family around a centre, its members about as far apart as the threshold
    centre = [rng.choice(vocab) for _ in range(120)]
    for i in range(n):
        words = list(centre)
        if i % 2:
            words = [rng.choice(vocab) for _ in range(rng.randrange(1, 200))] if not out or rng.random() < 0.4 else rng.choice(out)[1].split(" ")
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append((i, " ".join(words), "clash", 5))
    return [*out, (n, None, "", 0), (n + 1, " \n", "", 0), (n + 2, "One two", "", 0), (n + 3, "one\ttwo", "", 0), (n + 4, "three", "", 0)]


def found(frame, **limits):
    rows = minhash.near_duplicates(frame, **limits).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}, len(rows)


@pytest.mark.parametrize("limits", [{}, {"listed": 2, "block_bytes": 4000}, {"listed": 1 << 20}])
def test_against_all_pairs(spark, limits):
    rows = corpus()
    want = brute(rows)
    assert sum(d != c for d, (_, c) in want.items()) > 60
    assert found(spark.createDataFrame(rows, SCHEMA), **limits) == (want, len(rows))


def test_a_chain_of_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 200]), "", 0) for i in range(0, 200, 8)] + [(1000 + i, " ".join(words[i : i + 200]), "", 0) for i in range(0, 200, 8)]
    got, _ = found(spark.createDataFrame(rows, SCHEMA))
    assert {c for _, c in got.values()} == {0}


def test_threshold_is_exact(spark):
    # a text of n + 2 words has n shingles; of 20 a shared front leaves 17 in common of 20
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words[:22]), "", 0), (2, " ".join(words[:19]), "", 0), (3, " ".join(words[:18]), "", 0)]
    got, _ = found(spark.createDataFrame(rows[:2], SCHEMA))
    assert got == {1: (20, 1), 2: (17, 1)}
    got, _ = found(spark.createDataFrame([rows[0], rows[2]], SCHEMA))
    assert got == {1: (20, 1), 3: (16, 3)}


def test_hot_copies_null_ids_and_bounds(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(4)]
    rows = [(i, texts[0], "", 0) for i in range(10, 300)] + [(5, texts[0] + " end", "", 0), (None, texts[0], "", 0), (None, texts[1], "", 0), (None, texts[1], "", 0), (7, texts[2], "", 0), (7, texts[3], "", 0), (9, texts[3], "", 0)]
    for bound in (500_000, 0):  # keys broadcast, and shuffled
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
        assert len(got) == len(rows)
        assert {r.component_id for r in got if r.doc_id and r.doc_id >= 10} == {5}
        assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["5", "None", "None"]
        assert sorted(r.component_id for r in got if r.doc_id in (7, 9)) == [7, 7, 7]


def test_very_long_and_empty(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(300_000))
    got, _ = found(spark.createDataFrame([(1, long, "", 0), (2, long + " x", "", 0), (3, long[:1_000_000], "", 0)], SCHEMA))
    assert got[1] == (70_000, 1) and got[2] == (70_001, 1) and got[3][1] == 1 or got[3][0] < 70_000
    assert found(spark.createDataFrame([], SCHEMA)) == ({}, 0)
    assert found(spark.createDataFrame([(1, None, "", 0), (2, "", "", 0)], SCHEMA)) == ({1: (0, 1), 2: (0, 2)}, 2)


def test_counted_collisions(spark):
    assert [minhash.least_matches(p) for p in (85, 80)] == [15, 12]
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (50, 32), np.uint8)
    b = np.where(rng.random((50, 32)) < 0.5, a, rng.integers(0, 256, (50, 32), np.uint8))
    names = minhash._PACKED
    pack = lambda x: x.view(np.int64).tolist()
    rows = [(dict(zip(names, x, strict=True)), dict(zip(names, y, strict=True))) for x, y in zip(pack(a), pack(b), strict=True)]
    kind = "struct<" + ",".join(f"{s}:long" for s in names) + ">"
    frame = spark.createDataFrame(rows, f"a {kind}, b {kind}").withColumn("id", F.monotonically_increasing_id())
    got = [r.k for r in frame.orderBy("id").select(minhash._matches("a", "b").alias("k")).collect()]
    assert got == (a == b).sum(1).tolist()


def test_forest():
    sets = [np.arange(i, i + 20, dtype=np.uint64) for i in (0, 1, 2, 30)]
    alone = np.arange(4)
    assert minhash.forest(sets, alone, alone, False, 90) == [(0, 1), (1, 2)]
    assert minhash.forest(sets, np.array([5, 5, 6, 7]), alone, False, 90) == [(1, 2)]
    assert minhash.forest(sets, alone, np.array([1, 1, 0, 0]), True, 90) == [(1, 2)]
