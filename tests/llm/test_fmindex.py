import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import fmindex, passages

SCHEMA = "doc_id long, text string, n_words string, spans string"


def same_key(d, t):
    """Rows of one doc_id are told apart by 64 bits of a hash of the text; only their order matters."""
    return (d is None, d or 0)


def brute(rows, width, order):
    """(doc_id, text) -> result; ``order`` gives the place of different texts of one doc_id."""
    first, out = {}, {}
    docs = sorted({(d, t or "") for d, t in rows}, key=lambda x: (*same_key(*x), order[x]))
    cut = lambda ws: [tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)]
    for k, (_, t) in enumerate(docs):
        for i, w in enumerate(cut(t.encode().split())):
            first.setdefault(w, (k, i))
    for k, x in enumerate(docs):
        ws = x[1].encode().split()
        gone = {j for i, w in enumerate(cut(ws)) if first[w] < (k, i) for j in range(i, i + width)}
        out[x] = (len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode())
    return out


def hashes(docs):
    """Order of texts under one doc_id, as the operator's own rows have it."""
    return {(r.doc_id, r.text or ""): r.same for r in passages.placed(docs).collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "a\x1fb", "a b"]
    shared = [[rng.choice(vocab) for _ in range(rng.choice((19, 20, 21, 30, 70)))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(shared)[: rng.choice((15, 20, 25, 99))] if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randrange(40))]
        rows.append((i * 3, rng.choice((" ", "\n", "\t ")).join(words)))
    return [*rows, (1, None), (2, ""), (4, "x " * 90), (5, "x " * 25), (7, "p q " * 30), (10, rows[3][1]), (11, rows[3][1])]


@pytest.mark.parametrize("hot", [None, "told", "joined"])
def test_against_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(passages, "HOT_LEAST", 3)
        monkeypatch.setattr(passages, "HOT_MOST", 3)
        monkeypatch.setattr(passages, "HOT_TOLD", 10_000 if hot == "told" else 0)
    monkeypatch.setattr(passages, "PIECE", 50)
    rows = corpus(3 + bool(hot))
    # a doc_id of several texts, rows without one, repeated rows
    rows = [*rows, (None, rows[3][1]), (None, rows[3][1]), (None, rows[5][1] + " tail"), (None, None), rows[0], rows[0], (9, rows[7][1] + " more"), (9, "head " + rows[8][1]), (rows[-1][0], rows[2][1])]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    want = brute(rows, 20, hashes(docs))
    got = [tuple(r) for r in fmindex.repeats_removed(docs).collect()]
    assert sorted(got, key=str) == sorted(((d, *want[d, t or ""]) for d, t in rows), key=str)
    assert sum(x[1] > 0 for x in want.values()) > 20
    assert fmindex.repeats_removed(docs.limit(0)).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(2)
    text = np.r_[rng.integers(1, 5, 300), 0]
    places = rng.permutation(301)
    index = fmindex.FMIndex(text, 7, places)
    doc = np.r_[rng.integers(1, 7, 100), text[40:60]]
    length, at = index.statistics(doc, np.array([50, 120]), np.array([50, 70]))
    joined = "".join(map(str, text))
    for lo, hi in ((0, 50), (50, 120)):
        for i in range(lo, hi):
            m = max(k for k in range(min(7, hi - i) + 1) if "".join(map(str, doc[i : i + k])) in joined)
            assert length[i] == m
            if m == 7:
                found = [j for j in range(295) if (text[j : j + 7] == doc[i : i + 7]).all()]
                assert index.earliest(at[i : i + 1])[0] == places[found].min()
    assert (length == 7).sum() > 10


def shard(segments, width):
    """A table as a search gets it, of (route, doc, start, words)."""
    columns = list(zip(*((r, i, d, 0, s, 1, len(w) - width + 1, 0, " ".join(w).encode()) for i, (r, d, s, w) in enumerate(segments)), strict=True))
    types = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["route", "h", "doc", "same", "start", "times", "n", "at", "seg"])


@pytest.mark.parametrize("seed", range(6))
def test_shards_of_many_variants(monkeypatch, seed):
    """Any number of segments of a route, against all pairs; and it is the search that decides."""
    rng, width = random.Random(seed), 5
    segments = []
    for route in range(12):
        core = [f"w{rng.randrange(9)}" for _ in range(5)]
        for k in range(rng.choice((1, 2, 3, 7, 20))):
            side = lambda: [f"w{rng.randrange(2)}" for _ in range(rng.randrange(4))]
            segments.append((route, 10 * k + route % 3, rng.randrange(5), side() + core + side()))
    segments.sort(key=lambda x: x[:3])
    first = {}
    for _, d, s, w in segments:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, (d, s + i)), (d, s + i))
    # windows of other routes don't count here: equal windows always have one route
    own = {}
    for r, d, s, w in segments:
        for i in range(len(w) - width + 1):
            own.setdefault((r, tuple(w[i : i + width])), []).append((d, s + i))
    want = [[min(own[r, tuple(w[i : i + width])]) < (d, s + i) for i in range(len(w) - width + 1)] for r, d, s, w in segments]
    tables = [[x for x in segments if x[0] == r] for r in range(12)]
    bits = lambda masks, segs: [np.unpackbits(np.frombuffer(m, np.uint8), count=len(w) - width + 1).astype(bool).tolist() if m else [False] * (len(w) - width + 1) for m, (*_, w) in zip(masks, segs, strict=True)]
    assert [b for t in tables for b in bits(fmindex.earlier_windows(shard(t, width), width), t)] == want
    assert any(map(any, want))
    monkeypatch.setattr(fmindex.FMIndex, "step", lambda self, c, i: i * 0)
    assert not any(fmindex.earlier_windows(shard(t, width), width) != [b""] * len(t) for t in tables)


def test_memory_of_an_index():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 1 << 12, 100_000).astype(np.int32)
    index = fmindex.FMIndex(text, 20, np.arange(len(text)))
    held = sum(words.nbytes + ones.nbytes for _, words, ones, _ in index.levels) + index.common.nbytes
    assert held / len(text) < 1 + 1.51 * 12 / 8 + 0.01


def test_sql_agrees(spark):
    import duckdb
    import pandas as pd

    rows = corpus(9, 20)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = fmindex.repeats_removed(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept as binary), 256)")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(fmindex.SQL["op1_substrings"]).fetchall())


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 60), ("b", 80)))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (None, b)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in fmindex.repeats_removed(docs).collect()), key=str)
    assert got == [(1, 60, 0), (5, 60, 60), (5, 80, 0), (None, 80, 80)]


def test_texts_unlike_their_hash_fail_the_query():
    span = {"start": 0, "n": 1, "mask": None, "digest": passages.digest(b"a b")}
    assert passages.covered(3, 2, [span], lambda a, b: b"a b").tolist() == [True, True, False]
    with pytest.raises(RuntimeError):
        passages.covered(3, 2, [span], lambda a, b: b"a c")
