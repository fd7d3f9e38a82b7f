import random

import duckdb
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.components import components

SCHEMA = "doc_id long, text string, component_id string"


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    """doc -> least doc reachable, by comparing all pairs."""
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in fps}


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    vocab = ["Word%d" % i for i in range(300)] + ["É", "ñu", "x\x1fy"]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out)[1].split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append((i, " ".join(words)))
        else:
            out.append((i, rng.choice([" ", "\n", "  "]).join(rng.choice(vocab) for _ in range(rng.randrange(1, 200)))))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (n + 4, "ONE")]


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {d: plain(t) for d, t in rows}
    assert {d: r.fp % (1 << 64) for d, r in got.items()} == fps
    assert {d: r.component_id for d, r in got.items()} == brute(fps)
    assert simhash.near_duplicates(docs).count() == len(rows)


def test_dense_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 20)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) & 0xF for _ in range(9)} | {(0xABC << 40) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    fps = {f: f for f in fps} | {f: f for f in (rng.getrandbits(64) for _ in range(300))}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    by_root, by_brute = {}, {}
    for f, d in brute(fps).items():
        by_root.setdefault(roots.get(signed[f], signed[f]), set()).add(f)
        by_brute.setdefault(d, set()).add(f)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_brute.values()))


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d", "x"), (7, "a b c d", "x"), (9, "a b c d", "x"), (9, "a b c d", "x")], SCHEMA)
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {7}


def test_equals_sql(spark, tmp_path):
    """Shingles of 1 to 200 bytes, so that every step of the hash is taken; near copies, equal rows, null ids and texts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdé") for _ in range(n)) for n in [*range(1, 24), 40, 41, 66, 67]]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]] + texts[:5] + [None, "", " \t", "A b", "a B", "X" * 31, "X" * 32, "X" * 33]
    data = [(None if i % 11 == 0 else i % 70, t) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = simhash.op7_simhash(spark, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"}))
    want = con.execute(simhash.SQL["op7_simhash"])
    assert [c[0] for c in want.description] == got.columns
    by = lambda x: tuple((v is None, v) for v in x)
    rows = sorted(map(tuple, got.collect()), key=by)
    assert rows == sorted(want.fetchall(), key=by)
    assert [int(r[1], 16) for r in rows] != [0] * len(rows)
