import random

import numpy as np

from quarry.llm import common, copies, minhash, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc -> least doc reachable over pairs of similarity 0.8 or more or within three bits, by comparing all pairs."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = [(d, shingles(t), simhash.fingerprint((t or "").encode())) for d, t in rows]
    for i, (d, a, x) in enumerate(own):
        for e, b, y in own[:i]:
            if a == b or len(a & b) >= 0.8 * len(a | b) or (x ^ y).bit_count() <= 3:
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {d: find(d) for d in root}


def corpus(n=150, seed=4):
    rng = random.Random(seed)
    vocab = [f"Word{i}" for i in range(300)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out)[1].split(" ")
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append((i, " ".join(words)))
        else:
            out.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 250)))))
    return [*out, (n, None), (n + 1, " \n"), (n + 2, "One two"), (n + 3, "one  TWO")]


def test_keep_one_against_all_pairs(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(want[d] != d for d in want) > 30
    assert {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()} == want
    assert sorted(r.doc_id for r in copies.keep_one(docs).collect()) == sorted(set(want.values()))
    monkeypatch.setattr(copies, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(copies, "LISTED", 2)
    assert {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()} == want
    assert copies.near_copies(docs.limit(0)).count() == 0


def test_one_changed_word_beyond_three_bits(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(500)}" for _ in range(90)]
    pairs = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(20, 80, 7)]
    far = next(t for t in pairs if (simhash.fingerprint(t.encode()) ^ simhash.fingerprint(" ".join(words).encode())).bit_count() > 3)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, far)], "doc_id long, text string")
    assert [r.doc_id for r in copies.keep_one(docs).collect()] == [1]


def test_exact_threshold():
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    alone = np.arange(2)
    assert minhash.forest([a, b], alone, alone, False, copies.PERCENT) == [(0, 1)]  # 8 of 10
    assert minhash.forest([a[:8], b[:8]], alone, alone, False, copies.PERCENT) == []  # 7 of 9


def test_rows_without_a_doc_id_and_repeated_rows(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(5)]
    near = texts[0].replace(texts[0].split()[40], "changed", 1)
    rows = [(1, texts[0], "a", 1), (2, near, "b", 2), (None, texts[0], "c", 3), (None, texts[1], "d", 4), (None, texts[1] + " end", "e", 5), (3, texts[2], "f", 6), (3, texts[2], "f", 6), (3, texts[3], "g", 7), (4, texts[3], "h", 8), (5, None, "i", 9), (6, "", "j", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, same long")
    for bound in (500_000, 0):  # keys broadcast, and shuffled
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        kept = copies.keep_one(docs)
        assert kept.columns == docs.columns
        got = sorted((r.node, r.same) for r in kept.collect())
        assert got in ([("a", 1), (x, n), ("f", 6), ("g", 7), ("i", 9)] for x, n in (("d", 4), ("e", 5)))
    found = copies.near_copies(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id) == [(1, 1), (2, 1), (3, 3), (3, 3), (3, 3), (4, 3), (5, 5), (6, 5)]
    assert sorted(str(r.component_id) for r in found if r.doc_id is None) == ["1", "None", "None"]
