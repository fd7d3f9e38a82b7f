import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import ctw

SCHEMA = "doc_id long, text string, n_tokens string, key string"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abc é") for _ in range(rng.randrange(1, 5))) for _ in range(30)] + ["The", "THE"]
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (5, rows[5][1]), (None, "abc the"), (n + 2, "zzz QQQ")]


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0


def lower(t):
    return (t or "").encode().lower().split()


def brute(rows):
    """Context-tree weighting written out over dictionaries, in plain probabilities."""
    depth = ctw.DEPTH
    nodes = defaultdict(lambda: [0, 0])

    def steps(words):
        data = bytes(depth) + b" ".join(words) + b"\xff"
        for i in range(depth, len(data)):
            for k in range(8):
                prefix = (1 << k) | (data[i] >> (8 - k))
                yield [(data[i - d : i], prefix) for d in range(depth + 1)], data[i] >> (7 - k) & 1

    for d, t in rows:
        if not held(d):
            for path, bit in steps(lower(t)):
                for node in path:
                    nodes[node][bit] += 1
    children = defaultdict(set)
    for context, prefix in list(nodes):
        if context:
            children[context[1:], prefix].add((context, prefix))

    def estimate(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    total, own = {}, {}
    for context, prefix in sorted(nodes, key=lambda x: -len(x[0])):
        e = estimate(*nodes[context, prefix])
        if len(context) == depth:
            total[context, prefix], own[context, prefix] = e, 1.0
        else:
            longer = sum(total[c] for c in children[context, prefix])
            total[context, prefix] = math.log(0.5) + np.logaddexp(e, longer)
            own[context, prefix] = math.exp(math.log(0.5) + e - total[context, prefix])
    out = []
    for d, t in rows:
        score = 0.0
        for path, bit in steps(lower(t)):
            p = 0.5
            for node in reversed(path):
                n = nodes.get(node, [0, 0])
                kt = (n[bit] + 0.5) / (sum(n) + 1)
                w = own.get(node, 1.0 if len(node[0]) == depth else 0.5)
                p = w * kt + (1 - w) * p
            score += math.log10(p)
        out.append((d, score))
    return out


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = sorted(ctw.scores(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    counts = Counter(w for d, t in rows if not held(d) for w in [*lower(t), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, s, t) for (d, s), (_, t) in zip(brute(rows), rows, strict=True)), key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(rows)
    for r, (d, score, t) in zip(got, want, strict=True):
        tokens = [*lower(t), None]
        assert (r.doc_id, r.held_out, r.n_tokens, r.train_tokens) == (d, held(d), len(tokens), n)
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert r.score == pytest.approx(score)
    assert ctw.scores(docs.limit(0)).count() == 0


def test_batches_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame([(d, t) for d, t in corpus()], "doc_id long, text string")
    one = sorted(map(str, ctw.scores(docs).selectExpr("doc_id", "n_known", "round(base_score, 9)", "round(score, 9)").collect()))
    monkeypatch.setattr(ctw, "BATCH", 100)
    monkeypatch.setattr(ctw, "HELD", 40)
    assert sorted(map(str, ctw.scores(docs).selectExpr("doc_id", "n_known", "round(base_score, 9)", "round(score, 9)").collect())) == one


def test_bits_per_byte(spark):
    texts = {1: "Abc  abc\n", 2: "", 3: None, 4: "é"}
    for r in ctw.scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        assert r.n_bytes == len(b" ".join(lower(texts[r.doc_id]))) + 1
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.5, 1e3, 1e9])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)


def test_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64))
    table = ctw.Table(keys, np.arange(len(keys)))
    assert (table.get(keys[::-1]) == np.arange(len(keys))[::-1]).all()
