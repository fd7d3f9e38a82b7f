import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import passages, suffixes

SCHEMA = "doc_id long, text string, n_bytes string, spans string"


def brute(rows, width=200):
    """text -> result: every row counts, whatever its doc_id."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = {}
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[t] = (len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone, strict=False) if not g))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choice("abcde é\n") for _ in range(k))
    shared = [piece(rng.choice((170, 195, 200, 230, 400))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(shared) if rng.random() < 0.5 else piece(rng.randrange(120)) for _ in range(rng.randrange(6)))
        rows.append((i * 2, text))
    return [*rows, (1, None), (3, ""), (5, "ab" * 180), (7, "x" * 420), (9, "abc" * 70), (11, rows[4][1]), (13, rows[4][1])]


@pytest.mark.parametrize("hot", [None, "told", "joined"])
def test_against_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(passages, "HOT_LEAST", 3)
        monkeypatch.setattr(passages, "HOT_MOST", 3)
        monkeypatch.setattr(passages, "HOT_TOLD", 10_000 if hot == "told" else 0)
    monkeypatch.setattr(passages, "PIECE", 90)
    rows = corpus(3 + bool(hot))
    rows = [*rows, (None, rows[4][1]), (None, None), (8, rows[6][1] + "z"), (8, "y" + rows[7][1]), rows[9], rows[9]]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    want = brute(rows)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.repeats_removed(docs).collect()]
    assert sorted(got, key=str) == sorted(((d, *want[(t or "").encode()]) for d, t in rows), key=str)
    assert suffixes.repeats_removed(docs.limit(0)).count() == 0


def test_one_id_with_two_texts(spark):
    rng = random.Random(6)
    a, b = ("".join(rng.choice("abcdef") for _ in range(n)) for n in (300, 500))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.repeats_removed(docs).collect()) == [(1, 300, 300), (1, 500, 0), (2, 300, 300)]


def test_repeated_rows_are_copies(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "short"), (2, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in suffixes.repeats_removed(docs).collect()) == [(1, 300, 1)] * 2 + [(2, 0, 0)] * 2


def test_mergesort_orders_suffixes():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 500).astype(np.uint8)
    starts = rng.permutation(460)
    lengths = np.minimum(500 - starts, 40)
    order = suffixes.SuffixSort(text, 11).sort(starts, lengths)
    cut = [text[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
    assert [cut[i] for i in order] == sorted(cut)


def test_collision_is_met_by_another_base(monkeypatch):
    calls = []

    def once(table, width, seed):
        calls.append(seed)
        if len(calls) == 1:
            raise suffixes.Collision
        return []

    monkeypatch.setattr(suffixes, "_repeated", once)
    assert suffixes.repeated_windows(None) == [] and calls == list(suffixes.SEEDS[:2])
