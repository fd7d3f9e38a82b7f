import hashlib
import random

import pytest

from quarry.llm import lines

SCHEMA = "doc_id long, text string, gone string, lines string"


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def cut(text):
    """Chunks of a text, written out line by line."""
    ls = text.split("\n")
    n, h = len(ls), [int(md5(x)[:8], 16) for x in ls]
    roll = [None] + [(h[i] + lines.BASE * h[i - 1]) % lines.MODULUS for i in range(1, n)]
    at = []
    for i in range(n):
        low = 2 <= i <= n - 2 and roll[i] < roll[i + 1] and (roll[i - 1] is None or roll[i] < roll[i - 1])
        run = i + 2 < n and h[i] == h[i + 1] == h[i + 2] and (i == 0 or h[i - 1] != h[i])
        ended = i >= 3 and h[i - 1] == h[i - 2] == h[i - 3] != h[i]
        if i == 0 or low or run or ended or i - at[-1] == 16:
            at.append(i)
    return [ls[a:b] for a, b in zip(at, [*at[1:], n], strict=True)]


def brute(rows, order):
    """(doc_id, text) -> (lines, removed, chunks removed, text left)"""
    seen, out = {}, {}
    for d, t in sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0, order[x])):
        kept, removed, times = [], 0, 0
        for k, chunk in enumerate(cut(t)):
            if len(chunk) >= 2 and seen.setdefault("\n".join(chunk), (d, t, k)) != (d, t, k):
                removed, times = removed + len(chunk), times + 1
            else:
                kept += chunk
        out[d, t] = (t.count("\n") + 1, removed, times, "\n".join(kept))
    return out


def corpus(n=80, seed=2):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    shared = [[line() for _ in range(rng.randrange(4, 20))] for _ in range(5)]
    rows = []
    for i in range(n):
        ls = [line() for _ in range(rng.randrange(6))]
        for _ in range(rng.randrange(3)):
            ls += rng.choice(shared) + [line() for _ in range(rng.randrange(4))]
        rows.append((i, "\n".join(ls)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n\n\n"), (n + 3, "\n\n\n"), (n + 4, "only"), (n + 5, rows[3][1]), (n + 6, "x\r\n" * 40)]


@pytest.mark.parametrize("told", [lines.MOST_TOLD, -1])
def test_against_brute_force(spark, monkeypatch, told):
    monkeypatch.setattr(lines, "MOST_TOLD", told)
    rows = corpus()
    # repeated rows, rows without a doc_id, a doc_id of several texts
    rows = [*rows, rows[3], (None, rows[3][1]), (None, rows[9][1] + "\nmore"), (None, None), (7, rows[8][1]), (7, "a\nb\n" + rows[9][1])]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    want = brute(rows, {(r.doc_id, r.text): r.same for r in lines._rows(docs).collect()})
    got = [(r.doc_id, r.n_lines, r.n_removed, r.n_chunks_removed, r.text) for r in lines.lines_removed(docs).collect()]
    assert sorted(got, key=str) == sorted(((d, *want.get((d, t), (0, 0, 0, None))) for d, t in rows), key=str)
    assert sum(x[1] for x in want.values()) > 200
    assert lines.lines_removed(docs.limit(0)).count() == 0


def test_chunks_are_the_text_and_have_bounds(spark):
    rows = [*corpus(40, 5), (900, "\n".join(str(i) for i in range(3000)))]
    docs = spark.createDataFrame([(d, t) for d, t in rows if t], "doc_id long, text string")
    parts = {}
    for r in lines.chunks(lines._rows(docs)).collect():
        parts.setdefault(r.doc, []).append((r.chunk, r.text, r.n_lines))
    for d, t in rows:
        if t:
            own = sorted(parts[d])
            assert "\n".join(x for _, x, _ in own) == t
            assert [x.split("\n") for _, x, _ in own] == cut(t) and [n for *_, n in own] == [len(x) for x in cut(t)]
    sizes = [n for *_, n in parts[900]]
    assert min(sizes) == 2 and max(sizes) <= 16 and 2.5 < sum(sizes) / len(sizes) < 3.5


def test_runs_of_equal_lines_go_whatever_the_line(spark):
    """40 equal lines in two documents, amid other lines: all of the second document's, and all but 16 + 8 of the first's."""
    for line in ("", "x", "buy now", "the same line again"):
        docs = spark.createDataFrame([(1, "\n".join(["head a", "b", *[line] * 40, "tail"])), (2, "\n".join(["other", *[line] * 40, "end", "c"]))], "doc_id long, text string")
        assert {r.doc_id: r.n_removed for r in lines.lines_removed(docs).collect()} == {1: 16, 2: 40}


def test_share_of_shared_passages_that_goes(spark):
    """Passages of 12 lines in 60 documents of other lines: most lines of all but the first occurrence go."""
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefgh") for _ in range(9))
    shared = [[line() for _ in range(12)] for _ in range(5)]
    rows = [(i, "\n".join([line() for _ in range(rng.randrange(1, 9))] + shared[i % 5] + [line() for _ in range(rng.randrange(1, 9))])) for i in range(60)]
    gone = sum(r.n_removed for r in lines.lines_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert 0.55 < gone / (55 * 12) <= 1


def test_plan_is_native(spark):
    docs = spark.createDataFrame(corpus(10), "doc_id long, text string")
    plan = lines.lines_removed(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
