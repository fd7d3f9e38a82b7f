import random
import re
import zlib
from collections import Counter

import pytest

from quarry.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    forms, out = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[v], v) for v in counts if near(w, v))
        form = others[0][1] if others and -others[0][0] >= 10 * n else None
        forms[w] = form
        out[w] = (form, n, len(others), counts[form] if form else None)
    root = lambda w: root(forms[w]) if forms[w] else w
    return {w: (form, root(w), n, k, m) for w, (form, n, k, m) in out.items()}


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.choice([7, 7, 8, 8, 9, 12]))) for _ in range(40)]
    text = []
    for w in base:
        chain = w
        for times in (300, 26, rng.choice([1, 2])):
            text += [rng.choice([chain, chain.replace("a", "A")])] * times
            at = rng.randrange(len(chain))
            chain = rng.choice([chain[:at] + chain[at + 1 :], chain[:at] + rng.choice("xabÿ") + chain[at:], chain[:at] + "Y" + chain[at + 1 :]])
    rng.shuffle(text)
    rows = [(rng.choice([i, i, None, 3]), rng.choice(["--", " ", "1", "ā", "\n"]).join(text[i : i + 40]), "clash", "x") for i in range(0, len(text), 40)]
    return [*rows, rows[0], (5, None, "", ""), (6, "", "", ""), (7, "short words ÀÉÎÕÜ×÷ ÀÉÎÕÜ×÷", "", "")]


@pytest.mark.parametrize("most", [spelling.MOST, 6])
def test_against_all_pairs(spark, most):
    rows = corpus(3)
    got = spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA), most).collect()
    want = brute(rows)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert sum(w[0] is not None for w in want.values()) > 20
    assert any(form and root != form for form, root, *_ in want.values())


def test_blocks_stay_small_and_count_each_pair_once(spark):
    rng = random.Random(9)
    # words that share long prefixes and suffixes
    words = {"".join(("prefixed", rng.choice("abcdefg"), rng.choice("abcdefg"), rng.choice(["", "h"]), "suffixed")) for _ in range(400)}
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = spelling.near_words(frame, 20).collect()
    assert {r.word: r.n_near for r in got} == {w: sum(near(w, v) for v in words) for w in words}
    sizes = spelling.blocks(frame, 20).groupBy("key", "m", "a", "b").count().collect()
    assert all(r["count"] <= 20 or r.m - r.a - r.b == 1 for r in sizes)


def test_very_long_words_and_texts(spark):
    long = "ab" * 50_000
    rows = [(1, f"{long} {long}x " * 30, "", ""), (2, f"{long[1:]} " * 2 + "wordword " * 300_000, "", "")]
    got = {r.word: (r.n, r.n_near) for r in spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {w: (n, k) for w, (_, _, n, k, _) in brute(rows).items()}
    assert got == want and len(got) >= 3


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "alone alonely", "", "")] * 2, SCHEMA)).collect()[0].root == "alonely"
