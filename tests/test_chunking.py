"""Chunkers against step-by-step versions written from their rules, and their invariants."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions.tokens import count_bytes, unit_bytes
from quarry.operators import chunking
from quarry.operators.chunking import Limits


def slow_text(text, limits):
    units = unit_bytes(text)
    tok = [count_bytes(u) for u in units]
    pos = [sum(map(len, units[:i])) for i in range(len(units) + 1)]
    shared = min(limits.shared, int(0.6 * limits.most))
    out, start = [], 0
    while start < len(units):
        end, total = start, 0
        while end < len(units) and total + tok[end] <= limits.most:
            total += tok[end]
            end += 1
        if end == start:
            total, end = tok[end], end + 1
        out.append((b"".join(units[start:end]), total, pos[start], pos[end]))
        if end == len(units):
            break
        back, walked = 0, 0
        while shared and back < shared and walked < end - start:
            walked += 1
            back += tok[end - walked]
        # units that cost nothing beyond the one that crosses belong to the walk only if they come before it
        start = max(start + 1, end - walked)
    return out


def slow_lines(text, limits):
    rows = text.split(b"\n")
    if rows[-1] == b"":
        rows.pop()
    lines = [p for r in rows for p in chunking.break_line(r, limits.most)]
    tok = [count_bytes(x) for x in lines]
    out, start = [], 0
    while start < len(lines):
        end, total = start, 0
        while end < len(lines) and total + tok[end] <= limits.most:
            total += tok[end]
            end += 1
        if end == start:
            total, end = tok[end], end + 1
        out.append((b"".join(lines[start:end]), total, start, end))
        if end == len(lines):
            break
        n = back = 0
        while n < end - start - 1 and back + tok[end - 1 - n] < limits.shared:
            back += tok[end - 1 - n]
            n += 1
        start = end - n
    return out


def sample(seed):
    rng = random.Random(seed)
    words = ["a", "word", "longerword", "x.y", "é" * rng.randrange(1, 9), "w" * rng.randrange(1, 60), "日本", ",", ";"]
    return rng.choice(["\n", " "]).join(rng.choice([" ", "", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(30))).encode()


@pytest.mark.parametrize("seed", range(60))
def test_windows_step_by_step(seed):
    rng = random.Random(seed)
    limits = Limits(rng.randrange(1, 10), rng.choice([8, 20, 50]), rng.choice([0.0, 0.1, 0.3, 0.7]))
    text = sample(seed)
    assert [(p.text, p.tokens, p.start, p.end) for p in chunking.text_windows(text, limits)] == slow_text(text, limits)
    assert [(p.text, p.tokens, p.start, p.end) for p in chunking.line_windows(text, limits)] == slow_lines(text, limits)


@given(st.binary(max_size=200).map(lambda b: b.decode(errors="replace").encode()), st.integers(4, 40), st.sampled_from([0.0, 0.1, 0.5, 0.9]))
@settings(max_examples=150, deadline=None)
def test_invariants(text, most, overlap):
    limits = Limits(2, most, overlap)
    for windows in (chunking.text_windows, chunking.line_windows):
        pieces = windows(text, limits)
        assert all(a.start < b.start and b.start <= a.end for a, b in zip(pieces, pieces[1:], strict=False))
        assert all(p.tokens == count_bytes(p.text) or p.unit == "line" or not p.text.isascii() for p in pieces)
    whole = chunking.text_windows(text, Limits(2, most, 0.0))
    assert b"".join(p.text for p in whole) == text


def test_merge_keeps_numbers_and_one_merge_each():
    make = lambda *sizes: [chunking.Piece(b"w " * n, n, i, i + 1, "char") for i, n in enumerate(sizes)]
    out = chunking.merge_small(make(2, 3, 9, 1), Limits(5, 10))
    assert [(p.number, p.tokens, p.start, p.end) for p in out] == [(0, 5, 0, 2), (2, 9, 2, 3), (3, 1, 3, 4)]
    assert [p.number for p in chunking.merge_small(make(2, 9), Limits(5, 10))] == [0, 1]


def test_break_line():
    assert chunking.break_line(b"a b", 9) == [b"a b\n"]
    assert chunking.break_line(b"aaaa bbbb cccc", 2) == [b"aaaa bbbb \n", b"cccc\n"]
    assert chunking.break_line(b"w" * 100, 2) == [b"w" * 100 + b"\n"]


def test_overlap_is_single_precision():
    assert Limits(50, 450, 0.1).shared == 45 and Limits(50, 10, 0.7).shared == 6 or Limits(50, 10, 0.7).shared == 7


def test_documents(spark):
    rows = [("a.txt", "word " * 900), ("b.py", "x = 1\n" * 400), ("c", "a\0b"), ("d.txt", ""), ("e.txt", None), ("f.txt", " \n "), ("g.py", "y" * 5000)]
    got = chunking.chunk_documents(spark.createDataFrame(rows, "source string, content string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_uri, []).append(r)
    assert set(by) == {"a.txt", "b.py", "g.py"}
    assert {r.metadata.type for r in by["a.txt"]} == {"text"} and {r.metadata.unit for r in by["b.py"]} == {"line"}
    assert all(r.metadata.token_count <= 450 for r in by["a.txt"] + by["b.py"])
    assert by["a.txt"][0].chunk_id == "a.txt_0"
    plain = chunking.chunk_documents(spark.createDataFrame(rows, "source string, content string"), semantic=False).collect()
    assert {r.metadata.unit for r in plain} == {"char"}
