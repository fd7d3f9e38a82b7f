"""Column functions against plain Python, on rows that the driver's tables don't have."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import content_type as ct
from quarry.functions import hashing, paths, text, tokens


def column(spark, values, expression, *more):
    frame = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i long, a string" + "".join(f", {c} string" for c in more))
    return [r.x for r in frame.select("i", expression.alias("x")).orderBy("i").collect()]


def plain_tokens(s):
    s = re.sub("([一-鿿㐀-䶿豈-﫿])", r" \1 ", s)
    n = 0
    for word in re.split(r"[ \t\n\x0b\f\r]+", s):
        for t in re.findall(r"[!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~]+", word):
            b = len(t.encode())
            n += 1 if b <= 4 else 2 if b <= 8 else -(-b // 4)
    return n


SAMPLES = ["", " ", "a", "abcd abcde abcdefgh abcdefghi", "x.y,z", "日本語 text 漢字kanji", "é éé ééé éééé ééééé", "a\x0bb\fc\r\nd", "w" * 2000, "㐀豈", "😀😀 ok"]


def test_token_estimate(spark):
    got = column(spark, SAMPLES, tokens.estimate_tokens(F.col("a")))
    assert got == [plain_tokens(s) for s in SAMPLES] == [tokens.count_bytes(s.encode()) for s in SAMPLES]
    assert column(spark, ["a b"], tokens.estimate_tokens(F.col("a"), True)) == [4]
    assert column(spark, [None], tokens.estimate_tokens(F.col("a"))) == [None]


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_unit_counts_add_up(s):
    data = s.encode()
    units = tokens.unit_bytes(data)
    assert b"".join(units) == data
    assert tokens.unit_counts(units, data) == [tokens.count_bytes(u) for u in units]


def test_split_units(spark):
    assert column(spark, ["ab, c\n\n d"], tokens.split_units(F.col("a"))) == [["ab", ",", " ", "c", "\n\n ", "d"]]


def test_wordpiece(spark, tmp_path):
    wp = tokens.WordPiece(["un", "##aff", "##able", "a", "é"])
    assert [wp.count(w.encode()) for w in ("unaffable", "una", "é", "xyz", "w" * 101, "un, a")] == [3, 2, 1, 3, 0, 3]
    assert wp.count(b"un", True) == 3 and wp.count(b"w" * 101, True) == 3
    assert tokens.WordPiece.load(str(tmp_path / "none.json")).count(b"abcde") == 2
    (tmp_path / "t.json").write_text('{"model": {"vocab": {"ab": 0, "##c": 1}}}')
    assert tokens.WordPiece.load(str(tmp_path / "t.json")).count(b"abc") == 2
    assert column(spark, ["unaffable un", None], wp.udf()(F.col("a"))) == [4, None]


def slow_wordpiece(vocabulary, word):
    """Longest pieces first, a byte where none fits."""
    at = n = 0
    while at < len(word):
        mark = b"##" if at else b""
        at = next((e for e in range(len(word), at, -1) if mark + word[at:e] in vocabulary), at + 1)
        n += 1
    return n


@pytest.mark.parametrize("seed", range(20))
def test_wordpiece_automaton(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randrange(1, n)))
    vocabulary = [rng.choice(["", "##"]) + word(5) for _ in range(rng.randrange(1, 40))]
    words = [word(14).encode() for _ in range(200)] + [b"", b"z", b"a" * 100, b"a" * 101]
    wp, known = tokens.WordPiece(vocabulary), {v.encode() for v in vocabulary}
    assert wp.words(words).tolist() == [slow_wordpiece(known, w) if len(w) <= 100 else 0 for w in words]
    texts = [b" ".join(words[i : i + 7]) for i in range(0, 200, 7)] + [b"", b" "]
    assert wp.counts(texts).tolist() == [sum(slow_wordpiece(known, w) for w in x.split()) for x in texts]


QUERY = "SELECT a\n  FROM t"


@pytest.mark.parametrize("head", ["```", "```sql", "``` sql\t"])
@pytest.mark.parametrize("tail", ["", "\n", " \t\n\n"])
def test_fence_around_the_whole_text_goes(spark, head, tail):
    assert column(spark, [f"{head}\n{QUERY}\n```{tail}", f"{head}\n{QUERY}\n\n```{tail}"], text.strip_code_fence(F.col("a"))) == [QUERY, QUERY + "\n"]


def test_fence_on_one_line_goes(spark):
    assert column(spark, ["```ls -l```", "``````", "```x y ```"], text.strip_code_fence(F.col("a"))) == ["ls -l", "", "x y "]


def test_inner_fences_stay(spark):
    assert column(spark, [f"```\n{QUERY}\n```\nthen\n```"], text.strip_code_fence(F.col("a"))) == [f"{QUERY}\n```\nthen"]


@pytest.mark.parametrize("kept", ["", "a = 1", "'' x ''", f"see ```{QUERY}```", f"```sql\n{QUERY}", f"```sql\n{QUERY}\n``` and so on", "```md\n```", QUERY])
def test_other_texts_stay(spark, kept):
    assert column(spark, [kept], text.strip_code_fence(F.col("a"))) == [kept]


def test_comment_lines(spark):
    rows = [("a\n\n  b\n", "x.PY"), ("a", "x.cpp"), ("p {}\n", "s.css"), ("select 1", "q.sql"), ("t", "n.txt"), ("", "x.py"), ("\n\na", "x.go"), ("a\n\n", "x.py"), ("a", ".py")]
    got = column(spark, rows, text.comment_lines(F.col("a"), F.col("b")), "b")
    assert got == ["# a\n\n#   b\n", "// a", "/* p {} */\n", "-- select 1", "t", "", "\n\n// a", "# a\n\n", "a"]


def test_small_text_functions(spark):
    one = lambda f, *v: column(spark, list(v), f)
    a = F.col("a")
    assert one(text.normalize_whitespace(a), "  a \t b\n \n\n c \r\n", "", " \n ") == ["a b\n c", "", ""]
    assert one(text.count_lines(a), "a\nb\n", "") == [2, 0]
    assert one(text.is_binary(a), "a\0b", "\x01" * 4 + "a" * 6, "\x01" * 3 + "a" * 7, "", "\t\r\n" * 9) == [True, True, False, False, False]
    assert one(text.preview(a, 5), "abcde", "abcdef", "abcdé") == ["abcde", "abcde...", "abcd..."]
    assert one(text.tidy_response(a), "\n\na\n\n\n\nb\n") == ["a\n\nb"]
    assert one(text.escape_html(a), "<a&'\">") == ["&lt;a&amp;&#039;&quot;&gt;"]
    assert one(text.bytes_to_size(a.cast("long")), "0", "1", "1023", "1536", "5000000") == ["0 Byte", "1 Bytes", "1023 Bytes", "2 KB", "5 MB"]
    assert one(text.uptime(a.cast("long")), "59", "61", "3700") == ["59s", "1m 1s", "1h 1m"]
    assert one(text.temperature_label(a.cast("double")), "0.2", "0.5", "0.8", "0.9") == ["Precise", "Balanced", "Creative", "Unpredictable"]
    assert one(text.context_ratio(a).cast("double"), "compact", "balanced", "detailed", "x", None) == [0.5, 0.7, 0.9, 0.7, 0.7]
    assert one(text.leading_double(a), "3.5x", "x", "-2e1") == [3.5, 0.0, -20.0]
    assert one(text.leading_int(a, 7), " 12ab", "ab", "-3") == [12, 7, -3]
    assert one(text.trimmed(a), " \t x \n") == ["x"]
    assert one(text.timestamp_label(a.cast("long")), "0") == ["1970-01-01 00:00:00"]
    assert spark.range(1).select(text.sanitize_utf8(F.lit(b"a\xff\xc3b"))).first()[0] == "a??b"


def test_paths(spark):
    one = lambda f, *v: column(spark, list(v), f)
    a = F.col("a")
    names = ["a/b.txt", "a/.x", "b.tar.gz", "a/b", "/", "..", "x."]
    assert one(paths.extension(a), *names) == [".txt", "", ".gz", "", "", "", "."]
    assert one(paths.stem(a), *names) == ["b", ".x", "b.tar", "b", "", "..", "x"]
    assert one(paths.parent(a), "a/b.txt", "x", "/a/b/c") == ["a", "", "/a/b"]
    assert one(paths.language(a), "a.cpp", "a.CPP", "b.md", "c") == ["C++", "Other", "Markdown", "Other"]
    patterns = ["*node*", "*.min.js", "build/*", "LICENSE", "a\\b", "x*y", ""]
    assert one(paths.is_excluded(a, patterns), "q/node/z", "a.min.js", "build/x", "d/LICENSE", "a/b", "xzy", "LICENSES") == [True] * 5 + [False, False]
    assert one(paths.is_excluded(a, ["*"]), "z") == [True] and one(paths.is_excluded(a, ["**"]), "z") == [False]
    assert one(paths.has_extension(a, [".py"]), "a.py", "a.PY") == [True, False]
    assert one(paths.strip_query(a), "h?a#b", "h#b?a", "h") == ["h", "h", "h"]
    r = column(spark, ["http://h:1/p?q", "https://h", "none"], paths.url_parts(a))
    assert [tuple(x) for x in r] == [("http", "h:1", "/p?q"), ("https", "h", ""), ("", "", "")]
    arrays = spark.createDataFrame([(["a/b/c", "a/b/d"],), (["a/b"],), (["x", "y"],), (["a/b", "a/b/c"],), (["a\\b\\c", "a/b/d"],)], "p array<string>")
    assert [r.x for r in arrays.select(paths.strip_common_prefix(F.col("p")).alias("x")).collect()] == [["c", "d"], ["b"], ["x", "y"], ["b", "b/c"], ["c", "d"]]


CASES = [
    ("a\0b", "x.py", "binary"), ("text", "x.PY", "code"), ("class A {}", "x.md", "text"), ("one line", "", "text"), ("function x", "", "code"), ("a {", "", "code"),
    ("```\nx\n```\n" + "int a = 1;\n" * 5, "", "text"), ("int a = 1;\n" * 4, "", "code"), ("plain words here\n" * 12, "", "text"),
    ("import os\n" + "\n".join(f"    if (x{i}) {{" for i in range(9)), "", "code"),
    # early decision: five signs among the first nine of ten lines win over a later fence pair
    ("int a = 1;\n" * 5 + "words\n" * 4 + "last\n", "", "code"), ("words\n" * 4 + "int a = 1;\n" * 4 + "words\nint a = 1;\n" + "more\n" * 30, "", "code"),
    ("x\n" * 200 + "int a = 1;\n" * 300, "", "text"), ("\n".join(["word"] * 75) + "\n```\n```\n", "", "text"), ("", "", "text"),
]


def plain_type(body, uri):
    """The decision written out as a loop."""
    data = body.encode()
    head = data[:1024]
    if b"\0" in data or (head and sum(c < 32 and c not in (9, 10, 13) for c in head) / len(head) > 0.3):
        return "binary"
    ext = re.search(r"[^/]+?(\.[^.]*)$", uri)
    ext = ext[1].lower() if ext else ""
    if ext in ct.CODE_EXTENSIONS:
        return "code"
    if ext in ct.TEXT_EXTENSIONS:
        return "text"
    n = code = indent = semi = brace = 0
    lines = body.split("\n")
    for line in lines[:200]:
        if not line.strip(" \t\r\n"):
            continue
        n += 1
        indent += line[0] in " \t\r\n"
        if code >= 5 and n >= 10:
            return "code"
        code += any(re.search(p, line) for p in ct.CODE_LINES)
        brace += "{" in line or "}" in line
        semi += ";" in line
    if n < 3:
        return "code" if "{" in body or "function" in body or "class " in body else "text"
    if sum(x.startswith("```") for x in lines[:75]) >= 2:
        return "text"
    if code / n > 0.25 or (brace / n > 0.15 and code > 2) or (semi / n > 0.2 and code > 2) or (code > 5 and indent / n > 0.5):
        return "code"
    if code / n > 0.1 and indent / n > 0.6 and (brace / n > 0.05 or semi / n > 0.1):
        return "code"
    return "text"


def test_content_type(spark):
    import random

    rng = random.Random(4)
    stock = ["int a = 1;", "  foo();", "}", "plain words", "", "   ", "def f", "```", "\tif (a) {", "more prose; here", "public thing", "# note"]
    cases = [(b, u) for b, u, _ in CASES] + [("\n".join(rng.choice(stock) for _ in range(rng.randrange(30))), rng.choice(["", "a.bin", "d/e"])) for _ in range(150)]
    got = column(spark, cases, ct.content_type(F.col("a"), F.col("b")), "b")
    assert got[: len(CASES)] == [t for *_, t in CASES]
    assert got == [plain_type(b, u) for b, u in cases]


def test_hashes(spark):
    assert hashing.fnv1a64_hex(["", "a"]) == ["cbf29ce484222325", "af63dc4c8601ec8c"] and hashing.fnv1a64_hex([]) == []
    texts = ["é" * 7, "", "abc", "x" * 300, "日本", "ab"]

    def plain(data):
        h = hashing.OFFSET
        for b in data:
            h = (h ^ b) * hashing.PRIME % 2**64
        return f"{h:016x}"

    assert hashing.fnv1a64_hex(texts) == [plain(x.encode()) for x in texts]
    assert column(spark, ["a", None], hashing.fnv1a64(F.col("a"))) == ["af63dc4c8601ec8c", None]
    assert column(spark, ["ab", "x" * 50, ""], hashing.hash31(F.col("a")))[0] == 97 * 31 + 98
    assert column(spark, ["pw"], hashing.verify_salted(F.col("a"), hashing.salted_sha256(F.col("a"), F.lit("s")))) == [True]
    salted = column(spark, ["pw"], hashing.salted_sha256(F.col("a"), F.lit("s")))[0]
    assert salted == "s$" + hashlib.sha256(b"spw").hexdigest()
