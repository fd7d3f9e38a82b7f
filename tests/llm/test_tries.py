import hashlib
import random
import zlib

from quarry.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, digest long"


def brute(rows, rebuilt):
    """Nodes from prefixes as tuples."""
    sha = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, sha(role, text), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    whole = own
    if rebuilt:
        giver = lambda c: c - (c % 5 if c >= 0 else -(-c % 5))
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        whole = {c: own.get(giver(c), [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p and len(q) == len(p) + 1 for q in below)]
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(path))))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        children = sum(len(p) == len(path) + 1 for p in below)
        out.append((len(path), min(convs), min(members[path[:-1]]) if path else None, len(convs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame, rebuilt):
    rows = tries.prefix_trie(frame, rebuilt).collect()
    return sorted(((r.depth, r.conv_id, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256) for r in rows), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(-12, n):
        if rng.random() < 0.9:
            turns = rng.choice([0, 1, 3, 8, 12])
            same = rng.random() < 0.5
            for t in range(turns):
                text = f"täxt {t}" if same or rng.random() < 0.6 else f"other {rng.randrange(4)}"
                rows.append((conv, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice([text, text, None, ""]), "clash", 5))
    rows += [(7, 0, "user", "again", "clash", 5)] * 3 + [(None, 0, "user", "nobody's", "clash", 5)]
    rng.shuffle(rows)
    return rows


def test_against_plain_prefixes(spark):
    rows = corpus(1)
    frame = spark.createDataFrame(rows, SCHEMA)
    for rebuilt in (False, True):
        assert found(frame, rebuilt) == brute(rows, rebuilt)


def test_blocks_of_turns(spark, monkeypatch):
    monkeypatch.setattr(tries, "BLOCK", 3)
    rows = corpus(2, 20)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame, True) == brute(rows, True)
    long = [(c, t, "user", f"turn {t}", "", 0) for c in (1, 2, 3) for t in range(40 - c)]
    assert found(spark.createDataFrame(long, SCHEMA), False) == brute(long, False)


def test_one_long_conversation_and_many_equal_ones(spark):
    rows = [(1, t, "user", "x" * (t % 7), "", 0) for t in range(3000)] + [(c, 0, "user", "hello", "", 0) for c in range(2, 400)]
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(8), False)
    assert len(got) == 3002
    ends = hashlib.sha256(",".join(map(str, range(2, 400))).encode()).hexdigest()
    assert (1, 2, 1, 398, 0, 1, 397 * 5, ends) in got
    assert (0, 1, None, 399, 2, 2, 397 * 5, hashlib.sha256().hexdigest()) in got


def test_empty_table_null_ids_and_very_long_texts(spark):
    assert found(spark.createDataFrame([], SCHEMA), True) == []
    assert found(spark.createDataFrame([(None, 1, "a", "b", "", 0)], SCHEMA), True) == []
    rows = [(c, 0, None, "é" * 2_000_000, "", 0) for c in (5, 6)]
    assert found(spark.createDataFrame(rows, SCHEMA), False)[1][6] == 4_000_000
    # the giver of 8 is absent, so its rebuilt form may lose turns
    rows = [(8, t, "user", "t", "", 0) for t in range(2)]
    assert found(spark.createDataFrame(rows, SCHEMA), True) == brute(rows, True)
