import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
from quarry.llm import common, decontaminate, quality
from tests.llm.test_copies import brute
from tests.llm.test_mixing import water
from tests.llm.test_sharding import least_capacity


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    vocab = [word() for _ in range(400)]
    para = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    items = [(i, para(25)) for i in range(4)]
    docs = []
    for i in range(150):
        r = rng.random()
        if r < 0.15 and docs:
            docs.append(rng.choice(docs))
        elif r < 0.3 and docs:
            ws = rng.choice([d for d in docs if "\n" not in d] or docs).split(" ")
            ws[rng.randrange(len(ws))] = "changed"
            docs.append(" ".join(ws))
        elif r < 0.4:
            docs.append(para(20) + "\n" + rng.choice(items)[1] + "\n" + para(20))
        elif r < 0.5:
            docs.append("spam " * 50)
        else:
            docs.append(para(rng.randrange(12, 200)) + ("\nhome | about | contact" if r > 0.9 else ""))
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(docs)]
    return [*rows, (150, None, "en", "s1", 0), (151, "", "en", None, 0)], items


def fails(line):
    """The line rules, written out by hand."""
    words = line.split()
    n = len(words)
    if not n:
        return False
    bare = [w.lower().strip(".,:;|/") for w in words]
    return (
        2 * sum(c in "#*$%&<>" for c in line) >= n
        or 3 * line.count("|") >= n
        or (n <= 12 and 2 * sum(w.encode() in quality.NAVIGATION for w in bare) > n)
        or (n <= 25 and any(p.decode() in line.lower() for p in quality.BOILERPLATE))
        or (n >= 3 and 2 * sum(w[-2:] in ("!!", "??") or w.endswith("...") for w in words) >= n)
    )


def cleaned(text):
    """The text without failing lines, None if the document goes."""
    words = text.split()
    n = len(words)
    grams = [tuple(words[i : i + 5]) for i in range(n - 4)]
    times = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    size = lambda x: len("".join(x.split()).encode())
    if n < 10 or 100 * len(repeated) > 20 * n or sum(size(x) for x in lines if fails(x)) > 0.5 * size(text):
        return None
    return "\n".join(x for x in lines if not fails(x))


def by_hand(rows, items):
    kept = {}
    for d, t, _, s, _ in rows:
        if (x := cleaned(t or "")) is not None:
            kept[d] = (x, s)
    root = brute([(d, t) for d, (t, _) in kept.items()])
    kept = {d: x for d, x in kept.items() if root[d] == d}
    held = lambda t: any(re.sub(r"\s+", " ", q) in re.sub(r"\s+", " ", t) for _, q in items)
    kept = {d: x for d, x in kept.items() if not held(x[0])}
    sizes = {}
    for t, s in kept.values():
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = water(sizes, (5, 2, 1), 1.5, 2.0)
    out = []
    for s in sizes:
        whole = int(target[s] // sizes[s])
        budget, got, last = target[s] - whole * sizes[s], 0, False
        for h, d in sorted((hashlib.md5(f"{d}:{x[0]}".encode()).hexdigest()[:10], d) for d, x in kept.items() if x[1] == s):
            n = len(kept[d][0].split())
            extra = False
            if not last:
                last = got + n > budget
                extra = not last or got + n - budget < budget - got
                got += n
            out += [(d, kept[d][0])] * (whole + extra)
    return out


def test_run_against_a_plain_version(spark, tmp_path):
    rows, items = texts()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = by_hand(rows, items)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in want)
    groups = {}
    for d, t in sorted(want):
        groups[t] = groups.get(t, 0) + len(t.encode()) + 1
    shards = {}
    for r in got:
        shards[r.shard] = shards.get(r.shard, 0) + r.size
    assert max(shards.values()) == least_capacity(list(groups.values()), 16)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert decontaminate.COVERED == 0.5


def test_ids_that_are_null_or_repeat_and_clashing_columns(spark, tmp_path):
    """Rows are told apart by doc_id and text at every stage; names that the operators use themselves don't matter."""
    rows, items = texts()
    rng = random.Random(5)
    own = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    fresh = [own() for _ in range(4)]
    more = [(None, fresh[0]), (None, fresh[1]), (None, rows[0][1]), (500, fresh[2]), (500, fresh[3]), (501, fresh[2]), (500, fresh[2]), (None, own() + " " + items[0][1]), (None, None)]
    extra = "doc long, same long, node string, shard string, size string, hash string, whole string, copies string, gone string, lines string"
    names = extra.split(", ")
    table = [(*r, 0, 0, *[str(r[0])] * (len(names) - 2)) for r in [*rows, *[(d, t, "en", "s1", 0) for d, t in more]]]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = common.settle(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    left = [(None, fresh[0]), (None, fresh[1]), (500, fresh[2]), (500, fresh[3])]
    assert sorted((x for x in found if x[0] is None or x[0] >= 500), key=str) == sorted(left, key=str)
    assert len(found) == len(set(found))
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, str(tmp_path))
    assert mixed.columns == docs.columns
    out = corpus_pipeline.STAGES[4][1](spark, mixed, str(tmp_path))
    assert out.count() == mixed.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()
