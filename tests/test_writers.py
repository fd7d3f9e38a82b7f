"""Writers that see each other, updates that read only what has changed, statistics kept by commit."""

import os
import random
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quarry import encoders
from quarry.engine import Engine
from quarry.operators import stats
from quarry.sources import scan
from quarry.sources.store import Commit, Conflict, Store

ROW = "is_url boolean, content string, source string, file_size long, last_modified long"


@pytest.fixture
def make(spark, tmp_path):
    return lambda: Store(spark, str(tmp_path / "store"), encoders.hashing_encoder(4), 4)


@pytest.fixture
def rows(spark):
    return lambda **texts: spark.createDataFrame([(False, t, n, len(t), 1) for n, t in texts.items()], ROW)


def state(store):
    """Paths that are tracked, and chunks by source; each id once, each path once, each chunk with its vector."""
    paths, chunks = [r.path for r in store.tracked().collect()], store.table("chunks").collect()
    ids = sorted(r.id for r in chunks)
    assert len(set(paths)) == len(paths) and len(set(ids)) == len(ids)
    assert ids == sorted(r.id for r in store.table("vectors").collect())
    return sorted(paths), {r.source_id: r.content for r in chunks}


def between(store, act):
    """Lets ``act`` happen once, after ``store`` has read its snapshot and before it publishes."""
    publish = store._publish

    def late(*a):
        store._publish = publish
        act()
        return publish(*a)

    store._publish = late


def test_two_updates_of_one_new_file(make, rows):
    store, other = make(), make()
    files = rows(same="the same file")
    between(store, lambda: other.update(files))
    assert store.update(files) == {"unchanged": 1}  # begun anew, it finds the other's work done
    assert state(store) == (["same"], {"same": "the same file"})


def test_three_writers_and_deletions(make, rows):
    a, b, c = make(), make(), make()
    a.update(rows(x="x one", y="y one", z="z one"))
    between(a, lambda: (b.update(rows(x="x one", y="y one changed", z="z one")), c.delete_source("z")))
    assert a.update(rows(x="x one and more", y="y one", z="z one")) == {"modified": 1, "unchanged": 2}
    assert state(b)[1] == {"x": "x one and more", "y": "y one changed"}
    # what others do in other paths is no conflict
    between(a, lambda: b.commit(files=scan.file_rows(rows(other="only tracked"))))
    with a.transaction():
        a.delete_source("x")
        a.embed(rows(w="w one"))
    assert state(c) == (["other", "w", "y"], {"w": "w one", "y": "y one changed"})
    between(a, lambda: b.delete_source("y"))
    with pytest.raises(Conflict), a.transaction():
        a.delete_source("y")
    between(a, b.clear)
    with pytest.raises(Conflict):
        a.delete_source("w")
    assert state(c) == ([], {})


def test_writers_at_the_same_time(make, rows):
    stores = [make() for _ in range(3)]
    names = [[f"own{i}", "shared"] for i in range(3)]
    errors = []

    def work(i):
        try:
            stores[i].embed(rows(**{n: f"text of {n}" for n in names[i]}))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert state(make()) == (["own0", "own1", "own2", "shared"], {n: f"text of {n}" for n in ("own0", "own1", "own2", "shared")})


def test_a_number_is_given_to_one_writer(make):
    stores, gate = [make() for _ in range(4)], threading.Barrier(4)

    def work(i, number):
        gate.wait()
        return stores[i]._write_lines([Commit(f"data-{number}-{i}", number=number)])

    with ThreadPoolExecutor(4) as pool:
        for number in range(1, 21):
            won = list(pool.map(work, range(4), [number] * 4))
            assert won.count(True) == 1
            assert stores[0]._log()[-1].folder == f"data-{number}-{won.index(True)}"


def test_compaction_while_others_write(make, rows):
    a, b = make(), make()
    a.update(rows(x="x one", y="y one"))
    between(a, lambda: (b.update(rows(x="x two!", z="z one"))))
    assert a.compact()  # stands where it was read
    assert state(b) == (["x", "z"], {"x": "x two!", "z": "z one"})
    between(a, b.compact)
    assert not a.compact()
    a.update(rows(x="x two!", z="z one", v="v one"))
    assert state(b)[1] == {"x": "x two!", "z": "z one", "v": "v one"}
    assert max(r.id for r in a.table("chunks").collect()) == 5  # ids are never given twice
    with pytest.raises(RuntimeError, match="transaction"), a.transaction():
        a.compact()


def test_a_dead_writers_number_is_freed(make, rows, monkeypatch, tmp_path):
    monkeypatch.setattr("quarry.sources.store.WAIT_S", 0)
    store = make()
    store.update(rows(x="one"))
    (tmp_path / "store/commits/000000000002.json").touch()
    store.delete_source("x")
    assert state(store) == ([], {})


def test_statistics_without_reading_chunks(make, rows):
    store, rng = make(), random.Random(3)
    texts = {}
    for step in range(6):
        for n in rng.sample("abcdefgh", 3):
            texts[n] = f"{n} {step} " * rng.randrange(1, 400)
        for n in rng.sample(sorted(texts), 1):
            del texts[n]
        if step == 3:
            store.compact()
        store.update(rows(**texts)) if step != 4 else store.delete_source(next(iter(sorted(texts))))
        want = stats.store_stats(store.table("chunks"), store.table("vectors").withColumn("is_deleted", F.lit(False)))
        assert store.stats().first().asDict() == want.first().asDict()
        assert sorted(map(tuple, store.chunk_counts().collect())) == sorted(map(tuple, stats.chunk_counts(store.table("chunks")).collect()))
    assert "/chunks" not in store.stats()._jdf.queryExecution().optimizedPlan().toString()
    assert not any("/chunks/" in f for f in store.stats().inputFiles())


def test_an_update_reads_only_what_has_changed(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    for n in ("a.md", "b [1].md", "c{x}.md"):
        (root / n).write_text(f"text of {n}")
    pages = tmp_path / "pages"
    pages.mkdir()
    for n, body in {"tagged": "v1", "plain": "p1"}.items():
        (pages / n).write_text(body)
    log = tmp_path / "log"

    def fetch(url, headers, timeout):
        with open(log, "a") as f:
            f.write(url[-6:] + "\n")
        return (pages / url.rsplit("/", 1)[-1]).read_text()

    def probe(url, headers, timeout):
        return '"' + (pages / "tagged").read_text() + '"' if url.endswith("tagged") else None

    settings = {"source": {"paths": [str(root), *({"type": "url", "url": f"https://x/{n}"} for n in ("tagged", "plain"))], "default_extensions": [".md"]}}
    engine = Engine(spark, settings, str(tmp_path / "store"), encoders.hashing_encoder(4), 4, fetch=fetch, probe=probe)
    opened = []
    real, named = scan.read_sources, lambda: sorted(os.path.basename(x) for x in opened.pop())

    def counting(spark_, specs, wanted, *a):
        opened.append([r.source for r in wanted.collect()])
        return real(spark_, specs, wanted, *a)

    scan.read_sources = counting
    try:
        engine.embed()
        assert engine.stats().first().sources == 5 and len(named()) == 5
        fetched = lambda: log.read_text().split() if log.exists() else []
        n, folders = len(fetched()), len(os.listdir(tmp_path / "store"))
        # the plain page is fetched to see that it is the same; nothing is written
        assert engine.update() == {"unchanged": 5}
        assert named() == ["plain"] and len(fetched()) == n + 1 and len(os.listdir(tmp_path / "store")) == folders
        (pages / "tagged").write_text("v2")
        (root / "b [1].md").write_text("another text")
        (root / "a.md").unlink()
        assert engine.update() == {"unchanged": 2, "modified": 2, "deleted": 1}
        assert named() == ["b [1].md", "plain", "tagged"]
        (pages / "plain").write_text("p2")
        assert engine.update() == {"unchanged": 3, "modified": 1}
        contents = sorted(r.content for r in engine.store.table("chunks").collect())
        assert contents == ["another text", "p2", "text of c{x}.md", "v2"]
    finally:
        scan.read_sources = real


def test_embed_goes_on_past_a_bad_source(spark, tmp_path, rows):
    def post(url, body, headers, timeout):
        if any("bad" in t for t in body["content"]):
            raise OSError("refused")
        return '[{"embedding": [[1.0, 2.0]]}]'

    store = Store(spark, str(tmp_path / "store"), encoders.http_encoder("u", batch=1, post=post), 2)
    assert store.embed(rows(one="good", two="bad", three="fine")) == {"new": 3, "tracked": 0, "failed": 1}
    assert state(store)[0] == ["one", "three"]
    assert store.embed(rows(one="good now", four="new")) == {"new": 1, "tracked": 1, "failed": 0}
    assert state(store)[1] == {"one": "good", "three": "fine", "four": "new"}
