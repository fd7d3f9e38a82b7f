"""Sources, the store and streams end to end, on files of our own."""

import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry import encoders
from quarry.operators import config
from quarry.sources import scan
from quarry.sources.store import Store
from quarry.streaming import watch


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "src"
    for name, body in {"a.py": "x = 1\n" * 5, "sub/b.md": "some words\nhere", "sub/c.bin": "q", "node/d.py": "no", "big.py": "y" * 3000}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (root / "bad.py").write_bytes(b"ok \xff end")
    return root


def names(df):
    return sorted(os.path.basename(r.source) for r in df.collect())


def test_scan(spark, folder):
    df = scan.read_folder(spark, str(folder), extensions=[".py", ".md"], exclude=["*node/*"], max_mb=2500 / 1048576)
    assert names(df) == ["a.py", "b.md", "bad.py"]
    assert df.where(F.endswith("source", F.lit("bad.py"))).first().content == "ok ? end"
    assert names(scan.read_folder(spark, str(folder), recursive=False)) == ["a.py", "bad.py", "big.py"]
    fetch = lambda u, h, t: {"https://x/1": "page"}.get(u)
    specs = [
        {"type": "directory", "path": str(folder / "sub")}, {"type": "file", "path": str(folder / "a.py")},
        {"type": "url", "url": "https://x/1", "headers": {}}, {"type": "url", "url": "https://x/2", "headers": {}},
    ]
    every = scan.collect_sources(spark, specs, fetch=fetch)
    assert names(every) == ["1", "a.py", "b.md", "c.bin"]
    assert scan.fetch_source(every, "https://x/1").first().content == "page"
    assert scan.collect_sources(spark, []).count() == 0
    assert {os.path.basename(r.path): r.nof_lines for r in scan.file_rows(every).collect()}["a.py"] == 5
    assert scan.distinct_sources(every.union(every)).count() == 4


def test_related(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a/user.py", "a/user_test.py", "b/user.md", "c/superuser.py", "d/x.py"])], "pos long, source string")
    got = scan.related_sources(rows, spark.createDataFrame([("a/user.py",)], "base string"), 2)
    assert [r.source for r in got.orderBy("place").collect()] == ["a/user_test.py", "b/user.md"]


def test_project_list(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text('{"a": 1}')
    (tmp_path / "p/b.json").write_text("{bad")
    (tmp_path / "ref.json").write_text('{"r": 1}')
    assert sorted(json.loads(r.document).popitem()[0] for r in scan.project_list(spark, str(tmp_path / "p"), [str(tmp_path / "ref.json")]).collect()) == ["a", "r"]


def test_store_life(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"), encoders.hashing_encoder(16), 16)
    assert store.table("chunks").count() == 0
    read = lambda: scan.read_folder(spark, str(folder), extensions=[".py", ".md"])
    store.embed(read())
    n = store.table("chunks").count()
    assert n == store.table("vectors").count() == 5 and store.tracked().count() == 5
    store.embed(read())
    assert store.table("chunks").count() == n
    ids = [r.id for r in store.table("chunks").collect()]
    assert sorted(ids) == list(range(1, n + 1))
    hit = store.search(store.vector(ids[0]), 3).first()
    assert hit.chunk_id == ids[0] and abs(hit.similarity_score - 1) < 1e-5 and abs(hit.distance) < 1e-5
    assert store.search_with_filter(store.vector(ids[0]), source="b.md", k=5).count() == 1
    (folder / "a.py").write_text("z = 2\n" * 9)
    os.utime(folder / "a.py", (1, 1))
    (folder / "sub/b.md").unlink()
    (folder / "new.py").write_text("k = 3\n")
    assert store.update(read()) == {"modified": 1, "deleted": 1, "new": 1, "unchanged": 3}
    assert store.update(read()) == {"unchanged": 5}
    assert not any("b.md" in r.source_id for r in store.chunk_counts().collect())
    path = next(r.path for r in store.tracked().collect() if r.path.endswith("new.py"))
    assert store.is_tracked(path) and store.chunk_ids(path).count() == 1
    assert store.chunk(store.chunk_ids(path).first().id).first().content == "k = 3\n"
    assert store.delete_source(path) == 1 and not store.is_tracked(path)
    store.compact()
    row = store.stats().first()
    assert row.chunks == row.vectors == row.active == 4 and row.tokens > 0
    store.clear()
    assert store.stats().first().chunks == 0


def test_http_encoder_and_completer(spark):
    sent = []

    def post(url, body, headers, timeout):
        sent.append(body)
        return json.dumps([{"embedding": [[float(len(t)), 1.0]]} for t in body["content"]]) if "content" in body else json.dumps({"choices": [{"message": {"content": body["messages"][0]["content"].upper()}}]})

    encode = encoders.http_encoder("u", batch=2, post=post)
    frame = spark.createDataFrame([(i, "x" * i) for i in range(5)], "i long, t string")
    assert [r.e for r in frame.select("i", encode("t").alias("e")).orderBy("i").collect()] == [[float(i), 1.0] for i in range(5)]
    assert json.loads(frame.where("i = 2").select(encoders.http_completer("u", post=post)("t")).first()[0])["choices"][0]["message"]["content"] == "XX"
    for bad in ("{}", "[]", '[{"embedding": []}]', '[{"embedding": [1]}]'):
        with pytest.raises(ValueError):
            encoders.read_embeddings(bad, 1)


def test_watch_failures_and_liveness(spark, tmp_path):
    beats = tmp_path / "beats"
    spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "id long, ts long").write.parquet(str(beats))
    seen = []
    q = watch.watch(watch.file_stream(spark, str(beats), "id long, ts long"), lambda df: seen.append(df.count()), str(tmp_path / "c0"), None)
    assert q.awaitTermination(90)
    assert sum(seen) == 3
    live = watch.liveness(watch.file_stream(spark, str(beats), "id long, ts long"), 60)
    q = live.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c1")).trigger(processingTime="1 second").start()
    # timeouts keep such a query awake, so it is stopped once the files are read
    for _ in range(60):
        if spark.table("live").count() >= 2:
            break
        time.sleep(0.5)
    q.stop()
    assert {(r.id, r.last_heartbeat, r.status) for r in spark.table("live").collect()} == {(1, 9, "alive"), (2, 3, "alive")}
    events = tmp_path / "events"
    spark.createDataFrame([("a", t, False) for t in range(3)] + [("b", 0, False), ("b", 1, True), ("b", 2, False)], "path string, ts long, ok boolean").coalesce(1).write.parquet(str(events))
    fails = watch.failure_counts(watch.file_stream(spark, str(events), "path string, ts long, ok boolean"))
    q = fails.writeStream.format("memory").queryName("fails").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {(r.path, r.failures, r.ignored) for r in spark.table("fails").collect()} == {("a", 3, True), ("b", 1, False)}
    audit = spark.createDataFrame(pd.DataFrame({"ts": [1], "event": ["e"], "extra": [None]}).astype({"extra": "object"}), "ts long, event string, extra string")
    watch.append_audit(audit, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).first().extra == ""


def test_settings_file(tmp_path):
    document = {"source": {"paths": ["x"]}}
    path = tmp_path / "s.json"
    config.save(document, str(path))
    assert config.load(str(path)) == document and config.load(str(tmp_path / "none.json")) == {}


def test_a_failing_source_leaves_the_others_alone(spark, tmp_path):
    """A source without vectors stays as it was; after three failures it is ignored."""
    root, broken = tmp_path / "src", tmp_path / "broken"
    root.mkdir()
    broken.write_text("bad")
    for n in ("a", "b"):
        (root / f"{n}.md").write_text(f"text {n}")

    def post(url, body, headers, timeout):
        word = broken.read_text()
        if word and any(word in t for t in body["content"]):
            raise OSError("refused")
        return json.dumps([{"embedding": [[1.0, float(len(t))]]} for t in body["content"]])

    store = Store(spark, str(tmp_path / "store"), encoders.http_encoder("u", post=post), 2)
    read = lambda: scan.read_folder(spark, str(root))
    store.embed(read())
    (root / "c.md").write_text("good")
    (root / "b.md").write_text("bad now")
    assert store.update(read()) == {"modified": 1, "new": 1, "unchanged": 1, "failed": 1}
    assert sorted(r.content for r in store.table("chunks").collect()) == ["good", "text a", "text b"]
    assert store.vector(store.chunk_ids(next(r.path for r in store.tracked().collect() if r.path.endswith("c.md"))).first().id)[0] == 1.0
    broken.write_text("")
    assert store.update(read()) == {"modified": 1, "unchanged": 2}  # a success ends the row of failures
    broken.write_text("worse")
    (root / "b.md").write_text("worse still")
    for _ in range(3):
        assert store.update(read()) == {"modified": 1, "unchanged": 2, "failed": 1}
    assert store.update(read()) == {"unchanged": 2}
    assert sorted(r.ok for r in store.failures().collect()) == [False] * 4 + [True]
    # the next process tries again
    broken.write_text("")
    again = Store(spark, str(tmp_path / "store"), encoders.http_encoder("u", post=post), 2)
    assert again.update(read()) == {"modified": 1, "unchanged": 2}
    with pytest.raises(Exception, match="where 3 are due"):
        Store(spark, str(tmp_path / "other"), encoders.http_encoder("u", post=post), 3).embed(read())


def test_transactions_and_two_writers(spark, tmp_path):
    make = lambda: Store(spark, str(tmp_path / "store"), encoders.hashing_encoder(4), 4)
    rows = lambda *names: spark.createDataFrame([(False, n, n, len(n), 1) for n in names], "is_url boolean, content string, source string, file_size long, last_modified long")
    store, other = make(), make()
    store.embed(rows("one"))
    with pytest.raises(ValueError), store.transaction():
        store.embed(rows("two"))
        assert store.tracked().count() == 2 and other.tracked().count() == 1
        raise ValueError
    assert store.tracked().count() == 1
    with store.transaction():
        store.delete_source("one")
        store.embed(rows("two"))
        store.embed(rows("three"))
        assert other.tracked().count() == 1
    assert sorted(r.path for r in other.tracked().collect()) == ["three", "two"]
    # the second of two writers that saw the same last commit takes the next number
    seen = other._commits()
    other._commits, real = lambda: seen if not store.is_tracked("five") or len(calls) == 0 and not calls.append(1) else real(), other._commits
    calls = []
    store.embed(rows("five"))
    other.commit(files=scan.file_rows(rows("six")))
    assert sorted(r.path for r in make().tracked().collect()) == ["five", "six", "three", "two"]
