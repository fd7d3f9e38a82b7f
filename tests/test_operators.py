"""Operators on rows of our own; the driver's tables are held against DuckDB by test_queries."""

import json
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.tokens import count_bytes
from quarry.operators import changes, config, packing, prompts, registry, stats, vectors


def pack_by_hand(results, cap, base, fmt="[Source: {}]\n"):
    used, out = base, []
    for rank, source, content in results:
        name = source.rsplit("/", 1)[-1] or source or "source"
        label = fmt.replace("{}", name)
        label = "" if content.startswith(label) else label
        lt, ct = count_bytes(label.encode()), count_bytes(content.encode())
        if used + lt + ct > cap:
            room = max(cap - used, 0)
            if room <= lt:
                break
            n = len(content.encode()) * (room - lt) // ct if ct else len(content.encode())
            out.append((rank, label + content.encode()[:n].decode(errors="ignore"), True))
            break
        used += lt + ct
        out.append((rank, label + content, False))
    return out


@pytest.mark.parametrize("cap", [0, 5, 11, 14, 15, 16, 30, 1000])
def test_pack_context(spark, cap):
    results = [(1, "a/x.py", "one two three"), (2, "", "é" * 30), (3, "dir/", "[Source: dir/]\nlabelled already"), (4, "b", ""), (5, "c", "tail words here")]
    frame = spark.createDataFrame([(7, *r) for r in results], "query_id long, rank long, source_id string, content string")
    got = packing.pack_context(frame, cap, 4).orderBy("rank").collect()
    assert [(r.rank, r.piece[:-2], r.is_excerpt) for r in got] == pack_by_hand(results, cap, 4)
    whole = packing.context_text(packing.pack_context(frame, cap, 4, divider="--")).collect()
    if got:
        assert whole[0].context == "".join("--" + r.piece for r in got)


def test_pack_comments_out(spark):
    frame = spark.createDataFrame([(1, 1, "x.py", "a\nb")], "query_id long, rank long, source_id string, content string")
    assert packing.pack_context(frame, 100, 0, comment_out=True).first().piece == "# [Source: x.py]\n# a\n# b\n\n"


def test_knn_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    for metric, score in (("cosine", lambda a, b: float(np.dot(a, b))), ("l2", lambda a, b: 1 / (1 + float(((np.array(a) - b) ** 2).sum())))):
        got = {}
        for r in vectors.knn(frame, rows[:3], 7, metric).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for q, v in rows[:3]:
            assert got[q] == sorted(range(300), key=lambda i: (-score(rows[i][1], np.array(v)), i))[:7]
    with pytest.raises(Exception, match="due"):
        vectors.knn(frame, [(0, [1.0, 2.0])], 1).collect()
    with pytest.raises(Exception, match="due"):
        vectors.checked(frame, 3).collect()
    assert vectors.knn(frame.limit(0), rows[:1], 3).count() == 0
    assert vectors.knn_join(frame, frame.limit(0).withColumnRenamed("id", "query_id"), 3).count() == 0


def test_near_vectors_of_large_norm_keep_their_distance(spark):
    rows = [(i, [1e6 + i * 1e-3, -1e6]) for i in range(5)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = vectors.knn(frame, [(0, [1e6, -1e6])], 3, "l2").orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 2] and all(r.distance == pytest.approx(((1e6 + r.id * 1e-3) - 1e6) ** 2, rel=0.2) for r in got)


def test_knn_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_QUERIES", 4)
    rows = [(i, [float(i), 1.0]) for i in range(20)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = vectors.knn_join(frame, frame.where("id < 10").withColumnRenamed("id", "query_id"), 2)
    assert got.groupBy("query_id").count().where("count = 2").count() == 10


def test_knn_join_of_many_queries(spark, monkeypatch):
    """More queries are more blocks of one job, no more jobs; copies of a vector tie wherever they lie."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(50, 6)).astype(np.float32).astype(float)
    rows = [(i, values[i % 50].tolist()) for i in range(400)] + [(400, None)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    monkeypatch.setattr(vectors, "MOST_QUERIES", 4)
    monkeypatch.setattr(vectors, "HELD", 6 * 2048)
    for metric, score in (("cosine", lambda a, b: float(sum(x * y for x, y in zip(a, b, strict=True)))), ("l2", lambda a, b: -float(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))))):
        spark.sparkContext.setJobGroup(f"many {metric}", "")
        got = {}
        for r in vectors.knn_join(frame, frame.where("id < 80").withColumnRenamed("id", "query_id"), 11, metric).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"many {metric}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(jobs) < 30
        for q in range(80):
            scores = [score(values[q % 50], v) for v in values]
            assert got[q] == sorted(range(400), key=lambda i: (-scores[i % 50], i))[:11]


def test_a_task_of_blocks_has_one_python_worker(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, embedding array<float>")
    plan = vectors.knn_blocks(frame, frame.withColumnRenamed("id", "query_id"), 2)._jdf.queryExecution().optimizedPlan().toString()
    _, between, _ = plan.split("MapInArrow")  # scoring and, below it, the packing of queries
    assert "Repartition" in between


def test_scoring_takes_bounded_memory():
    rng = np.random.default_rng(4)
    best = vectors.Nearest(rng.normal(size=(4096, 16)), 8, "dot")
    tracemalloc.start()
    for i in range(3):
        best.add(np.arange(i * 2048, (i + 1) * 2048), rng.normal(size=(2048, 16)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # all scores of a block at once are 64 MB, and were held six times


def test_filter_after_or_before(spark):
    rows = [(i, [1.0 - i / 100, 0.0], f"s{i % 2}", "t") for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>, source_id string, type string")
    after = vectors.search_with_filter(frame, [1.0, 0.0], 5, "s1")
    assert [r.id for r in after.collect()] == [1, 3, 5, 7, 9]
    assert vectors.search_with_filter(frame, [1.0, 0.0], 5, kind="none").count() == 0
    assert [r.id for r in vectors.search_filtered_first(frame, [1.0, 0.0], 6, "s1").orderBy("rank").collect()] == [1, 3, 5, 7, 9, 11]
    assert spark.range(1).select(F.round(vectors.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))), 4)).first()[0] == 0.96


def test_detect_changes(spark):
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1), ("c", 1, 1), ("i", 9, 9)], "path string, last_modified long, file_size long")
    then = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("d", 1, 1), ("i", 1, 1)], "path string, last_modified long, file_size long")
    ignored = spark.createDataFrame([("i",)], "path string")
    got = {r.path: r.change_type for r in changes.detect_changes(now, then, ignored).collect()}
    assert got == {"a": "unchanged", "b": "modified", "c": "new", "d": "deleted"}
    assert changes.upsert(then, now, "path").count() == 5


def test_failures_reset_on_success(spark):
    rows = [("a", t, False) for t in range(3)] + [("b", 0, False), ("b", 1, False), ("b", 2, True), ("b", 3, False), ("b", 4, False)]
    got = changes.failures(spark.createDataFrame(rows, "path string, ts long, ok boolean")).collect()
    assert [tuple(r) for r in got] == [("a", 3)]


def test_registry(spark):
    beats = spark.createDataFrame([(1, 100), (1, 170), (2, 60), (3, 10), (4, 100)], "id long, ts long")
    rows = registry.latest(beats)
    now = F.lit(180)
    assert [r.id for r in registry.active(rows, now).collect()] == [1]
    gone = registry.stale(rows, now, own_id=3, after=60)
    left, audit = registry.evict(rows, gone, now)
    assert sorted(r.id for r in left.collect()) == [1, 3] and {r.instance_id for r in audit.collect()} == {2, 4}
    assert registry.dead(rows, F.col("id") > 2).count() == 2
    own = spark.createDataFrame([(1, "C:\\A\\x.json"), (2, "c:/a/X.json"), (5, "q")], "id long, config_path string")
    projects = spark.createDataFrame([("c:/a/x.json",), ("z",)], "path string")
    assert {r.path: r.instance_id for r in registry.with_projects(projects, own).collect()} == {"c:/a/x.json": 1, "z": None}
    assert [r.id for r in registry.orphans(own, projects).collect()] == [5]
    p = spark.createDataFrame([('{"a": "1"}',), ("{bad",), (None,)], "p string").select(registry.parse_params(F.col("p"), "map<string,string>").alias("m"))
    assert [r.m or {} for r in p.collect()] == [{"a": "1"}, {}, {}]


def test_config(spark, monkeypatch):
    apis = spark.createDataFrame([([("a", False, 1), ("b", True, 2), ("b", True, 3)],), ([],)], "apis array<struct<id:string,enabled:boolean,n:int>>")
    row = apis.select(
        config.current_api(F.col("apis"), F.lit("b"))["n"].alias("b"), config.current_api(F.col("apis"), F.lit("x"))["n"].alias("x"), config.current_api(F.col("apis"), F.lit(""))["n"].alias("e"),
        config.last_match(F.col("apis"), F.lit("b"))["n"].alias("last"), F.size(config.enabled(F.col("apis"))).alias("on"),
    ).collect()
    assert tuple(row[0]) == (2, 1, 1, 3, 2) and tuple(row[1]) == (None, None, None, None, 0)
    assert config.expand_variable("${A}", {"A": "1"}) == "1" and config.expand_variable("${B}", {}) == "${B}" and config.expand_variable("x${A}", {"A": "1"}) == "x${A}"
    assert config.fill_placeholders({"a": ["_PL_x", 1], "b": "_PL_y z"}, {"_PL_x": "v"}) == {"a": ["v", 1], "b": "_PL_y z"}
    specs = config.source_specs({"source": {"default_extensions": [".a"], "global_exclude": ["*g*"], "paths": ["p", {"type": "url", "url": "u", "headers": {"K": "${V}"}}, {"type": "directory", "path": "q", "extensions": [".b"], "exclude": ["e"]}]}}, {"V": "s"})
    assert [(s["extensions"], s["exclude"]) for s in specs] == [([".a"], ["*g*"]), ([], ["*g*"]), ([".b"], ["e", "*g*"])] and specs[1]["headers"] == {"K": "s"}
    assert config.api_settings({"id": "i", "apiUrl": "u", "api_key": "k"})["url"] == "u"
    titles = spark.createDataFrame([(["ab", "cdefghijklmnop", "x"],), ([],)], "s array<string>").select(config.project_title(F.col("s")).alias("t"))
    assert [r.t for r in titles.collect()] == ["ab/cdefghijklmnop", "Unnamed Project"]
    ranked = config.ranked_options(spark.createDataFrame([(0, "a", "P x", 3.0), (1, "b", "Q", 1.0), (2, "c", "P", 2.0)], "pos long, id string, name string, price double"))
    assert [r.id for r in ranked.orderBy("place").collect()] == ["c", "a", "b"]


def test_prompts(spark):
    one = lambda c, **k: spark.range(1).select(*[F.lit(v).alias(n) for n, v in k.items()]).select(c).first()[0]
    c = F.col
    assert one(prompts.replace_first(c("t"), "_X_", c("v")), t="a_X_b_X_", v="$1") == "a$1b_X_"
    assert one(prompts.apply_format(c("t"), "q: {}"), t="x") == "q: x" and one(prompts.apply_format(c("t"), "none"), t="x") == "x"
    named = json.loads(one(prompts.fim_request(c("p"), c("s"), c("k"), "pre", "suf", stops=["<E>"], api_stops=["<A>"]), p="P", s="S", k="K"))
    assert named == {"pre": "K\n\nP", "suf": "S", "stop": ["<A>", "<E>"]}
    assert json.loads(one(prompts.fim_request(c("p"), c("s"), c("k"), fmt="<{}|{}>"), p="P{}", s="S", k="K"))["prompt"] in ("<P{}|S>", "<PS|{}>")
    chat = json.loads(one(prompts.fim_request(c("p"), c("s"), c("k")), p="P", s="S", k="K"))
    assert "K" in chat["messages"][1]["content"] and chat["messages"][0]["role"] == "system"
    body = json.dumps({"choices": [{"text": "```py\nx\n```"}]})
    assert one(prompts.fim_response(c("b"), ["<A>", "x"]), b=body) == ""
    assert one(prompts.response_content(c("b")), b=json.dumps({"choices": [{"message": {"content": "m"}, "text": "t"}]})) == "m"
    assert one(prompts.strip_stop(c("b"), ["x", "<A>"]), b="q<A>x") == "q<A>"


def test_sse(spark):
    d = lambda **k: "data: " + json.dumps({"choices": [{"delta": k}]}) + "\n\n"
    streams = [d(content="a") + d(content=None, reasoning_content="r") + d(reasoning_content="skipped") + "data: {bad\n\n: note\n\n" + d(content="b") + "data: [DONE]\n\n" + d(content="late"), d(content="x") + "data: {\"choices\"", "", d(content="é\n")]
    frame = spark.createDataFrame(list(enumerate(streams)), "i long, body string")
    assert [r.content for r in prompts.parse_sse(frame, "i").orderBy("i").collect()] == ["arb", "x", "", "é\n"]


def test_stats(spark):
    files = spark.createDataFrame([("d/a.py", 3, 10, True), ("d/b.md", 2, 5, True), ("e/c.py", 9, 9, False)], "path string, nof_lines long, file_size long, exists boolean")
    chunks = spark.createDataFrame([("d/b.md",), ("d/b.md",)], "source_id string")
    row = stats.source_stats(files, chunks).first()
    assert (row.total_files, row.total_lines, row.total_size_bytes) == (3, 5, 15)
    assert row.by_language == {"Python": 1, "Markdown": 1} and row.by_directory == {"d": 2}
    assert [(x.path, x.chunks) for x in row.top_files] == [("d/b.md", 2), ("d/a.py", 0)]


def test_paired_and_shared_folders(spark):
    pair = lambda t, e: spark.range(1).select(vectors.paired(F.lit(t), F.lit(e)).alias("p")).first().p
    assert [(x.text, x.embedding) for x in pair(["a", "b"], [1, 2])] == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="are due"):
        pair(["a"], [1, 2])
    rows = [(1, "a/b/c"), (1, "a/b/d/e"), (2, "x"), (3, "p/q"), (3, "r/q"), (4, "m\\n"), (4, "m/n/o")]
    from quarry.sources.scan import shared_folders_removed

    got = shared_folders_removed(spark.createDataFrame(rows, "g long, path string"), "g")
    assert sorted((r.g, r.short) for r in got.collect()) == [(1, "c"), (1, "d/e"), (2, "x"), (3, "p/q"), (3, "r/q"), (4, "n"), (4, "n/o")]


def test_the_engines_own_stream(spark):
    from quarry.operators import prompts

    events = ['{"content": "[meta]looking"}', '{"content": "one "}', "{broken", '{"type": "context_sources", "sources": ["a/x", "a/y"]}', '{"content": "two"}', "[DONE]", '{"content": "late"}']
    body = "".join(f"data: {e}\n\n" for e in events) + 'data: {"content": "cut'
    rows = spark.createDataFrame([(1, body), (2, ""), (3, None)], "i long, body string")
    got = {r.i: r for r in prompts.parse_ui_sse(rows, "i").collect()}
    assert (got[1].content, got[1].meta, got[1].sources) == ("one two", ["looking"], ["a/x", "a/y"])
    assert (got[2].content, got[2].meta, got[2].sources) == ("", [], [])


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_index_recall(spark, tmp_path, metric):
    """Each vector is in one list; of the true neighbours nine in ten are found, and what is found is scored exactly."""
    from quarry.operators import ivf
    from quarry.plans import tables

    v = tables.vectors(spark, "/root/testdata/sf0.01").cache()
    ivf.build(v, str(tmp_path / "index"))
    held = spark.read.parquet(str(tmp_path / "index/vectors"))
    assert held.count() == held.select("id").distinct().count() == v.count() and held.select("list").distinct().count() > 10
    asked = [(r.id, r.embedding) for r in v.where("pmod(id, 20) = 0").collect()]
    true = {(r.query_id, r.id): r.similarity for r in vectors.knn(v, asked, 10, metric).collect()}
    hits = 0
    for q in asked:  # one query at a time: others would lend their lists
        got = {(r.query_id, r.id): r.similarity for r in ivf.knn(spark, str(tmp_path / "index"), [q], 10, metric).collect()}
        assert len(got) == 10 and all(abs(true[x] - s) < 1e-9 for x, s in got.items() if x in true)
        hits += sum(x in true for x in got)
    assert hits >= 0.9 * 10 * len(asked)
    v.unpersist()


def test_index_of_copies_and_of_nothing(spark, tmp_path):
    from quarry.operators import ivf

    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(40, None)], "id long, embedding array<float>")
    ivf.build(same, str(tmp_path / "index"))
    got = ivf.knn(spark, str(tmp_path / "index"), [(7, [1.0, 2.0])], 3).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(7, 0), (7, 1), (7, 2)]
    with pytest.raises(ValueError):
        ivf.build(same.limit(0), str(tmp_path / "none"))
