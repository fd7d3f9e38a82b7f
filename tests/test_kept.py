"""A registry on disk, streams of completions cut anywhere, attachments, import outcomes, related sources."""

import pytest
from pyspark.sql import functions as F

from quarry import encoders
from quarry.engine import Engine
from quarry.operators import changes, config, prompts, registry
from quarry.plans import queries
from quarry.sources import scan
from quarry.streaming import completions


def test_registry_on_disk(spark, tmp_path):
    open_ = lambda: registry.Registry(spark, str(tmp_path / "reg"))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, name string, last_heartbeat long")
    beats = lambda *r: spark.createDataFrame(list(r), "id string, ts long")
    state = lambda: {r.id: (r.name, r.last_heartbeat) for r in open_().instances().collect()}
    assert state() == {}
    open_().register(rows(("a", "one", 100), ("b", "two", 100), ("c", "three", 100)))
    open_().beat(beats(("a", 150), ("a", 140), ("b", 90), ("x", 500)))
    assert state() == {"a": ("one", 150), "b": ("two", 100), "c": ("three", 100)}
    open_().register(rows(("b", "two again", 10)))
    open_().unregister(rows(("c", None, None)))
    open_().beat(beats(("c", 600)))
    assert state() == {"a": ("one", 150), "b": ("two again", 10)}
    gone = open_().evict(200, own_id="a").collect()
    assert [(r.instance_id, r.event, r.ts) for r in gone] == [("b", "stale", 200)]
    open_().register(rows(("c", "back", 190)))
    open_().compact()
    assert state() == {"a": ("one", 150), "c": ("back", 190)}
    assert spark.read.parquet(str(tmp_path / "reg/audit")).count() == 1


def test_a_stream_cut_at_every_byte(spark, tmp_path):
    body = 'data: {"choices":[{"delta":{"content":"Grüße "}}]}\n\ndata: {bad\n\n: note\n\ndata: {"choices":[{"delta":{"content":null,"reasoning_content":"hm "}}]}\n\ndata: {"choices":[]}\n\ndata: {"choices":[{"delta":{"content":"é"}}]}\n\ndata: [DONE]\n\ndata: {"choices":[{"delta":{"content":"late"}}]}\n\n'
    raw = body.encode()
    whole = prompts.parse_sse(spark.createDataFrame([(0, body)], "k long, body string"), "k").first().content
    assert whole == "Grüße hm é"
    for part in range(2):
        pieces = [(str(i), part, bytearray(raw[:i] if part == 0 else raw[i:])) for i in range(len(raw) + 1)]
        spark.createDataFrame(pieces, "stream string, seq long, piece binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream string, seq long, piece binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batches = []
    run = completions.contents(stream).writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: batches.append(df.collect())).trigger(availableNow=True).start()
    assert run.awaitTermination(120) and len(batches) == 2
    said = {}
    for rows in batches:
        for r in rows:
            said[r.stream] = said.get(r.stream, "") + r.content
    assert len(said) == len(raw) + 1 and set(said.values()) == {whole}
    assert len({r.content for r in batches[0]}) == 4  # text has come in with the first pieces


def test_pieces_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch", lambda *_: f"{tmp_path}/pieces")
    got = {r.stream: r.content for r in queries.sse_as_it_comes(spark, "/root/testdata/sf0.001").collect()}
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    assert got == {f"{r.conv_id}:{r.turn}": f"{r.text} " for r in turns}
    assert len(list((tmp_path / "pieces/in").glob("*.parquet"))) > 3
    assert spark.read.parquet(f"{tmp_path}/pieces/out").select("epoch").distinct().count() == 3


def test_attachments(spark, tmp_path):
    for n, body in {"b.txt": "second file", "a.txt": "first é"}.items():
        (tmp_path / n).write_text(body)
    got = [tuple(r) for r in scan.read_attachments(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")]).collect()]
    assert got == [("b.txt", "second file"), ("a.txt", "first é")]
    engine = Engine(spark, {}, str(tmp_path / "store"), encoders.hashing_encoder(4), 4)
    packed = engine.context("question", attached=got).first()
    assert packed.context.index("second file") < packed.context.index("first é") and "b.txt" in packed.context
    assert engine.context("question", budget=45, attached=[("c.txt", "word " * 500)]).first().tokens <= 45
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan.read_attachments(spark, [str(tmp_path / "none.txt")])


def test_import_outcomes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "place long, path string")
    got = {r.place: r.error for r in changes.import_outcome(rows, spark.createDataFrame([("a",)], "path string"), "path").collect()}
    assert got == {1: changes.IMPORTED, 2: None, 3: changes.IMPORTED, 4: None}


def test_endpoints_as_rows(spark):
    rows = spark.createDataFrame([("x", 1, "m"), ("x", 2, "n"), ("x", 3, "m"), ("y", 1, "n")], "g string, pos long, id string")
    got = rows.groupBy("g").agg(config.last_of(F.col("pos"), F.col("pos"), F.col("id") == "m").alias("last"), config.current_of(F.col("pos"), F.col("pos"), F.col("id") == "n").alias("now"))
    assert {r.g: (r["last"], r.now) for r in got.collect()} == {"x": (3, 2), "y": (None, 1)}


def test_related_by_the_rarest_piece(spark):
    names = [f"lib/test{i:03d}.py" for i in range(300)] + ["a/te.py", "b/.py", "c/testimony.py", "d/test007_old.py"]
    rows = spark.createDataFrame(list(enumerate(names)), "pos long, source string")
    stem = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0] or p.rsplit("/", 1)[-1]
    asked = ["lib/test007.py", "a/te.py", "c/testimony.py", "lib/test299.py"]
    got = {}
    for r in scan.related_sources(rows, spark.createDataFrame([(b,) for b in asked], "base string"), 4).orderBy("base", "place").collect():
        got.setdefault(r.base, []).append(r.source)
    want = {b: [n for n in names if n != b and stem(b) in stem(n)][:4] for b in asked}
    assert got == {b: v for b, v in want.items() if v}


def test_related_wherever_the_stem_lies(spark):
    pieces = scan._pieces(F.lit("112320"), [4, 1]).alias("p")
    assert set(spark.range(1).select(pieces).first().p) == {"1123", "1232", "2320", "1", "2", "3", "0"}
    names = [f"src{i % 3}/{i}.txt" for i in (12320, 112320, 123205, 232012, 1232, 12321, 912320, 7)]
    rows = spark.createDataFrame(list(enumerate(names)), "pos long, source string")
    for base, held in ((0, (1, 2, 6)), (4, (0, 1, 2))):
        got = scan.related_sources(rows, spark.createDataFrame([(names[base],)], "base string"), 3).orderBy("place").collect()
        assert [(r.base, r.source, r.place) for r in got] == [(names[base], names[i], n + 1) for n, i in enumerate(held)]
