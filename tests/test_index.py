"""An index of codes in the store: recall, bytes read, and what later commits do to it."""

import numpy as np
from pyspark.sql import functions as F

from quarry import encoders, schemas
from quarry.operators import pq, vectors
from quarry.plans import tables as t
from quarry.sources import store as stores
from quarry.sources.store import Store


def test_recall_and_bytes(spark):
    v = t.vectors(spark, "/root/testdata/sf0.1").select("id", "embedding").cache()
    n, asked = v.count(), [(r.id, r.embedding) for r in v.where("id % 20 = 0").collect()]
    books = pq.fit(v)
    codes = pq.coded(v, books).cache()
    assert codes.select(F.max(F.octet_length("code"))).first()[0] == 16
    assert (n * 16 + pq.CANDIDATES * 10 * 256) / (n * 256) < 0.2
    for metric in ("cosine", "l2"):
        want = {(r.query_id, r.id): r.similarity for r in vectors.knn(v, asked, 10, metric).collect()}
        got = {(r.query_id, r.id): r.similarity for r in pq.knn(v, codes, books, asked, 10, metric).collect()}
        assert len(want.keys() & got.keys()) / len(want) >= 0.95
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want.keys() & got.keys())


def test_codes_lose_no_neighbour(spark):
    for metric in ("cosine", "l2"):
        v = t.vectors(spark, "/root/testdata/sf0.1").select("id", "embedding")
        asked = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
        want = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in vectors.knn_join(v, asked, 10, metric).collect()}
        got = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in pq.knn_exact(v, pq.fit(v), asked, 10, metric).collect()}
        assert got == want


def test_few_rows_and_odd_dimensions(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0, 2.0]), (2, [0.0, 1.0, 0.0, 0.0, 1.0]), (3, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    books = pq.fit(v)
    got = pq.knn(v, pq.coded(v, books), books, [(0, [0.0, 1.0, 0.0, 0.0, 1.0])], 5).orderBy("rank").collect()
    assert [(r.id, r.similarity) for r in got] == [(1, 2.0), (2, 2.0)]


def test_an_index_in_the_store(spark, tmp_path):
    rng = np.random.default_rng(5)
    store = Store(spark, str(tmp_path / "store"), encoders.hashing_encoder(16), 16)

    def add(first, n):
        made = [(first + i, rng.normal(size=16).astype(np.float32).tolist(), f"s{first + i}") for i in range(n)]
        vecs = spark.createDataFrame(made, stores.TABLES["vectors"])
        chunks = vecs.select("id", F.col("source_id").alias("content"), "source_id", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in schemas.CHUNKS.split(", ")[3:]])
        files = vecs.select(F.col("source_id").alias("path"), *[F.lit(1).cast("long").alias(c) for c in ("last_modified", "file_size", "nof_lines")], F.current_timestamp().alias("indexed_at"))
        store.commit(chunks=chunks, vectors=vecs, files=files)
        return made

    def recall(asked):
        same = due = 0
        for _, q, _ in asked:
            want = [r.chunk_id for r in store.search(q, 10, exact=True).collect()]
            have = [r.chunk_id for r in store.search(q, 10).collect()]
            same, due = same + len(set(want) & set(have)), due + len(want)
            assert have[0] == want[0]
        return same / due

    old = add(1, 900)
    assert store.index()
    assert recall(old[:4]) >= 0.9
    files = store._near(old[0][1], 10, "cosine").count()
    assert files == pq.CANDIDATES * 10  # no other vector is scored
    new = add(2000, 30)  # coded by the index as they come
    assert store.table("codes").count() == 930
    assert recall([new[0], new[7]]) >= 0.9
    store.delete_source(new[0][2])
    store.delete_source(old[1][2])
    assert new[0][0] not in {r.chunk_id for r in store.search(new[0][1], 10).collect()}
    assert old[1][0] not in {r.chunk_id for r in store.search(old[1][1], 10).collect()}
    assert store.compact() and store.table("codes").count() == 928
    assert recall([old[5], new[5]]) >= 0.9
    store.clear()
    assert store.search(old[0][1], 3).count() == 0
