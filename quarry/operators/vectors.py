"""Exact nearest neighbours, distributed: each task keeps its own best k per query, then k rows a task are merged.

A matrix product tells which vectors may be among the k best of a query, up to its rounding; only these are summed up value by value, in order,
so that equal vectors have equal scores wherever they lie, and those that plain SQL gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.scratch import scratch

#: Queries that are sent with the task; of more, queries and vectors meet block by block.
MOST_QUERIES = 4096
#: Rows of a block of vectors, of a block of queries, and queries that are scored at once.
BLOCK, ASKED, AT_ONCE = 2048, 4096, 512
#: Values (rows by dimensions) of vectors that a task holds at once: 32 MB.
HELD = 1 << 22
#: Terms that are summed up at once: 4 MB.
SUMMED = 1 << 19


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    def term(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """True cosine; the engine's ``cosine`` metric is the plain inner product."""
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def checked(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """The vectors; a row of another dimension fails the query."""
    message = F.format_string(f"vector of %d values where {dim} are due", F.size(column))
    return vectors.where(F.coalesce(F.assert_true(F.size(column) == dim, message).cast("string"), F.lit("")) == "")


def paired(texts: Column, embeddings: Column) -> Column:
    """array<struct<text, embedding>> of two arrays by place; unequal lengths fail the query."""
    checked_ = F.assert_true(F.size(texts) == F.size(embeddings), "a text and a vector for each place are due")
    pairs = F.zip_with(texts, embeddings, lambda t, e: F.struct(t.alias("text"), e.alias("embedding")))
    return F.when(checked_.isNull(), pairs)


def distance_of(metric: str):
    """cosine: 1 - inner product, similarity the product; any other: squared L2, similarity 1 / (1 + d)."""
    return "dot" if metric == "cosine" else "l2"


def _scores(queries: np.ndarray, block: np.ndarray, kind: str) -> np.ndarray:
    """Inner products, or squared distances with the sign turned (by differences, so that near vectors keep their digits); queries by vectors."""
    if kind == "dot":
        return queries @ block.T
    return np.array([-np.einsum("ij,ij->i", d, d) for d in (block - q for q in queries)])


def _values(lists: pa.Array, dim: int) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes != dim).any():
        raise ValueError(f"vector of {sizes[sizes != dim][0]} values where {dim} are due")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _bound(lengths: np.ndarray, block: np.ndarray, kind: str) -> np.ndarray:
    """No vector of the block scores higher for queries of these lengths; a little is added for rounding."""
    norms = np.sqrt((block**2).sum(1))
    if kind == "dot":
        return lengths * norms.max(initial=0) * (1 + 1e-9)
    apart = np.maximum(0, np.maximum(lengths - norms.max(initial=0), norms.min(initial=np.inf) - lengths))
    return -(apart**2) * (1 - 1e-9)


def _summed(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """Scores of row by row, summed up in order of the values."""
    terms = a * b if kind == "dot" else -((a - b) ** 2)
    return np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def _first_copies(ids: np.ndarray, block: np.ndarray, k: int) -> np.ndarray:
    """False for a vector of which k copies have lesser ids."""
    copy = np.unique(block, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, copy))
    starts = np.flatnonzero(np.diff(copy[order], prepend=-1))
    kept = np.empty(len(ids), bool)
    kept[order] = np.arange(len(ids)) - np.repeat(starts, np.diff(starts, append=len(ids))) < k
    return kept


class Nearest:
    """The k best of each query among the blocks of vectors that were added, ties by id."""

    def __init__(self, queries: np.ndarray, k: int, kind: str):
        self.queries, self.k, self.kind, self.n = queries, k, kind, 0
        self.lengths = np.sqrt((queries**2).sum(1))
        self.ids, self.scores = np.zeros((len(queries), k), np.int64), np.full((len(queries), k), -np.inf)

    def add(self, ids: np.ndarray, block: np.ndarray, near: np.ndarray | None = None) -> None:
        """``near``: what is known of the vectors by their codes; it rules out those that can't be among the k best, and only the others are scored."""
        if not len(ids):
            return
        asked = np.arange(len(self.queries))
        if self.n == self.k:
            asked = asked[~(_bound(self.lengths, block, self.kind) < self.scores[:, -1])]
        for i in range(0, len(asked), AT_ONCE):
            self._add(asked[i : i + AT_ONCE], ids, block, near)
        self.n = min(self.k, self.n + len(ids))

    def _products(self, asked: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of a block by a matrix product, and by how much they may be off."""
        queries, lengths, squares = self.queries[asked], self.lengths[asked, None], (block**2).sum(1)
        rounding, longest = 8 * (block.shape[1] + 4) * np.finfo(float).eps, np.sqrt(squares.max())
        if self.kind == "dot":
            return queries @ block.T, rounding * lengths * longest
        return 2 * (queries @ block.T) - squares - lengths**2, rounding * (lengths + longest) ** 2

    def _told(self, asked: np.ndarray, block: np.ndarray, near: np.ndarray) -> np.ndarray:
        """False where what codes tell, and the distance of a vector from it, rule the vector out."""
        score, slack = self._products(asked, near)
        off = np.sqrt(((block - near) ** 2).sum(1)) * (1 + 1e-9)
        if self.kind == "dot":
            return ~(score + self.lengths[asked, None] * off < self.scores[asked, -1:] - slack)
        # the rounding of a small square is larger in its root
        apart = np.maximum(np.sqrt(np.maximum(-score, 0)) - np.sqrt(slack) - off, 0)
        return ~(-(apart**2) < self.scores[asked, -1:] - slack)

    def _add(self, asked: np.ndarray, ids: np.ndarray, block: np.ndarray, near: np.ndarray | None) -> None:
        full, many = self.n == self.k, 4 * self.k * len(asked)
        told = None
        if near is not None and full:
            told = self._told(asked, block, near)
            left = told.any(0)
            if not left.any():
                return
            ids, block, told = ids[left], block[left], told[:, left]
        queries = self.queries[asked]
        score, slack = self._products(asked, block)
        may = ~(score < self.scores[asked, -1:] - slack) if full else np.ones(score.shape, bool)
        if told is not None:
            may &= told
        if np.count_nonzero(may) > many:
            if len(ids) > self.k:  # the k best of the block alone rule others out
                may &= ~(score < np.partition(score, -self.k, axis=1)[:, [-self.k]] - 2 * slack)
            if np.count_nonzero(may) > many:
                may &= _first_copies(ids, block, self.k)
        row, column = np.divmod(np.flatnonzero(may), may.shape[1])
        if not len(row):
            return
        step = max(1, SUMMED // max(1, block.shape[1]))
        exact = np.concatenate([_summed(queries[row[i : i + step]], block[column[i : i + step]], self.kind) for i in range(0, len(row), step)])
        touched = np.unique(row)
        rows = np.concatenate([np.repeat(touched, self.n), row])
        found = np.concatenate([self.ids[asked[touched], : self.n].ravel(), ids[column]])
        scores = np.concatenate([self.scores[asked[touched], : self.n].ravel(), exact])
        order = np.lexsort((found, np.where(np.isnan(scores), -np.inf, -scores), rows))
        rows = rows[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))
        kept = place < self.k
        self.ids[asked[rows[kept]], place[kept]] = found[order][kept]
        self.scores[asked[rows[kept]], place[kept]] = scores[order][kept]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        """(query_id, id, score)"""
        arrays = [np.repeat(query_ids, self.n), self.ids[:, : self.n].ravel(), self.scores[:, : self.n].ravel()]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["query_id", "id", "score"])


def _ranked(near: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, rank, id, similarity, distance) of the k best (query_id, id, score) of each query."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = near.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)
    score = F.col("score")
    similarity, distance = (score, 1 - score) if kind == "dot" else (1 / (1 - score), -score)
    return top.select("query_id", "rank", "id", similarity.alias("similarity"), distance.alias("distance"))


def knn(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, metric: str = "cosine", extra: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rank, id, similarity, distance, *extra): the k best vectors for each query, ties by id.

    ``vectors`` has id and embedding. Queries are a bounded list (MOST_QUERIES), sent with the task. One
    task sends at most k rows a query to the merge, so the shuffle doesn't grow with the vectors' number
    but with the tasks'. Vectors whose norms show that they can't be among the k best so far of a query (Cauchy-Schwarz) are not scored for it.
    """
    if not queries or len(queries) > MOST_QUERIES:
        raise ValueError(f"between 1 and {MOST_QUERIES} queries")
    kind = distance_of(metric)
    ids = np.array([i for i, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float32).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(matrix, k, kind)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                best.add(part.column(0).to_numpy(), _values(part.column(1), matrix.shape[1]))
        yield best.batch(ids)

    near = vectors.where("embedding is not null").select(F.col("id").cast("long"), "embedding").mapInArrow(run, "query_id long, id long, score double")
    top = _ranked(near, k, kind)
    return top.join(vectors.select("id", *extra), "id").select(*top.columns, *extra) if extra else top


def vector_of(vectors: DataFrame, vec_id: int) -> list[float]:
    """The vector of one id: a point lookup."""
    row = vectors.where(F.col("id") == vec_id).select("embedding").first()
    if row is None:
        raise KeyError(vec_id)
    return row.embedding


def search_with_filter(vectors: DataFrame, query: list[float], k: int, source: str = "", kind: str = "", metric: str = "cosine") -> DataFrame:
    """Twice k neighbours, then the filters, then the first k: fewer than k may be left. Empty filters let all pass."""
    top = knn(vectors, [(0, query)], 2 * k, metric, ("source_id", "type"))
    if source:
        top = top.where(F.contains("source_id", F.lit(source)))
    if kind:
        top = top.where(F.col("type") == kind)
    return top.orderBy("rank").limit(k)


def search_filtered_first(vectors: DataFrame, query: list[float], k: int, source: str = "", kind: str = "", metric: str = "cosine") -> DataFrame:
    """The k best of the rows that pass the filters; the filters reach the scan."""
    rows = vectors
    if source:
        rows = rows.where(F.contains("source_id", F.lit(source)))
    if kind:
        rows = rows.where(F.col("type") == kind)
    return knn(rows, [(0, query)], k, metric, ("source_id", "type"))


def with_chunks(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """Search results with their chunks; hits without a chunk are dropped, so fewer than k may be left."""
    return top.join(chunks, "id", "inner")


class Coder(NamedTuple):
    """What vectors are told by: their codes (rows of bytes), and what codes tell of them."""

    code: Callable[[np.ndarray], np.ndarray]
    told: Callable[[np.ndarray], np.ndarray]


def _packed(rows: DataFrame, tasks: int, size: int, coder: Coder | None = None) -> DataFrame:
    """(ids, vectors, codes, dim, longest) of ``rows`` (id, embedding): blocks of ``size`` rows, by norm within a task, the longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [b for b in batches if b.num_rows]
        if not taken:
            return
        dim = taken[0].column(1).value_lengths()[0].as_py()
        ids, values = np.concatenate([b.column(0).to_numpy() for b in taken]), np.concatenate([_values(b.column(1), dim) for b in taken])
        norms = np.sqrt((values**2).sum(1))
        order = np.argsort(-norms, kind="stable")
        for i in range(0, len(ids), size):
            of = order[i : i + size]
            code = b"" if coder is None else coder.code(values[of]).tobytes()
            yield pa.RecordBatch.from_pydict({"ids": [ids[of].tobytes()], "vectors": [values[of].tobytes()], "codes": [code], "dim": [dim], "longest": [norms[of[0]]]})

    return rows.repartition(tasks).mapInArrow(run, "ids binary, vectors binary, codes binary, dim long, longest double")


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", coder: Coder | None = None) -> DataFrame:
    """(query_id, rank, id, similarity, distance) for every row of ``queries`` (query_id, embedding), of which there may be any number.

    Both sides are packed into blocks; a task takes blocks of queries one by one and up to HELD values of vectors, and the k best of a query from each such part are merged.
    So a task needs one Python worker, with as much memory for few rows as for many, and neither side passes the driver. Blocks of great norm come first, so that a query
    soon has neighbours that rule the others out (Cauchy-Schwarz); with a ``coder``, so do the codes.
    """
    spark, kind = vectors.sparkSession, distance_of(metric)
    known = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding")
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    first, n_known, n_asked = known.select(F.size("embedding")).first(), known.count(), asked.count()
    if not first or not n_asked:
        return knn(vectors.limit(0), [(0, [0.0])], k, metric)
    held, tasks = max(BLOCK, HELD // max(1, first[0])), int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(ASKED, max(256, -(-n_asked // tasks)))
    folder = scratch(spark, "knn")
    _packed(known, -(-4 * n_known // held), BLOCK, coder).write.parquet(folder)
    parts = -(-n_known // held)
    blocks = spark.read.parquet(folder).coalesce(parts).sortWithinPartitions(F.desc("longest"))
    n = -(-n_asked // size)
    packed = _packed(asked, n, size).select(F.col("ids").alias("query_ids"), F.col("vectors").alias("asked"), F.col("dim").alias("asked_dim"))
    # shuffled, so that they aren't packed again for each part of the vectors, beside its scoring; a task takes several, so that vectors aren't read again for each
    pairs = packed.repartition(min(n, -(-tasks // parts))).join(blocks.hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, best = None, np.zeros(0, np.int64), None
        for batch in batches:
            for r in batch.to_pylist():
                if last != (now := (r["query_ids"], r["asked"])):
                    if best is not None:
                        yield best.batch(ids)
                    last, ids = now, np.frombuffer(r["query_ids"], np.int64)
                    best = Nearest(np.frombuffer(r["asked"]).reshape(len(ids), -1), k, kind)
                if r["dim"] != r["asked_dim"]:
                    raise ValueError(f"vector of {r['dim']} values where {r['asked_dim']} are due")
                block = np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
                told = None if coder is None else coder.told(np.frombuffer(r["codes"], np.uint8).reshape(len(block), -1))[:, : r["dim"]]
                best.add(np.frombuffer(r["ids"], np.int64), block, told)
        if best is not None:
            yield best.batch(ids)

    return _ranked(pairs.mapInArrow(run, "query_id long, id long, score double"), k, kind)


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, rank, id, similarity, distance) for every row of ``queries`` (query_id, embedding): up to MOST_QUERIES are sent with the tasks, more meet the vectors in blocks."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where("embedding is not null")
    first = asked.limit(MOST_QUERIES + 1).collect()
    if len(first) > MOST_QUERIES:
        return knn_blocks(vectors, asked, k, metric)
    rows = [(r.query_id, r.embedding) for r in first]
    return knn(vectors, rows, k, metric) if rows else knn(vectors.limit(0), [(0, [0.0])], k, metric)
