"""An inverted-file index for nearest neighbours: vectors in lists by their nearest centroid, of which a search reads a few.

Exact search (``vectors``) stays the default. The centroids are fitted on a bounded sample (SAMPLE rows, those of the least
hashes of the id), but every vector is put into a list. A list is a partition of the written table, so a search reads only the
folders of the lists that it probes. Hits are scored exactly; what may be missing are neighbours in other lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import vectors as exact

SAMPLE, MOST_LISTS, ROUNDS = 16_384, 1024, 10
#: Share of the lists that a search probes by default. On vectors without clusters (the driver's tables) it takes this much for a recall
#: of 0.92 to 0.93 among ten neighbours (half: 0.85 to 0.88, a quarter: 0.65 to 0.70); where vectors are clustered, fewer ``probes`` do.
PROBED = 0.6


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The place of the nearest centroid of each row, by Euclidean distance; of ties the first."""
    return np.argmin((centroids**2).sum(1) - 2 * rows @ centroids.T, axis=1)


def fit(rows: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of ``rows`` by Lloyd's rounds, begun with different rows; a list that runs empty keeps its centroid."""
    centroids = np.unique(rows, axis=0)
    centroids = centroids[np.linspace(0, len(centroids) - 1, min(lists, len(centroids))).astype(int)]
    for _ in range(ROUNDS):
        place = _nearest(rows, centroids)
        sizes = np.bincount(place, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, place, rows)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> None:
    """Write an index of ``vectors`` (id, embedding; null vectors are left out) to ``path``.

    There are about as many lists as the root of the number of vectors, MOST_LISTS at most. Rows are dealt by ranges of (list, id), so
    that a list with many rows, as of copies, is written by several tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding")
    n = rows.count()
    taken = [r.embedding for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    if not taken:
        raise ValueError("there is nothing to index")
    centroids = fit(np.array(taken, np.float64), lists or max(1, min(MOST_LISTS, int(n**0.5))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                place = _nearest(exact._values(part.column(1), centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(place.astype(np.int32))], ["id", "embedding", "list"])

    dealt = rows.mapInArrow(run, f"id long, embedding {rows.schema['embedding'].dataType.simpleString()}, list int")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartitionByRange(tasks, "list", "id").write.partitionBy("list").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")


def knn(spark: SparkSession, path: str, queries: list[tuple[int, list[float]]], k: int, metric: str = "cosine", probes: int | None = None) -> DataFrame:
    """As ``vectors.knn``, over the ``probes`` best lists of each query (a PROBED share of them by default)."""
    found = {r.list: r.centroid for r in spark.read.parquet(f"{path}/centroids").collect()}
    centroids = np.array([found[i] for i in range(len(found))])
    asked = np.array([v for _, v in queries], np.float64)
    scores = exact._scores(asked, centroids, exact.distance_of(metric))
    probes = probes or max(1, int(np.ceil(PROBED * len(centroids))))
    probed = np.unique(np.argsort(-scores, axis=1, kind="stable")[:, :probes]).tolist()
    return exact.knn(spark.read.parquet(f"{path}/vectors").where(F.col("list").isin(probed)), queries, k, metric)
