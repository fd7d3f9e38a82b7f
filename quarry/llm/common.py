"""Shared pieces of the training-data operators: scratch tables, Arrow text access, word hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.scratch import scratch

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The place of rows without a doc_id: behind all others.
LAST = (1 << 63) - 1
#: Rows of two long columns that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def row_key(docs: DataFrame, doc: str = "doc", same: str = "same") -> list[Column]:
    """Columns that tell rows: the doc_id (LAST if there is none), and 64 bits of a hash of the text."""
    known = F.col("doc_id").cast("bigint")
    return [F.coalesce(known, F.lit(LAST)).alias(doc), F.xxhash64(known.isNull(), F.col("text").cast("string")).alias(same)]


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty texts."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of some rows, so that what Python makes of one stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def blocks(items: Iterable[tuple], size: int = 1 << 21) -> Iterator[list[tuple]]:
    """Cut (…, bytes) tuples into lists of about ``size`` bytes, so temporaries stay bounded."""
    held, n = [], 0
    for item in items:
        held.append(item)
        n += len(item[-1]) + 64
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Rolling:
    """Polynomial hashes modulo 2**64 of any range of a symbol array, from prefix sums."""

    BASE = 0x9E3779B97F4A7C15
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if len(Rolling._up) <= n:
            size = (n // (1 << 16) + 1) << 16
            for name, base in (("_up", self.BASE), ("_down", inverse(self.BASE))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(powers))
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * self._up[:n], out=self.prefix[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self._down[start]

    def windows(self, width: int) -> np.ndarray:
        n = len(self.prefix) - width
        return (self.prefix[width:] - self.prefix[:n]) * self._down[:n] if n > 0 else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low and high bits of a hash are equally good."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTE_HASH = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_places(data: np.ndarray, no_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes; bytes marked in ``no_word`` belong to none."""
    word = ~SPACE[data]
    if no_word is not None:
        word &= ~no_word
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return mixed(Rolling(BYTE_HASH[data]).ranges(starts, ends) + mixed((ends - starts).astype(np.uint64)))


def hashed_words(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends = word_places(data)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return np.split(word_hashes(data, starts, ends), np.searchsorted(starts, bounds[:-1])) if texts else []


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by ``cols`` into the session's number of shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(c) for c in cols])
