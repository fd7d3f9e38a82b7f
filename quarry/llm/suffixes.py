"""Suffix-array deduplication of byte strings with hash-compared suffix sorting.

In a shard all suffixes that start at the segments' minimizers are sorted by a bottom-up mergesort.
Two suffixes are compared by their longest common extension, found by binary search over prefix
polynomial hashes (logarithmic in the extension), then by the next byte. Suffixes that start left of a
minimizer follow by stable passes on one preceding byte each, so the order of every window start is
known. Equal windows are neighbours in it. Equality told by hashes is verified on the bytes; on a
collision the shard is sorted anew under another base. Segments that were collapsed before are told by the
BLAKE2b digest of their own bytes at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import passages
from quarry.llm.common import Rolling, documents

BYTES = passages.Cut("byte", width=200, gram=24, step=4)
#: Seeds of the byte tables; the next is used where a collision was found.
SEEDS = (11, 12, 13, 14)


class Collision(Exception):
    """Two different strings had one hash."""


class SuffixSort:
    """Sorted suffixes of ``text`` at ``starts``, each at most ``limit`` bytes long, compared by hashes."""

    def __init__(self, text: np.ndarray, seed: int):
        table = np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.text, self.roll = text, Rolling(table[text])

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension of the suffixes at a and b, at most ``most``: binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.roll.ranges(a, a + middle) == self.roll.ranges(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def less(self, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """Whether suffix a (of length la) comes before suffix b; a prefix comes first."""
        most = np.minimum(la, lb)
        e = self.extension(a, b, most)
        ends = e == most
        last = len(self.text) - 1
        return np.where(ends, la < lb, self.text[np.minimum(a + e, last)] < self.text[np.minimum(b + e, last)])

    def sort(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Stable bottom-up mergesort: each element finds its place in the other run by binary search."""
        n = len(starts)
        order = np.arange(n)
        run = 1
        while run < n:
            place = np.arange(n)
            base = place // (2 * run) * (2 * run)
            middle, end = np.minimum(base + run, n), np.minimum(base + 2 * run, n)
            left = place < middle
            low, high = np.where(left, middle, base), np.where(left, end, middle)
            origin = low.copy()
            live = np.flatnonzero(low < high)
            while len(live):
                at = (low[live] + high[live]) >> 1
                own, other = order[live], order[at]
                # elements of the left run stay before equal ones of the right run
                first = np.where(left[live], other, own)
                second = np.where(left[live], own, other)
                before = self.less(starts[first], lengths[first], starts[second], lengths[second])
                right = np.where(left[live], before, ~before)
                low[live], high[live] = np.where(right, at + 1, low[live]), np.where(right, high[live], at)
                live = live[low[live] < high[live]]
            target = np.where(left, place + (low - origin), place - (middle - low))
            merged = np.empty(n, np.int64)
            merged[target] = order
            order = merged
            run *= 2
        return order


def repeated_windows(table: pa.Table, width: int = BYTES.width) -> list[bytes]:
    """For each segment of a shard, packed bits of the windows that start anywhere else too."""
    for seed in SEEDS:
        try:
            return _repeated(table, width, seed)
        except Collision:
            continue
    raise RuntimeError("every table of byte hashes met a collision")


def _repeated(table: pa.Table, width: int, seed: int) -> list[bytes]:
    n, at, times = (table.column(k).to_numpy() for k in ("n", "at", "times"))
    n, at = n.astype(np.int64), at.astype(np.int64)
    sizes = n + width - 1
    text = np.frombuffer(b"".join(table.column("seg").to_pylist()), np.uint8)
    begin = np.cumsum(sizes) - sizes
    anchor = begin + at
    # the window that starts o bytes before the minimizer is the segment's window number at - o
    suffixes = SuffixSort(text, seed)
    order = suffixes.sort(anchor, np.minimum(begin + sizes - anchor, width))
    hit = np.repeat(times > 1, n)
    first = np.cumsum(n) - n
    partner = np.full(len(n), -1)
    for o in range(int(at.max(initial=-1)) + 1):
        order = order[at[order] >= o]
        if o:
            order = order[np.argsort(text[anchor[order] - o], kind="stable")]
        valid = order[at[order] - o < n[order]]
        if len(valid) < 2:
            continue
        start = anchor[valid] - o
        code = suffixes.roll.ranges(start, start + width)
        same = code[1:] == code[:-1]
        a, b = valid[:-1][same], valid[1:][same]
        # neighbours that were equal one byte to the right differ at most in the first byte
        known = partner[a] == b
        if (text[anchor[a] - o] != text[anchor[b] - o]).any():
            raise Collision
        fresh_a, fresh_b = anchor[a[~known]] - o, anchor[b[~known]] - o
        span = np.arange(width)
        for i in range(0, len(fresh_a), 2048):
            if (text[fresh_a[i : i + 2048, None] + span] != text[fresh_b[i : i + 2048, None] + span]).any():
                raise Collision
        partner[valid] = -1
        partner[a] = b
        hit[first[a] + at[a] - o] = True
        hit[first[b] + at[b] - o] = True
    return [np.packbits(bits).tobytes() if bits.any() else b"" for bits in np.split(hit, np.cumsum(n)[:-1])]


def repeats_removed(docs: DataFrame, cut: passages.Cut = BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left).

    A byte goes if a string of ``cut.width`` bytes that covers it starts anywhere else in the corpus too,
    in the same document included; strings are judged on the input and never cross documents. A null
    text is empty; long texts are cut in overlapping pieces, whole; an empty table gives no rows. Every row counts, also those that repeat a
    doc_id (with the same text or another) or have none. Other columns are not read, whatever their names.
    """
    base = passages.placed(docs)
    found = passages.marks(base, cut, lambda t: repeated_windows(t, cut.width), keep_first=False)

    def judge(text: bytes, spans: list | None) -> tuple:
        if not spans:
            return len(text), 0, 0, text
        gone = passages.covered(len(text), cut.width, spans, lambda a, b: text[a:b])
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(text), int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()

    return passages.marked(base, found, judge, "n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats_removed(documents(spark, sf_dir))
    return found.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as kept_sha256")


QUERIES = {"op10_suffixes": op10_suffixes}
SQL = {
    "op10_suffixes": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(length(h) // 2)) AS j FROM d),
w AS (SELECT doc_id, j, substr(h, CAST(2 * j + 1 AS BIGINT), 2) AS byte, CASE WHEN 2 * j + 400 <= length(h) THEN md5(substr(h, CAST(2 * j + 1 AS BIGINT), 400)) END AS win FROM b),
f AS (SELECT doc_id, j, byte, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS twice FROM w),
l AS (SELECT doc_id, j, byte, max(CASE WHEN twice THEN j END) OVER (PARTITION BY doc_id ORDER BY j) AS last FROM f),
g AS (SELECT doc_id, j, byte, coalesce(j - last < 200, false) AS gone FROM l),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS starts FROM g),
r AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans,
    string_agg(byte, '' ORDER BY j) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
}
