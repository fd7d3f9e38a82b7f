"""Substring deduplication with a compressed FM-index per shard.

A shard holds the distinct segments of its minimizers in order of place. Segment r of a minimizer is
streamed backwards against an index of segments before it, in levels: at level k the index has the segments whose
rank has bit k clear, and those that have it set are streamed, so each pair meets in the level of the
highest bit in which the ranks differ, and most segments, being one of two, are indexed or streamed once.
Each symbol extends the match to the left; matches at the full length are first widened to one symbol less, so every
position carries its matching statistic up to the threshold, and the interval of suffixes that share it.
Where the statistic reaches the window, the least place in the interval tells whether the window starts earlier.

Of an index these are kept: the Burrows-Wheeler transform as a wavelet matrix (1.5 bits for each bit of a symbol), the
common prefix of neighbouring suffixes (a byte a symbol), the least place of each full-length interval, and the
borders of intervals (4 bytes each) of the lengths that were asked for. Text, ranks and suffix array are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import passages
from quarry.llm.common import documents

WORDS = passages.Cut("word", width=20, gram=4, step=1)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols or more, by doubling."""
    n = len(text)
    rank, h = text.astype(np.int64), 1
    sigma = int(rank.max(initial=0)) + 1
    while True:
        wide = np.zeros(n, np.int64)
        wide[: max(0, n - h)] = rank[h:] + (h > 1)
        key = rank * (int(rank.max(initial=0)) + 2) + wide
        if h == 1 and sigma < 1 << 20:  # three symbols at once
            third = np.zeros(n, np.int64)
            third[: max(0, n - 2)] = rank[2:]
            key = (key << 20) | third
            h = 3
        else:
            h *= 2
        order = np.argsort(key)
        if h >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]) if n else 0


class FMIndex:
    """Index of symbols 1..sigma-1, with 0 as the separator, for patterns of up to ``depth`` symbols; ``places`` are of suffixes."""

    def __init__(self, text: np.ndarray, depth: int, places: np.ndarray):
        self.size, self.depth = len(text), depth
        self.sigma = int(text.max(initial=0)) + 1
        order = suffix_order(text, depth)
        self._wavelet(text[order - 1], np.bincount(text, minlength=self.sigma))
        self._borders: dict[int, np.ndarray] = {}
        self._common(text, order)
        self.least = np.minimum.reduceat(places[order], self.borders(depth)[:-1])

    def _common(self, text: np.ndarray, order: np.ndarray) -> None:
        """The common prefix of each suffix with the one before it, up to ``depth``."""
        self.common = np.zeros(self.size, np.uint8)
        padded = np.r_[text, np.full(self.depth, -1)]
        live = np.arange(1, self.size)
        for k in range(self.depth):
            live = live[padded[order[live] + k] == padded[order[live - 1] + k]]
            self.common[live] += 1

    def _wavelet(self, symbols: np.ndarray, counts: np.ndarray) -> None:
        self.levels = []
        base = np.zeros(self.sigma, np.int64)
        alphabet = np.arange(self.sigma)
        for level in range(max(1, int(self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.zeros((self.size // 64 + 2) * 8, np.uint8)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            ones = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int32)].astype(np.int32)
            zeros = self.size - int(bit.sum())
            self.levels.append((level, words, ones, zeros))
            r = self._rank1(words, ones, base)
            base = np.where((alphabet >> level) & 1, zeros + r, base - r)
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.shift = np.r_[0, np.cumsum(counts)[:-1]] - base

    @staticmethod
    def _rank1(words: np.ndarray, ones: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        below = words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return ones[w] + np.bitwise_count(below).astype(np.int64)

    def step(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the suffixes before place i that follow ``symbols`` end."""
        for level, words, ones, zeros in self.levels:
            r = self._rank1(words, ones, i)
            i = np.where((symbols >> level) & 1, zeros + r, i - r)
        return i + self.shift[symbols]

    def borders(self, depth: int) -> np.ndarray:
        """Where the intervals of suffixes alike in ``depth`` symbols begin, and the end of the last."""
        if depth not in self._borders:
            self._borders[depth] = np.r_[np.flatnonzero(self.common < depth) if depth else 0, self.size].astype(np.int32)
        return self._borders[depth]

    def interval(self, place: np.ndarray, depth: int) -> np.ndarray:
        return np.searchsorted(self.borders(depth), place, side="right") - 1

    def _widen(self, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        borders, i = self.borders(depth), self.interval(left, depth)
        return borders[i], borders[i + 1]

    def earliest(self, place: np.ndarray) -> np.ndarray:
        """The least place that a full-length match at ``place`` has."""
        return self.least[self.interval(place, self.depth)]

    def statistics(self, symbols: np.ndarray, ends: np.ndarray, sizes: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: at each symbol of each streamed piece, the longest match up to ``depth`` and a place in its interval.

        Piece k is symbols[ends[k] - sizes[k] : ends[k]]; symbols outside the index's alphabet match nothing. A piece whose
        remaining symbols can't make a match of ``least`` is given up; what is left of it has statistic 0.
        """
        length, place = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int64)
        left, right, m = np.zeros(len(ends), np.int64), np.full(len(ends), self.size), np.zeros(len(ends), np.int64)
        common = np.r_[self.common, np.uint8(0)].astype(np.int64)
        live = np.arange(len(ends))
        for t in range(int(sizes.max(initial=0))):
            live = live[(sizes[live] > t) & (m[live] + sizes[live] - t >= least)]
            if not len(live):
                break
            at = ends[live] - 1 - t
            c = symbols[at]
            l, r, d = left[live], right[live], m[live]
            full = np.flatnonzero(d == self.depth)
            l[full], r[full] = self._widen(l[full], self.depth - 1)
            d[full] -= 1
            known = (c > 0) & (c < self.sigma)
            todo, unknown = np.flatnonzero(known), np.flatnonzero(~known)
            l[unknown], r[unknown], d[unknown] = 0, self.size, 0
            while len(todo):
                a, b = np.split(self.step(np.r_[c[todo], c[todo]], np.r_[l[todo], r[todo]]), 2)
                found = a < b
                hit = todo[found]
                l[hit], r[hit] = a[found], b[found]
                d[hit] += 1
                todo = todo[~found]
                todo = todo[d[todo] > 0]
                # the next shorter match that has a larger interval
                d[todo] = np.maximum(common[l[todo]], common[r[todo]])
                for depth in np.unique(d[todo]):
                    lane = todo[d[todo] == depth]
                    l[lane], r[lane] = self._widen(l[lane], int(depth))
            length[at], place[at] = d, l
            left[live], right[live], m[live] = l, r, d
        return length, place


def _runs(symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of some pieces, each followed by a separator; the piece of each symbol, and its offset there."""
    piece = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    inside = offset < sizes[piece]
    out = np.zeros(len(piece), np.int32)
    out[inside] = symbols[(begins[piece] + offset)[inside]]
    return out, piece, offset


def earlier_windows(table: pa.Table, width: int = WORDS.width) -> list[bytes]:
    """For each segment of a shard, packed bits of the windows that start earlier than in its first occurrence."""
    route, doc, same, start, n = (table.column(k).to_numpy() for k in ("route", "doc", "same", "start", "n"))
    n = n.astype(np.int64)
    sizes = n + width - 1
    words = b" ".join(table.column("seg").to_pylist()).split()
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
    symbols = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
    begins, windows = np.cumsum(sizes) - sizes, np.cumsum(n) - n
    order = np.lexsort((same, doc))
    document = np.empty(len(doc), np.int64)
    document[order] = np.cumsum(np.r_[False, (doc[order][1:] != doc[order][:-1]) | (same[order][1:] != same[order][:-1])]) if len(doc) else 0
    place = (document << 32) | start
    fresh = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
    members = np.diff(np.r_[fresh, len(route)])
    rank, members = np.arange(len(route)) - np.repeat(fresh, members), np.repeat(members, members)
    earlier = np.zeros(int(n.sum()), bool)
    for level in range(int(members.max(initial=1) - 1).bit_length()):
        several = members > 1 << level
        below, above = (np.flatnonzero(several & ((rank >> level) & 1 == bit)) for bit in (0, 1))
        text, piece, offset = _runs(symbols, begins[below], sizes[below])
        known = np.unique(text[text > 0])
        code = np.zeros(len(vocabulary) + 1, np.int32)
        code[known] = np.arange(1, len(known) + 1)
        index = FMIndex(code[text], width, np.where(offset < n[below][piece], place[below][piece] + offset, np.iinfo(np.int64).max))
        asked, piece, offset = _runs(symbols, begins[above], sizes[above])
        length, at = index.statistics(code[asked], np.cumsum(sizes[above] + 1) - 1, sizes[above], width)
        hit = np.flatnonzero(length == width)
        piece, offset = above[piece[hit]], offset[hit]
        first = index.earliest(at[hit]) < place[piece] + offset
        earlier[(windows[piece] + offset)[first]] = True
    return [np.packbits(bits).tobytes() if bits.any() else b"" for bits in np.split(earlier, windows[1:])]


def repeats_removed(docs: DataFrame, cut: passages.Cut = WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of ``cut.width`` words that covers it starts earlier (in a smaller doc_id,
    or in the same document further left); windows are judged on the input. A null text has no words, like an empty one;
    long texts are cut in overlapping pieces, whole; an empty table gives no rows. Rows equal in doc_id and text are the same document, each
    reported alike. Different texts of one doc_id are documents of their own, in the order of their hashes; rows without a
    doc_id come after all others, likewise. Other columns are not read, whatever their names.
    """
    base = passages.placed(docs)
    found = passages.marks(base, cut, lambda t: earlier_windows(t, cut.width), keep_first=True)

    def judge(text: bytes, spans: list | None) -> tuple:
        words = text.split()
        gone = passages.covered(len(words), cut.width, spans, lambda a, b: b" ".join(words[a:b]))
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
        return len(words), int(gone.sum()), b" ".join(kept).decode()

    return passages.marked(base, found, judge, "n_words long, n_removed long, kept string")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats_removed(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op1_substrings": op1_substrings}
SQL = {
    "op1_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 20], ' ')) AS win
  FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
lists AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS j FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept
  FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
}
