"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of their bit
counts. The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, so pairs within 3 bits lie within range 3 in the embedded space. The 32 coordinates are
dealt to six blocks; a total difference of 3 leaves at least three blocks untouched, so the range join
is an equi-join on the unit grid cells of the 20 projections on three blocks. Candidates pass the
Manhattan lower bound, then the exact bit count.

Equal fingerprints are collapsed before the join. A cell with more members than ``BLOCK`` is cut into
blocks, each pair of blocks being a task of its own; large cells yield a spanning forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, settle, slices, spread, text_bytes
from quarry.llm.components import components

BLOCK, SMALL = 4096, 16
EVEN = 0x5555555555555555
#: Coordinates (two-bit segments) in each of the six blocks.
WIDTHS = (6, 6, 5, 5, 5, 5)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits over XXH64 (seed 42) of all word shingles; 0 where there are no words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        digest = xxhash.xxh64_intdigest
        last = ends[shingle - 1 :].tolist()
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(last)].tolist(), last, strict=True)]
    values = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[i : i + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(values), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed 64-bit integer. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _masks() -> list[int]:
    at, blocks = 0, []
    for width in WIDTHS:
        blocks.append(((1 << 2 * width) - 1) << at)
        at += 2 * width
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): the 20 projected grid cells of every fingerprint."""
    fp = F.col("fp")
    even, odd = F.lit(EVEN), F.shiftrightunsigned(fp, 1)
    # digits 0, 1, 2 of two bits each, without carries
    counts = fp.bitwiseXOR(odd).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(odd).bitwiseAND(even), 1))
    keys = [F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(_masks())]
    return fps.select("fp", counts.alias("counts")).select(F.explode(F.array(*keys)).alias("cell"), "fp")


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Manhattan bound on the embeddings, then the exact bit count. The digits 0, 1, 2 are compared in unary."""
    even, one = np.uint64(EVEN), np.uint64(1)
    ca, cb = (a & even) + ((a >> one) & even), (b & even) + ((b >> one) & even)
    bound = np.bitwise_count(((ca | (ca >> one)) ^ (cb | (cb >> one))) & even) + np.bitwise_count(((ca ^ cb) >> one) & even)
    return (bound <= bits) & (np.bitwise_count(a ^ b) <= bits)


def _forest(fp: np.ndarray, side: np.ndarray, cross: bool, bits: int) -> list[tuple[int, int]]:
    """Breadth-first spanning forest of the links in one large cell."""
    left, edges = np.arange(len(fp)), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            u = frontier.pop()
            hit = _near(fp[u], fp[left], bits)
            if cross:
                hit &= side[left] != side[u]
            edges += [(u, v) for v in left[hit]]
            frontier += left[hit].tolist()
            left = left[~hit]
    return edges


def _links(group: np.ndarray, fp: np.ndarray, side: np.ndarray, cross: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``group``: neighbours by offset in small runs, a forest in large ones."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    size = np.repeat(sizes, sizes)
    a, b = [], []
    for d in range(1, min(SMALL, int(sizes.max(initial=0)))):
        i = np.flatnonzero((group[d:] == group[:-d]) & (size[:-d] <= SMALL))
        if not len(i):
            break
        i = i[_near(fp[i], fp[i + d], bits) & (~cross[i] | (side[i] != side[i + d]))]
        a.append(fp[i])
        b.append(fp[i + d])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        part = slice(s, s + n)
        if edges := _forest(fp[part], side[part], bool(cross[s]), bits):
            u, v = np.array(edges).T
            a.append(fp[part][u])
            b.append(fp[part][v])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(u, v) with u > v: enough links between distinct fingerprints to connect all that lie within ``bits``.

    ``fps`` has distinct fingerprints. All pairs are found in cells of up to 16 members; larger cells
    give a spanning forest of their links, which connects the same fingerprints.
    """
    if bits > 3:
        raise ValueError("the projected grid is complete up to 3 bits")
    grid = settle(cells(fps), "cells")
    crowded = grid.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    n_blocks = F.ceil(F.col("members") / BLOCK)
    block = F.when(F.col("members") > BLOCK, F.pmod(F.xxhash64("fp", F.lit("block")), n_blocks)).otherwise(F.lit(0)).cast("long")
    dealt = (
        grid.join(crowded, "cell")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (n_blocks - 1).cast("long"))))
        .select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
        .withColumn("task", F.xxhash64("cell", "i", "j"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        for batch in _with_end(batches):
            if batch is not None:
                now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
                held = [np.concatenate(x) for x in zip(held, now, strict=True)]
            earlier = np.flatnonzero(held[0] != held[0][-1]) if batch is not None and len(held[0]) else []
            cut = len(held[0]) if batch is None else int(earlier[-1]) + 1 if len(earlier) else 0
            if cut:  # the last group may go on in the next batch
                task, fp, side, cross = (x[:cut] for x in held)
                held = [x[cut:] for x in held]
                u, v = (x.view(np.int64) for x in _links(task, fp.view(np.uint64), side, cross, bits))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    rows = dealt.select("task", "fp", "block", (F.col("i") != F.col("j")).alias("cross"))
    found = spread(rows, "task").sortWithinPartitions("task", "fp").mapInArrow(run, "u long, v long")
    return found.where("u <> v").distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most ``bits`` differing bits.

    A null text is an empty one (fingerprint 0); long texts are taken whole; an empty table gives no rows. Rows that repeat a doc_id keep
    their own rows; a null doc_id takes part but never names a component unless nothing else does. Other columns are
    not read, whatever their names.
    """
    marked = settle(fingerprints(docs, shingle), "fps")
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), bits))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = labelled.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}

#: Fixed values of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SEED = 42
_P1, _P2, _P3, _P4, _P5 = (f"{p}::UHUGEINT" for p in PRIMES)
_MOD = f"{1 << 64}::UHUGEINT"


def _turned(x: str, bits: int) -> str:
    """SQL for 64 bits turned left: a product modulo 2**64 - 1."""
    return f"(({x}) * {1 << bits}::UHUGEINT % {(1 << 64) - 1}::UHUGEINT)"


def _number(at: str, n: int) -> str:
    """SQL for the ``n`` bytes at an offset of the hexadecimal digits, lowest first."""
    digits = " || ".join(f"substr(digits, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n)))
    return f"(('0x' || {digits})::UBIGINT::UHUGEINT)"


def _round(lane: str, k: str) -> str:
    return f"({_turned(f'({lane} + {k} * {_P2}) % {_MOD}', 31)} * {_P1} % {_MOD})"


def _fold(first: str, rest: str, step: str) -> str:
    return f"list_reduce(list_prepend(({first})::UHUGEINT, {rest}), lambda h, k: {step})"


_STARTS = [(SEED + PRIMES[0] + PRIMES[1]) % (1 << 64), (SEED + PRIMES[1]) % (1 << 64), SEED, (SEED - PRIMES[0]) % (1 << 64)]
_LANES = ", ".join(_fold(str(start), f"list_transform(range(bytes // 32), lambda i: {_number(f'32 * i + {8 * j}', 8)})", _round("h", "k")) + f" AS lane{j}" for j, start in enumerate(_STARTS))
_JOINED = "(" + " + ".join(_turned(f"lane{j}", bits) for j, bits in enumerate((1, 7, 12, 18))) + f") % {_MOD}"
_MERGED = _fold(_JOINED, "[lane0, lane1, lane2, lane3]", f"(xor(h, {_round('0::UHUGEINT', 'k')}) * {_P1} + {_P4}) % {_MOD}")
_EIGHTS = _fold("h", f"list_transform(range(bytes % 32 // 8), lambda i: {_number('bytes // 32 * 32 + 8 * i', 8)})", f"({_turned(f'xor(h, {_round("0::UHUGEINT", "k")})', 27)} * {_P1} + {_P4}) % {_MOD}")
_FOURS = _fold("h", f"list_transform(range(bytes % 8 // 4), lambda i: {_number('bytes // 8 * 8', 4)})", f"({_turned(f'xor(h, k * {_P1} % {_MOD})', 23)} * {_P2} + {_P3}) % {_MOD}")
_ONES = _fold("h", f"list_transform(range(bytes % 4), lambda i: {_number('bytes // 4 * 4 + i', 1)})", f"{_turned(f'xor(h, k * {_P5} % {_MOD})', 11)} * {_P1} % {_MOD}")
_BITS = " + ".join(f"CASE WHEN 2 * sum(n * (h >> {b} & 1)) > sum(n) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
SQL = {
    "op7_simhash": rf"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS ws
  FROM documents),
every AS (
  SELECT r, unnest(CASE WHEN len(ws) <= 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS s
  FROM t WHERE len(ws) > 0),
counted AS (SELECT r, s, count(*) AS n FROM every GROUP BY r, s),
digits AS (SELECT s, strlen(s) AS bytes, hex(encode(s)) AS digits FROM (SELECT DISTINCT s FROM counted)),
lanes AS (SELECT *, {_LANES} FROM digits),
started AS (SELECT s, bytes, digits, ((CASE WHEN bytes < 32 THEN {(SEED + PRIMES[4]) % (1 << 64)}::UHUGEINT ELSE {_MERGED} END) + bytes::UHUGEINT) % {_MOD} AS h FROM lanes),
eights AS (SELECT s, bytes, digits, {_EIGHTS} AS h FROM started),
fours AS (SELECT s, bytes, digits, {_FOURS} AS h FROM eights),
ones AS (SELECT s, {_ONES} AS h FROM fours),
mixed1 AS (SELECT s, xor(h, h // {1 << 33}::UHUGEINT) * {_P2} % {_MOD} AS h FROM ones),
mixed2 AS (SELECT s, xor(h, h // {1 << 29}::UHUGEINT) * {_P3} % {_MOD} AS h FROM mixed1),
hashed AS (SELECT s, xor(h, h // {1 << 32}::UHUGEINT)::UBIGINT AS h FROM mixed2),
majority AS (SELECT r, {_BITS} AS fp FROM counted JOIN hashed USING (s) GROUP BY r),
marked AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM t LEFT JOIN majority USING (r)),
nodes AS (SELECT fp, min(doc_id) AS first FROM marked GROUP BY fp),
links AS (SELECT a.fp AS u, b.fp AS v FROM nodes a JOIN nodes b ON bit_count(xor(a.fp, b.fp)::HUGEINT) <= 3),
reached AS (SELECT fp AS u, fp AS v FROM nodes UNION SELECT reached.u, links.v FROM reached JOIN links ON reached.v = links.u),
classes AS (SELECT u AS fp, min(first) AS component_id FROM reached JOIN nodes ON reached.v = nodes.fp GROUP BY u)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM marked JOIN classes USING (fp)
"""
}
