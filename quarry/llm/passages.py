"""Repeated windows of fixed width, found shard by shard: the routing that substring deduplication shares.

Every window of ``width`` symbols is routed by its minimizer, the least hashed gram of ``gram`` symbols
in it: equal windows have equal minimizers, so they meet in one shard, and each document is streamed
only against shards that can hold one of its windows. Neighbouring windows with the same minimizer
travel as one segment. Only minimizers that occur twice or more are candidates; segments equal in two
hashes of 64 bits (a polynomial and XXH3) are collapsed to their first occurrence before any text moves.
What a shard then searches is given by the caller (an FM-index, a suffix sort), on the segments' own
text. Nothing is removed on the word of those hashes alone: each occurrence's own text must have the
BLAKE2b digest (128 bits) of the searched text, or the query fails.

A row is told by its doc_id and 64 bits of a hash of its text, so a doc_id may have several texts; rows
without a doc_id come last. Rows equal in both are the same document, each reported.

Hot minimizers (a passage in a third of all documents) would gather all its surroundings in one shard.
Those with more rows than a quarter of an even partition, or than HOT_MOST, are dealt further: their
windows are grouped by offset in steps, under the hash of what a step shares. Up to HOT_TOLD of them are
told to the tasks that cut; where there are more, the documents that have some are joined and cut again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BYTE_HASH, Rolling, blocks, hashed_words, mixed, row_key, settle, spread, text_bytes

#: Rows of one minimizer in a shard, and hot minimizers told to the tasks.
HOT_MOST, HOT_LEAST, HOT_TOLD = 8192, 512, 20_000
#: Symbols of text handled at once while cutting, and while searching a shard.
PIECE, SHARD = 1 << 18, 1 << 21
_LOW = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Cut:
    """What a window is: bytes or words, its width, the minimizer's width, and the step for hot minimizers."""

    unit: str
    width: int
    gram: int
    step: int


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, in three passes whatever w is."""
    n = len(x) - w + 1
    pad = -len(x) % w
    grid = np.r_[x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)].reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(symbols: np.ndarray, room: np.ndarray, cut: Cut) -> dict[str, np.ndarray]:
    """Segments of windows with one minimizer: start, n (windows), at (the minimizer's offset from the start), key (the minimizer).

    ``room`` is, for each symbol, how many symbols its document has from there on.
    """
    n = len(symbols) - cut.width + 1
    if n <= 0:
        return {"start": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "at": np.zeros(0, np.int64), "key": np.zeros(0, np.uint64)}
    grams = mixed(Rolling(symbols).windows(cut.gram))
    place = np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least((grams & ~_LOW) | place, cut.width - cut.gram + 1) & _LOW).astype(np.int64)
    valid = room[:n] >= cut.width
    change = np.r_[True, (anchor[1:] != anchor[:-1]) | ~valid[:-1]]
    first = np.flatnonzero(valid & change)
    stop = np.flatnonzero(np.r_[(change | ~valid)[1:], True]) + 1
    count = stop[np.searchsorted(stop, first, side="right")] - first
    return {"start": first, "n": count, "at": anchor[first] - first, "key": grams[anchor[first]]}


def finer(symbols: np.ndarray, found: dict[str, np.ndarray], cut: Cut) -> dict[str, np.ndarray]:
    """The segments cut by steps of the minimizer's offset in the window; ``route`` hashes what all windows of a step share."""
    begin = np.cumsum(found["n"]) - found["n"]
    own = np.repeat(np.arange(len(found["n"])), found["n"])
    window = np.arange(len(own)) - begin[own]
    step = (found["at"][own] - window) // cut.step
    first = np.flatnonzero((window == 0) | np.r_[True, step[1:] != step[:-1]])
    own, window, step = own[first], window[first], step[first]
    start, at = found["start"][own] + window, found["at"][own] - window
    anchor = start + at
    shared = Rolling(symbols).ranges(anchor - step * cut.step, anchor + cut.width - (step + 1) * cut.step + 1)
    route = mixed(found["key"][own] ^ mixed(shared + step.astype(np.uint64)))
    out = {k: v[own] for k, v in found.items() if k not in ("start", "n", "at")}
    return out | {"start": start, "n": np.diff(np.r_[first, len(begin) and found["n"].sum()]), "at": at, "route": route}


def _digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of ranges of an array."""
    if not len(start):
        return np.zeros(0, np.uint64)
    k = raw.itemsize
    view = memoryview(np.ascontiguousarray(raw)).cast("B")
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip((start * k).tolist(), (end * k).tolist(), strict=True)), np.uint64, len(start))


def _texts(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple[int, int, bytes]]:
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), text_bytes(part.column(2)), strict=True)


def _raw(texts: list[bytes], cut: Cut) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint8) for t in texts] if cut.unit == "byte" else hashed_words(texts)


def _symbols(raw: np.ndarray, cut: Cut) -> np.ndarray:
    return BYTE_HASH[raw] if cut.unit == "byte" else raw


def _pieces(batch: pa.RecordBatch, cut: Cut) -> Iterator[tuple[list, list, list]]:
    """(rows, offsets of pieces in their documents, symbols): whole texts, long ones in overlapping pieces."""
    rows, offsets, parts, size = [], [], [], 0
    for block in blocks(_texts(batch), PIECE):
        for (doc, same, _), raw in zip(block, _raw([t for *_, t in block], cut), strict=True):
            for at in range(0, max(1, len(raw) - cut.width + 1), PIECE):
                part = raw[at : at + PIECE + cut.width - 1]
                rows.append((doc, same))
                offsets.append(at)
                parts.append(part)
                size += len(part)
                if size >= PIECE:
                    yield rows, offsets, parts
                    rows, offsets, parts, size = [], [], [], 0
    if rows:
        yield rows, offsets, parts


def _cut(batches: Iterator[pa.RecordBatch], cut: Cut, hot: np.ndarray, hashed: bool = True) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for rows_, offsets, parts in _pieces(batch, cut):
            sizes = np.array([len(p) for p in parts])
            raw = np.concatenate(parts)
            symbols = _symbols(raw, cut)
            ends = np.cumsum(sizes)
            room = np.repeat(ends, sizes) - np.arange(len(symbols))
            found = segments(symbols, room, cut)
            if not hashed:
                yield found
                continue
            found["route"] = found["key"]
            if len(hot) and (chosen := np.isin(found["key"], hot)).any():
                again = finer(symbols, {k: v[chosen] for k, v in found.items()}, cut)
                found = {k: np.concatenate([v[~chosen], again[k]]) for k, v in found.items()}
            found["h"] = _digests(raw, found["start"], found["start"] + found["n"] + cut.width - 1)
            piece = np.searchsorted(ends, found["start"], side="right")
            begin = ends - sizes
            doc, same = np.array(rows_, np.int64).T
            found["doc"], found["same"] = doc[piece], same[piece]
            found["start"] = found["start"] - begin[piece] + np.array(offsets, np.int64)[piece]
            yield found


def rows(docs: DataFrame, cut: Cut, hot: np.ndarray) -> DataFrame:
    """(key, finer, h, doc, same, start, n, at) of every segment of every whole text; ``finer`` is 0 but for hot keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _cut(batches, cut, hot):
            x["finer"] = x["route"] ^ x["key"]
            columns = [pa.array(x[k].view(np.int64)) for k in ("key", "finer", "h", "doc", "same")]
            columns += [pa.array(x[k].astype(np.int32)) for k in ("start", "n", "at")]
            yield pa.RecordBatch.from_arrays(columns, ["key", "finer", "h", "doc", "same", "start", "n", "at"])

    return docs.select("doc", "same", "text").mapInArrow(run, "key long, finer long, h long, doc long, same long, start int, n int, at int")


def _keys(docs: DataFrame, cut: Cut) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _cut(batches, cut, np.zeros(0, np.uint64), hashed=False):
            yield pa.RecordBatch.from_arrays([pa.array(x["key"].view(np.int64))], ["key"])

    return docs.select("doc", "same", "text").mapInArrow(run, "key long")


def candidates(docs: DataFrame, cut: Cut) -> DataFrame:
    """(route, h, doc, same, start, n, at, rows): the segments whose minimizer occurs twice or more in the corpus."""
    twice = settle(_keys(docs, cut).groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "keys")
    total = twice.agg(F.sum("times")).first()[0] or 0
    even = total // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    crowded = F.col("times") > min(HOT_MOST, max(HOT_LEAST, even))
    told = [r.key for r in twice.where(crowded).select("key").limit(HOT_TOLD + 1).collect()]
    names = ["h", "doc", "same", "start", "n", "at"]
    route = F.col("key").bitwiseXOR(F.col("finer")).alias("route")
    if len(told) <= HOT_TOLD:
        hot = np.sort(np.array(told, np.int64).view(np.uint64))
        found = rows(docs, cut, hot).join(twice.select("key"), "key", "left_semi")
        return settle(found.select(route, *names, F.lit(1).alias("rows")), "segments")
    found = rows(docs, cut, np.zeros(0, np.uint64)).join(twice.select("key", crowded.alias("hot")), "key")
    found = settle(found.select("key", *names, "hot"), "segments")
    again = settle(_again(docs, found.where("hot"), cut), "hot-segments")
    return found.where("not hot").select(F.col("key").alias("route"), *names, F.lit(1).alias("rows")).union(again)


def _again(docs: DataFrame, found: DataFrame, cut: Cut) -> DataFrame:
    """Hot segments cut finer, on the texts of the documents that have some."""
    same = found.groupBy("doc", "same", "start", "n", "at", "key").agg(F.count(F.lit(1)).cast("int").alias("rows"))
    parts = same.groupBy("doc", "same").agg(F.collect_list(F.struct("start", "n", "at", "key", "rows")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, same_, texts, counts, fields in _with_parts(batches):
            raws = _raw(texts, cut)
            sizes = np.array([len(r) for r in raws], np.int64)
            raw, row = np.concatenate([np.zeros(0, np.uint8 if cut.unit == "byte" else np.uint64), *raws]), np.repeat(np.arange(len(raws)), counts)
            hot = {k: fields[k].astype(np.int64) for k in ("start", "n", "at", "rows")} | {"key": fields["key"].view(np.uint64), "row": row}
            begin = np.cumsum(sizes) - sizes
            hot["start"] = hot["start"] + begin[row]
            x = finer(_symbols(raw, cut), hot, cut)
            x["h"] = _digests(raw, x["start"], x["start"] + x["n"] + cut.width - 1)
            x["start"] = x["start"] - begin[x["row"]]
            columns = [x["route"].view(np.int64), x["h"].view(np.int64), doc[x["row"]], same_[x["row"]], *(x[k].astype(np.int32) for k in ("start", "n", "at", "rows"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["route", "h", "doc", "same", "start", "n", "at", "rows"])

    asked = docs.join(parts, ["doc", "same"]).select("doc", "same", "text", "parts")
    return asked.mapInArrow(run, "route long, h long, doc long, same long, start int, n int, at int, rows int")


def _with_parts(batches: Iterable[pa.RecordBatch], step: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, dict[str, np.ndarray]]]:
    """doc, same and text of some rows, the sizes of their lists of structs, and the structs' fields; a row that repeats the one before is left out."""
    last = None
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            row = np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], axis=1)
            fresh = np.r_[last is None or bool((row[0] != last).any()), (row[1:] != row[:-1]).any(axis=1)]
            last = row[-1]
            part, row = part.filter(pa.array(fresh)), row[fresh]
            lists = part.column(3)
            flat = lists.flatten()
            yield row[:, 0], row[:, 1], text_bytes(part.column(2)), np.diff(lists.offsets.to_numpy()), {f.name: flat.field(f.name).to_numpy() for f in flat.type}


def shards(batches: Iterable[pa.RecordBatch], route: int, text: int) -> Iterator[pa.Table]:
    """Tables of about SHARD bytes of text that end where a route ends; the input is sorted by route."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
        held.append(batch)
        size += batch.column(text).nbytes
        if size < SHARD:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(route).to_numpy()
        if len(before := np.flatnonzero(keys != keys[-1])):
            edge = int(before[-1]) + 1
            yield table.slice(0, edge)
            held = table.slice(edge).to_batches()
            size = sum(b.column(text).nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def digest(segment: bytes) -> bytes:
    return hashlib.blake2b(segment, digest_size=16).digest()


def masks(docs: DataFrame, found: DataFrame, cut: Cut, search: Callable[[pa.Table], list[bytes]]) -> DataFrame:
    """(route, h, first_doc, first_same, first_start, mask, digest): for each different segment, bits of the windows that ``search`` reports.

    ``search`` gets a table (route, h, doc, same, start, times, n, at, seg) of whole routes, sorted by route and place,
    and returns the packed bits of each row, none where no window is reported. Segments that occur once and
    have nothing reported are left out.
    """
    first = F.min(F.struct("doc", "same", "start")).alias("first")
    distinct = found.groupBy("route", "h").agg(first, F.sum("rows").alias("times"), F.any_value("n").alias("n"), F.any_value("at").alias("at"))
    wanted = distinct.groupBy(F.col("first.doc").alias("doc"), F.col("first.same").alias("same")).agg(
        F.collect_list(F.struct("route", "h", F.col("first.start").alias("start"), "times", "n", "at")).alias("parts")
    )
    names = ["route", "h", "doc", "same", "start", "times", "n", "at", "seg"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, same, texts, counts, x in _with_parts(batches):
            out, at, ends = [], 0, (x["start"] + x["n"] + cut.width - 1).tolist()
            starts = x["start"].tolist()
            for text, c in zip(texts, counts.tolist(), strict=True):
                symbols = text if cut.unit == "byte" else text.split()
                out += [symbols[a:b] for a, b in zip(starts[at : at + c], ends[at : at + c], strict=True)]
                at += c
            out = out if cut.unit == "byte" else [b" ".join(own) for own in out]
            columns = [x["route"], x["h"], np.repeat(doc, counts), np.repeat(same, counts), x["start"], x["times"], x["n"], x["at"]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(out, pa.binary())], names)

    schema = "route long, h long, doc long, same long, start int, times long, n int, at int, seg binary"
    # with doc_id, so that the exchange of the documents is the one that ``marked`` uses
    fetched = docs.join(wanted, ["doc", "same"]).select("doc", "same", "text", "parts", "doc_id").mapInArrow(fetch, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, 0, 8):
            bits = search(table)
            matter = pa.array((table.column(5).to_numpy() > 1) | np.array([len(b) > 0 for b in bits]), pa.bool_())
            out = pa.Table.from_arrays([*table.columns[:5], pa.array(bits, pa.binary()), table.column(8)], ["route", "h", "first_doc", "first_same", "first_start", "mask", "digest"])
            out = out.filter(matter)
            own = pa.array([digest(x) for x in out.column(6).to_pylist()], pa.binary())
            yield from out.set_column(6, "digest", own).to_batches()

    sorted_in = spread(fetched, "route").sortWithinPartitions("route", "doc", "same", "start")
    return sorted_in.mapInArrow(run, "route long, h long, first_doc long, first_same long, first_start int, mask binary, digest binary")


def marks(docs: DataFrame, cut: Cut, search: Callable[[pa.Table], list[bytes]], keep_first: bool) -> DataFrame:
    """(doc, same, spans): the windows of each document that ``search`` reports, as structs of start, n, mask and digest.

    With ``keep_first`` the mask holds for a segment's first occurrence only; all windows of its later
    occurrences count, for they start earlier there. A null mask means all n windows.
    """
    found = candidates(docs, cut)
    bits = masks(docs, found, cut, search)
    joined = found.select("route", "h", "doc", "same", "start", "n").join(bits, ["route", "h"])
    if keep_first:
        own = (F.col("doc") == F.col("first_doc")) & (F.col("same") == F.col("first_same")) & (F.col("start") == F.col("first_start"))
        joined = joined.withColumn("mask", F.when(own, F.col("mask")))
    joined = joined.where("mask is null or octet_length(mask) > 0")
    return joined.groupBy("doc", "same").agg(F.collect_set(F.struct("start", "n", "mask", "digest")).alias("spans"))


def covered(size: int, width: int, spans: list[dict] | None, part: Callable[[int, int], bytes]) -> np.ndarray:
    """Which of ``size`` symbols lie in a reported window; ``part`` gives the text of a range, which must have the span's digest."""
    edge = np.zeros(size + 1, np.int32)
    for span in spans or ():
        start, n, mask = span["start"], span["n"], span["mask"]
        if digest(part(start, start + n + width - 1)) != span["digest"]:
            raise RuntimeError("two passages are equal in 128 bits of hash but not in their text")
        if mask is None:
            edge[start] += 1
            edge[start + n + width - 1] -= 1
        else:
            hit = start + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=n))
            edge[hit] += 1
            edge[hit + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, same, text): doc is the row's place in order, same tells texts of one doc_id apart. All uses share one exchange."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row_key(docs), F.col("text").cast("string").alias("text"))


def marked(docs: DataFrame, found: DataFrame, judge: Callable[[bytes, list | None], tuple], schema: str) -> DataFrame:
    """doc_id and what ``judge`` makes of every text and its spans."""
    types = [t.split()[1] for t in schema.split(", ")]
    names = [t.split()[0] for t in schema.split(", ")]
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                out = [judge(t, s) for t, s in zip(text_bytes(part.column(1)), part.column(2).to_pylist(), strict=True)]
                columns = [pa.array(c, arrow[t]) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names])

    joined = docs.join(found, ["doc", "same"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, " + schema)
