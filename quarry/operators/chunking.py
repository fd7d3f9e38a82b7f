"""Token-bounded overlapping chunks. Sequential by nature, so Arrow batches of documents run through numpy.

Offsets and lengths are bytes. Windows over prefix sums: the end of a chunk and the start of the next are
binary searches, so a document costs one pass over its units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.content_type import content_type
from quarry.functions.text import normalize_whitespace
from quarry.functions.tokens import count_bytes, unit_bytes, unit_counts


@dataclass(frozen=True)
class Limits:
    """Tokens of a chunk, and the share that neighbours have in common."""

    least: int = 50
    most: int = 450
    overlap: float = 0.1

    @property
    def shared(self) -> int:
        # the product is taken in single precision
        return int(np.float32(self.most) * np.float32(self.overlap))


@dataclass
class Piece:
    text: bytes
    tokens: int
    start: int
    end: int
    unit: str
    number: int = 0


Counter = Callable[[bytes], int]


def _sums(values: list[int]) -> np.ndarray:
    return np.r_[0, np.cumsum(np.array(values, np.int64))] if values else np.zeros(1, np.int64)


def text_windows(text: bytes, limits: Limits, count: Counter = count_bytes) -> list[Piece]:
    """Chunks of normalised prose over words, marks and blanks; offsets are bytes of the normalised text.

    The overlap takes in the unit that crosses it, and is at most 0.6 of a chunk. A unit of more tokens than
    a chunk may have is a chunk by itself.
    """
    units = unit_bytes(text)
    counts = unit_counts(units, text) if count is count_bytes else [count(u) for u in units]
    tokens, at = _sums(counts), _sums([len(u) for u in units])
    shared = min(limits.shared, int(0.6 * limits.most))
    out, start = [], 0
    while start < len(units):
        end = int(np.searchsorted(tokens, tokens[start] + limits.most, side="right")) - 1
        end = max(end, start + 1)
        out.append(Piece(text[at[start] : at[end]], int(tokens[end] - tokens[start]), int(at[start]), int(at[end]), "char"))
        if end == len(units):
            break
        back = int(np.searchsorted(tokens, tokens[end] - shared, side="right")) - 1 if shared else end
        # progress even where the overlap covers the chunk
        start = max(start + 1, min(back, end))
    return out


def break_line(line: bytes, most: int, count: Counter = count_bytes) -> list[bytes]:
    """A line with its break; a line of too many tokens in greedy pieces, each with a break."""
    ended = lambda b: b if b.endswith(b"\n") else b + b"\n"
    if count(line) <= most:
        return [ended(line)]
    out, held, n = [], b"", 0
    for unit in unit_bytes(line):
        k = count(unit)
        if held and n + k > most:
            out.append(ended(held))
            held, n = b"", 0
        held, n = held + unit, n + k
    return [*out, ended(held)] if held else out


def line_windows(text: bytes, limits: Limits, count: Counter = count_bytes) -> list[Piece]:
    """Chunks of code over lines; offsets are numbers of (broken) lines, the end exclusive.

    The overlap leaves out the line that would cross it, and never takes a whole chunk.
    """
    rows = text.split(b"\n")
    if rows[-1] == b"":
        rows.pop()
    lines = [piece for row in rows for piece in break_line(row, limits.most, count)]
    tokens = _sums([count(x) for x in lines])
    out, start = [], 0
    while start < len(lines):
        end = max(int(np.searchsorted(tokens, tokens[start] + limits.most, side="right")) - 1, start + 1)
        out.append(Piece(b"".join(lines[start:end]), int(tokens[end] - tokens[start]), start, end, "line"))
        if end == len(lines):
            break
        # lines from the end whose sum stays below the overlap
        back = int(np.searchsorted(tokens, tokens[end] - limits.shared, side="right"))
        start = max(start + 1, min(back, end))
    return out


def merge_small(pieces: list[Piece], limits: Limits, count: Counter = count_bytes) -> list[Piece]:
    """A chunk of too few tokens takes in the next one if both fit; at most one merge each, numbers keep gaps."""
    out, i = [], 0
    for k, p in enumerate(pieces):
        p.number = k
    while i < len(pieces):
        p = pieces[i]
        i += 1
        if p.tokens < limits.least and i < len(pieces):
            joined = p.text + pieces[i].text
            n = count(joined)
            if n <= limits.most:
                p = Piece(joined, n, p.start, pieces[i].end, p.unit, p.number)
                i += 1
        out.append(p)
    return out


def chunk(text: bytes, kind: str, limits: Limits, count: Counter = count_bytes) -> list[Piece]:
    """Chunks of (for prose: normalised) text of a kind; none of binary."""
    if kind == "binary":
        return []
    return merge_small((line_windows if kind == "code" else text_windows)(text, limits, count), limits, count)


def chunk_documents(docs: DataFrame, limits: Limits = Limits(), semantic: bool = True, counter: Counter = count_bytes) -> DataFrame:
    """(doc_uri, chunk_id, text, metadata) of documents (source, content).

    The kind is told natively; with ``semantic`` off all is prose but binary. No shuffle: documents are
    chunked where they lie. Null contents have no chunk.
    """
    kind = content_type(F.col("content"), F.col("source"))
    if not semantic:
        kind = F.when(kind == "binary", kind).otherwise("text")
    ready = docs.where("content is not null").select("source", "content", kind.alias("kind"))
    ready = ready.withColumn("content", F.when(F.col("kind") == "text", normalize_whitespace(F.col("content"))).otherwise(F.col("content")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta = pa.struct([("token_count", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("unit", pa.string()), ("type", pa.string())])
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                uris, ids, texts, metas = [], [], [], []
                for uri, text, k in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for p in chunk(text, k, limits, counter):
                        uris.append(uri)
                        ids.append(f"{uri}_{p.number}")
                        texts.append(p.text.decode(errors="replace"))
                        metas.append({"token_count": p.tokens, "start": p.start, "end": p.end, "unit": p.unit, "type": k})
                yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(metas, meta)], ["doc_uri", "chunk_id", "text", "metadata"])

    schema = "doc_uri string, chunk_id string, text string, metadata struct<token_count:bigint, start:bigint, end:bigint, unit:string, type:string>"
    return ready.mapInArrow(run, schema)
