"""Line deduplication over content-defined chunks of lines; DataFrame functions only.

A polynomial rolling hash over the hashes of WINDOW lines chooses the borders: a line begins a chunk where its
hash is below those of the neighbours on both sides. So borders move with the content, not with its position, no
chunk between two of them has fewer than LEAST lines, and there is one in three lines on average. Behind MOST
lines a chunk is cut, counted from its own border. A run of RUN equal lines or more has no lesser hash;
it begins and ends a chunk by rule, whatever stands around it. Chunks of several lines that occur elsewhere in the
corpus are found by hash, the texts are compared byte by byte, and all but the first occurrence are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, row_key, settle, small

#: Lines under one rolling hash, least lines of a chunk between borders and of one that is removed, most lines, and equal lines that are a run.
WINDOW, LEAST, MOST, RUN = 2, 2, 16, 3
#: Numbers of chunks that are broadcast at most (4 bytes each, and BROADCAST_ROWS documents at most); beyond, the texts are shuffled to them.
MOST_TOLD = 1 << 22
#: The rolling hash: base and modulus; line hashes are the first 32 bits of MD5, so that any engine can repeat it.
BASE, MODULUS = 1_000_003, (1 << 31) - 1


def _moved(a: Column, by: int) -> Column:
    """The array with each element ``by`` places further on (back, if negative), null where there is none."""
    blank = F.array_repeat(F.lit(None).cast("long"), F.least(F.lit(abs(by)), F.size(a)))
    keep = F.greatest(F.size(a) - abs(by), F.lit(0))
    return F.concat(blank, F.slice(a, F.lit(1), keep)) if by > 0 else F.concat(F.slice(a, F.lit(1 + abs(by)), keep), blank)



def _adding(factor: Column) -> Callable[[Column, Column], Column]:
    return lambda r, x: F.pmod(r + F.pmod(x, F.lit(MODULUS)) * factor, F.lit(MODULUS))


def with_borders(rows: DataFrame, when: Column | None = None) -> DataFrame:
    """``rows`` with ``lines`` and ``at``: the numbers (from 0) of the lines that begin a chunk, in order; only where ``when`` holds.

    Every step is one pass over an array, whatever the number of lines.
    """
    lines = F.split("text", "\n")
    cut = rows.withColumn("lines", lines if when is None else F.when(when, lines))
    hashed = F.transform("lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))
    cut = cut.withColumn("h", hashed)
    rolled = F.transform("h", lambda x: F.pmod(x, F.lit(MODULUS)))
    for k in range(1, WINDOW):  # h[i] + BASE h[i - 1] + ... ; null where the window begins before the text
        factor = F.lit(pow(BASE, k, MODULUS))
        rolled = F.zip_with(rolled, _moved(F.col("h"), k), _adding(factor))
    cut = cut.withColumn("r", rolled)
    h, r = F.col("h"), F.col("r")
    places = F.arrays_zip(
        h, *[_moved(h, k).alias(f"h{k}") for k in range(1, RUN + 1)], *[_moved(h, -k).alias(f"n{k}") for k in range(1, RUN)],
        r, _moved(r, 1).alias("before"), _moved(r, -1).alias("after"), _moved(h, -(LEAST - 1)).alias("left"),
    )

    def begins(x: Column, i: Column) -> Column:
        low = (x["r"] < x["after"]) & (x["before"].isNull() | (x["r"] < x["before"])) & (i >= LEAST) & x["left"].isNotNull()
        run = ~x["h"].eqNullSafe(x["h1"])
        for k in range(1, RUN):
            run &= x["h"].eqNullSafe(x[f"n{k}"])
        ended = x["h"] != x["h1"]
        for k in range(2, RUN + 1):
            ended &= x["h1"] == x[f"h{k}"]
        return F.when((i == 0) | low | run | F.coalesce(ended, F.lit(False)), i)

    at = F.filter(F.transform(places, begins), lambda i: i.isNotNull())
    cut = cut.withColumn("at", at)
    # a chunk of more than MOST lines is cut behind every MOST
    parts = F.flatten(F.zip_with("at", F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("lines"))), lambda a, b: F.sequence(a, b - 1, F.lit(MOST))))
    return cut.withColumn("at", parts).drop("h", "r")


def _ends() -> Column:
    return F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("lines")))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs), F.col("text").cast("string").alias("text"))


def _parts() -> Column:
    """The chunks as structs of number, first line and line behind the last."""
    return F.transform(F.arrays_zip(F.col("at"), _ends().alias("end")), lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("kind"), x["at"].alias("a"), x["end"].alias("b")))


def _chosen(numbers: Column, inside: bool) -> Column:
    """The chunks whose numbers are among ``numbers``, or are not; found by sorting both together, so the work is n log n."""
    blank = [F.lit(0).alias(c) for c in ("kind", "a", "b")]
    both = F.array_sort(F.concat(_parts(), F.transform(numbers, lambda i: F.struct(i.alias("i"), *blank))))
    before = F.concat(F.array(F.struct(F.lit(-1).alias("i"), *blank)), F.slice(both, F.lit(1), F.size(both) - 1))

    def pick(p: Column, x: Column) -> Column:
        named = (p["i"] == x["i"]) & (p["kind"] == 0)
        return F.when((x["kind"] == 1) & (named if inside else ~named), x)

    return F.filter(F.zip_with(before, both, pick), lambda x: x.isNotNull())


def _body(x: Column) -> Column:
    return F.array_join(F.slice(F.col("lines"), x["a"] + 1, x["b"] - x["a"]), "\n")


def chunks(rows: DataFrame) -> DataFrame:
    """(doc, same, chunk, n_lines, text): consecutive chunks of every text; joined by line breaks they are the text.

    A null text has no chunk, an empty one has one chunk of one empty line.
    """
    parts = F.transform(_parts(), lambda x: F.struct((x["b"] - x["a"]).cast("long").alias("n_lines"), _body(x).alias("text")))
    cut = with_borders(rows.where("text is not null")).select("doc", "same", F.posexplode(parts).alias("chunk", "part"))
    return cut.select("doc", "same", "chunk", "part.n_lines", "part.text")


def _told(lists: DataFrame, name: str) -> DataFrame:
    """Written lists of chunk numbers by document, marked for broadcast while they are few."""
    lists = settle(lists, name)
    return small(lists) if (lists.agg(F.sum(F.size("numbers"))).first()[0] or 0) <= MOST_TOLD else lists


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """(doc, same, chunk) of the chunks of LEAST lines or more whose text occurs earlier (in a document before, or further up)."""
    hashed = chunks(rows).where(F.col("n_lines") >= LEAST).select("doc", "same", "chunk", F.xxhash64("text").alias("hash"))
    # narrow rows tell which hashes occur twice; only the chunks that have one are read again, with their texts
    hashed = settle(hashed, "chunk-hashes")
    # written, so that the join is dealt anew and a hot hash's rows can be split
    twice = settle(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("hash"), "chunks-twice")
    wanted = hashed.join(twice, "hash", "left_semi").groupBy("doc", "same").agg(F.collect_set("chunk").alias("numbers"))
    cut = with_borders(rows.where("text is not null").join(_told(wanted, "chunks-wanted"), ["doc", "same"]))
    parts = F.transform(_chosen(F.col("numbers"), True), lambda x: F.struct(x["i"].alias("chunk"), _body(x).alias("text")))
    found = settle(cut.select("doc", "same", F.explode(parts).alias("part")).select("doc", "same", "part.chunk", F.xxhash64("part.text").alias("hash"), "part.text"), "chunks")
    # the bytes decide: chunks are one only if their texts are equal
    place = F.struct("doc", "same", "chunk")
    first = found.groupBy("hash", "text").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    # written, so that both sides of the join are dealt anew and a hot chunk's rows can be split
    first = settle(first.select("hash", F.col("text").alias("body"), "first"), "first-chunks")
    later = found.join(first, (found.hash == first.hash) & (F.col("text") == F.col("body"))).where(place > F.col("first"))
    return later.select("doc", "same", "chunk")


def lines_removed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed (lines), n_chunks_removed, text (the lines left).

    Of equal chunks the first stays: the one in the smallest doc_id, furthest up. A null text stays null
    and has no line, an empty one has one; an empty table gives no rows; texts are cut whole, however long. Rows equal in doc_id and
    text are one document, each reported alike; texts that share a doc_id are documents of their own, in the order of their hashes; rows without a
    doc_id come after all others. Other columns are not read, whatever their names.
    """
    rows = _rows(docs)
    gone = _told(repeated_chunks(rows).groupBy("doc", "same").agg(F.collect_set("chunk").alias("numbers")), "chunks-gone")
    some = F.size(F.coalesce("numbers", F.array().cast("array<int>"))) > 0
    cut = with_borders(rows.join(gone, ["doc", "same"], "left"), some)
    left = F.flatten(F.transform(_chosen(F.col("numbers"), False), lambda x: F.slice(F.col("lines"), x["a"] + 1, x["b"] - x["a"])))
    kept = cut.select("doc_id", "text", F.when(some, left).alias("kept"), F.when(some, F.size("numbers")).otherwise(0).cast("long").alias("n_chunks_removed"))
    n_lines = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long")
    removed = F.when(F.col("kept").isNotNull(), n_lines - F.size("kept")).otherwise(F.lit(0)).cast("long")
    left = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text"))
    return kept.select("doc_id", n_lines.alias("n_lines"), removed.alias("n_removed"), "n_chunks_removed", left.alias("text"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines_removed(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_lines": op9_lines}
_LAGS = ", ".join(f"lag(h, {k}) OVER o AS h{k}" for k in range(1, RUN + 1))
_LEADS = ", ".join(f"lead(h, {k}) OVER o AS n{k}" for k in range(1, RUN))
_RUN = " AND ".join(f"h IS NOT DISTINCT FROM n{k}" for k in range(1, RUN))
_ENDED = " AND ".join(f"h1 = h{k}" for k in range(2, RUN + 1))
SQL = {
    "op9_lines": f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, len(ls) AS total, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
m AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l),
g AS (SELECT *, {_LAGS}, {_LEADS}, (h % {MODULUS} + (lag(h) OVER o % {MODULUS}) * {BASE}) % {MODULUS} AS r FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, lag(r) OVER o AS rb, lead(r) OVER o AS ra FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, line, i, CAST(i = 0 OR coalesce(r < ra AND (rb IS NULL OR r < rb) AND i >= {LEAST} AND i <= total - {LEAST}, false)
  OR (h IS DISTINCT FROM h1 AND {_RUN}) OR coalesce(h <> h1 AND {_ENDED}, false) AS INT) AS begins FROM n),
c AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS long_chunk FROM b),
e AS (SELECT *, long_chunk * 1000000 + (i - min(i) OVER (PARTITION BY doc_id, long_chunk)) // {MOST} AS chunk FROM c),
k AS (SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM e GROUP BY doc_id, chunk),
r AS (SELECT *, n >= {LEAST} AND row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1 AS gone FROM k),
t AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed, count(*) FILTER (gone) AS n_chunks_removed,
    string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_chunks_removed, 0) AS n_chunks_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
}
