"""Sources: folders, files and URLs as one frame of (is_url, content, source)."""

from __future__ import annotations

import json
import logging
import os
import re
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce
from typing import Any
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions.paths import filename, has_extension, is_excluded, stem
from quarry.functions.text import count_lines, sanitize_utf8
from quarry.sources.folders import FolderSource, is_local

MAX_FILE_MB = 10
Fetch = Callable[[str, Mapping[str, str], int], "str | None"]


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\Afile:/+", "/")


def read_folder(
    spark: SparkSession, path: str | list[str], recursive: bool = True, extensions: Sequence[str] = (), exclude: Sequence[str] = (), max_mb: float = MAX_FILE_MB, content: bool = True
) -> DataFrame:
    """Files of a folder, or files of a list, with length, time of change and (if asked) content.

    Length, path and extension are filtered before contents are read. 0 for ``max_mb`` lets all sizes pass.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not recursive:
        files = files.option("pathGlobFilter", "*")
    df = files.load(path)
    if max_mb:
        df = df.where(F.col("length") <= int(max_mb * 1048576))
    at = plain_path(F.col("path"))
    if extensions:
        df = df.where(has_extension(at, extensions))
    # an excluded folder takes all below it out
    parts = F.split(at, "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    if exclude:
        df = df.where(~is_excluded(at, exclude) & ~F.exists(above, lambda d: is_excluded(d, exclude)))
    body = sanitize_utf8(F.col("content")) if content else F.lit("")
    return df.select(F.lit(False).alias("is_url"), body.alias("content"), at.alias("source"), F.col("length").alias("file_size"), F.unix_timestamp("modificationTime").alias("last_modified"))


def http_fetch(url: str, headers: Mapping[str, str], timeout_ms: int) -> str | None:
    """The body of a GET over https, None unless the answer is 200."""
    if not url.startswith("https://"):
        url = "https://" + url.split("://", 1)[-1]
    try:
        with urlopen(Request(url, headers=dict(headers)), timeout=timeout_ms / 1000) as r:
            return r.read().decode(errors="replace").replace("�", "?") if r.status == 200 else None
    except OSError:
        return None


def read_urls(spark: SparkSession, specs: Sequence[Mapping[str, Any]], fetch: Fetch = http_fetch) -> DataFrame:
    """Bodies of URLs, got by the executors; those that can't be got are left out."""
    rows = [(s["url"], dict(s.get("headers", {})), int(s.get("url_timeout_ms", 10_000))) for s in specs]
    urls = spark.createDataFrame(rows, "url string, headers map<string,string>, timeout int")

    def run(batches):
        for b in batches:
            body = [fetch(u, h or {}, t) for u, h, t in zip(b.url, b.headers, b.timeout, strict=True)]
            yield pd.DataFrame({"is_url": True, "content": body, "source": b.url}).dropna(subset=["content"])

    got = urls.repartition(max(1, min(len(rows), 64))).mapInPandas(run, schemas.SOURCE)
    return got.select("*", F.octet_length("content").cast("long").alias("file_size"), F.lit(0).cast("long").alias("last_modified"))


def http_probe(url: str, headers: Mapping[str, str], timeout_ms: int) -> str | None:
    """What tells the state of a page without its body: its ETag, else its time of change; None if the server tells neither."""
    if not url.startswith("https://"):
        url = "https://" + url.split("://", 1)[-1]
    try:
        with urlopen(Request(url, headers=dict(headers), method="HEAD"), timeout=timeout_ms / 1000) as r:
            return r.headers.get("ETag") or r.headers.get("Last-Modified")
    except OSError:
        return None


def _folders(spark: SparkSession, specs: Sequence[Mapping[str, Any]], read: Callable[..., DataFrame], max_mb: float) -> list[DataFrame]:
    parts = []
    for s in specs:
        if s["type"] not in ("directory", "file"):
            continue
        how = (s.get("recursive", True), s.get("extensions", ()), s.get("exclude", ())) if s["type"] == "directory" else (False, (), ())
        try:
            parts.append(read(spark, s["path"], *how, max_mb))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            logging.getLogger(__name__).warning("%s can't be listed and is left out", s["path"])
    return parts


def collect_sources(spark: SparkSession, specs: Sequence[Mapping[str, Any]], content: bool = True, max_mb: float = MAX_FILE_MB, fetch: Fetch = http_fetch) -> DataFrame:
    """All sources of the specifications, appended as they come; a folder or file that can't be listed is told and left out."""
    parts = _folders(spark, specs, partial(read_folder, content=content), max_mb)
    urls = [s for s in specs if s["type"] == "url"]
    if urls:
        parts.append(read_urls(spark, urls, fetch))
    if not parts:
        return spark.createDataFrame([], schemas.SOURCE).withColumns({"file_size": F.lit(0).cast("long"), "last_modified": F.lit(0).cast("long")})
    return reduce(DataFrame.unionByName, parts)


LISTING = "source string, last_modified bigint, file_size bigint, validator string"


def list_folder(spark: SparkSession, path: str, recursive: bool = True, extensions: Sequence[str] = (), exclude: Sequence[str] = (), max_mb: float = MAX_FILE_MB) -> DataFrame:
    """(source, file_size, last_modified) of the files of a folder. Local folders are walked one by one, and excluded ones aren't opened; others are listed by Spark."""
    if not is_local(spark, path) or not os.path.isdir(plain := re.sub(r"\Afile:/+", "/", path)):
        return read_folder(spark, path, recursive, extensions, exclude, max_mb, False).select("source", "file_size", "last_modified")
    spark.dataSource.register(FolderSource)
    options = {"recursive": str(recursive).lower(), "extensions": json.dumps(list(extensions)), "exclude": json.dumps(list(exclude)), "most_bytes": str(int(max_mb * 1048576))}
    found = spark.read.format("quarry_folders").options(**options).load(plain)
    return found.select(F.col("path").alias("source"), F.col("length").alias("file_size"), F.col("modified").alias("last_modified"))


def list_sources(spark: SparkSession, specs: Sequence[Mapping[str, Any]], max_mb: float = MAX_FILE_MB, probe: Fetch = http_probe) -> DataFrame:
    """All sources without contents, as ``LISTING``: files by time and size, URLs by validator (null where ``probe`` gets none), which has no size."""
    nothing = F.lit(None)
    parts = [p.select("source", "last_modified", "file_size", nothing.cast("string").alias("validator")) for p in _folders(spark, specs, list_folder, max_mb)]
    rows = [(s["url"], dict(s.get("headers", {})), int(s.get("url_timeout_ms", 10_000))) for s in specs if s["type"] == "url"]
    if rows:

        def run(batches):
            for b in batches:
                yield pd.DataFrame({"source": b.url, "validator": [probe(u, h or {}, t) for u, h, t in zip(b.url, b.headers, b.timeout, strict=True)]})

        urls = spark.createDataFrame(rows, "url string, headers map<string,string>, timeout int").repartition(max(1, min(len(rows), 64)))
        told = urls.mapInPandas(run, "source string, validator string")
        parts.append(told.select("source", nothing.cast("long").alias("last_modified"), nothing.cast("long").alias("file_size"), "validator"))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], LISTING)


#: Files that are read by name; of more all are scanned, and those wanted kept.
MOST_NAMED = 10_000


def read_sources(spark: SparkSession, specs: Sequence[Mapping[str, Any]], wanted: DataFrame, max_mb: float = MAX_FILE_MB, fetch: Fetch = http_fetch) -> DataFrame:
    """The ``wanted`` sources (source) with contents. Up to MOST_NAMED are read by name and no others are opened or fetched; what isn't there any more is left out."""
    names = [r.source for r in wanted.select("source").distinct().limit(MOST_NAMED + 1).collect()]
    if len(names) > MOST_NAMED:
        return collect_sources(spark, specs, True, max_mb, fetch).join(wanted, "source", "left_semi")
    parts, asked = [], set(names)
    urls = [s for s in specs if s["type"] == "url" and s["url"] in asked]
    if urls:
        parts.append(read_urls(spark, urls, fetch))
    if files := sorted(asked - {s["url"] for s in urls}):
        literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files]  # a name is no pattern
        try:
            parts.append(read_folder(spark, literal, False, max_mb=max_mb))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise  # a file has gone meanwhile
            parts += [p.join(wanted, "source", "left_semi").select(*p.columns) for p in _folders(spark, specs, read_folder, max_mb)]
    if not parts:
        return collect_sources(spark, [])
    return reduce(DataFrame.unionByName, parts)


def fetch_source(sources: DataFrame, uri: str) -> DataFrame:
    """One source by its URL or path."""
    return sources.where(F.col("source") == uri).limit(1)


def distinct_sources(sources: DataFrame) -> DataFrame:
    return sources.select("source").distinct()


def file_rows(sources: DataFrame, *more: str) -> DataFrame:
    """Rows of the table of tracked files."""
    return sources.select(F.col("source").alias("path"), "last_modified", "file_size", count_lines(F.col("content")).alias("nof_lines"), F.current_timestamp().alias("indexed_at"), *more)


#: Characters of the pieces of a stem by which related sources are joined.
GRAM = 4


def _pieces(text: Column, sizes: Sequence[int]) -> Column:
    """The different pieces of a text that have one of ``sizes``."""

    def cut(n: int) -> Column:  # transform gives a function of two parameters the index as well
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*[cut(n) for n in sizes])))


def related_sources(sources: DataFrame, base: DataFrame, most: int) -> DataFrame:
    """(base, source, place): for each base path up to ``most`` other sources, in input order (pos), whose stem holds the base's.

    ``base`` is a stated list of paths (base), ``sources`` all paths (source, pos). Whoever holds a stem holds each piece of it: a base is joined
    by the piece of its stem (GRAM characters, or the whole where it is shorter) that the fewest sources have, and the whole stem is compared then. An
    empty stem is held by all, so its related sources are the first ones.
    """
    asked = base.select("base", stem(F.col("base")).alias("wanted")).distinct()
    size = F.least(F.length("wanted"), F.lit(GRAM))
    sizes = [r.n for r in asked.select(size.alias("n")).distinct().collect() if r.n]
    first = sources.select("pos", "source").orderBy("pos").limit(most + 1)
    found = asked.where("wanted = ''").join(F.broadcast(first)).select("base", "source", "pos")
    if sizes:
        # of each length, only pieces that a base has are counted
        keys = asked.where("wanted <> ''").withColumn("piece", F.explode(reduce(lambda c, n: F.when(size == n, _pieces(F.col("wanted"), [n])).otherwise(c), sizes, F.array().cast("array<string>"))))
        cut = sources.select("source", "pos", stem(F.col("source")).alias("own")).withColumn("piece", F.explode(_pieces(F.col("own"), sizes)))
        held = cut.join(keys.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
        rarest = keys.join(held, "piece", "left").groupBy("base", "wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("key"))
        found = found.union(cut.join(rarest.select("base", "wanted", "key.piece"), "piece").where(F.contains("own", F.col("wanted"))).select("base", "source", "pos"))
    by = Window.partitionBy("base").orderBy("pos")
    placed = found.where(F.col("base") != F.col("source")).withColumn("place", F.row_number().over(by).cast("long"))
    return placed.where(F.col("place") <= most).select("base", "source", "place")


def attachments(sources: DataFrame) -> DataFrame:
    """(filename, content) of sources as a message carries them: the name without folders, the whole text."""
    return sources.select(filename(F.col("source")).alias("filename"), F.coalesce("content", F.lit("")).alias("content"))


def read_attachments(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(filename, content) of a few files, in the order given; one that can't be read fails all."""
    rows = reduce(DataFrame.union, [read_folder(spark, f, False, max_mb=0).select(F.lit(i).alias("place"), "source", "content") for i, f in enumerate(files)])
    return attachments(rows.orderBy("place"))


def project_list(spark: SparkSession, folder: str, refs: Sequence[str] = ()) -> DataFrame:
    """(path, document) of readable JSON projects in a folder and in a list of references."""
    read = lambda p, **o: spark.read.options(wholetext="true", **o).text(p).select(F.input_file_name().alias("path"), F.col("value").alias("document"))
    df = read(folder, pathGlobFilter="*.json")
    for r in refs:
        df = df.unionByName(read(r))
    return df.where(F.try_parse_json("document").isNotNull() & F.rlike("document", F.lit(r"\A\s*\{")))


def shared_folders_removed(rows: DataFrame, group: str, path: str = "path") -> DataFrame:
    """``rows`` with ``short``: the path without the leading folders that all of its group share.

    What all share is what the least and the greatest share, so a group is never gathered; one segment stays.
    """
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    ends = rows.groupBy(group).agg(F.min(parts).alias("_low"), F.max(parts).alias("_high"), F.min(F.size(parts)).alias("_least"))
    differs = F.filter(F.sequence(F.lit(1), F.col("_least")), lambda i: F.element_at("_low", i) != F.element_at("_high", i))
    shared = F.coalesce(F.array_min(differs) - 1, F.col("_least"))
    cut = F.when(shared == F.col("_least"), shared - 1).otherwise(shared)
    short = F.when(cut > 0, F.array_join(F.slice(parts, cut + 1, F.size(parts)), "/")).otherwise(F.col(path))
    return rows.join(ends, group).withColumn("short", short).drop("_low", "_high", "_least")


def last_entries(log: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The last ``n`` entries of a log."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)
