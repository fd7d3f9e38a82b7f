"""The store: chunks, tracked files and vectors, changed in commits that count as one.

A commit writes the rows that it adds and the paths whose older rows go, then one line that names its
folder; readers see all of it or nothing, rows and vectors alike. So a change costs what it changes.
Reading takes the commits since the last compaction and leaves out what later commits removed. A row's
commit is told by its folder. Several commits can be published as one (``transaction``).

Writers see each other. The line's file is named by the commit's number and never overwritten; before it is written, the writer looks at
what came in since the commits that it has read: where a path was touched by both, its commit fails (``Conflict``; updates begin anew), else it
goes behind them. A row's id is the commit's first id, which the line states, plus a number of its own, so writers never
share ids. A compaction stands where the commits stood that it was made of, whatever came in meanwhile. With each commit goes what
it adds to the statistics of each path.

An index (``index``) is a codebook, fitted on a sample of the vectors, and the codes of all of them (``pq``). The compaction that makes it names
the codebook; later commits code their vectors by it. A search looks through the codes and reads the vectors of the best candidates, and those
of commits without codes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.scratch import scratch
from quarry.operators import changes, pq, stats, vectors
from quarry.operators.chunking import Limits, chunk_documents
from quarry.operators.numbering import numbered
from quarry.operators.prompts import labelled
from quarry.functions.paths import filename
from quarry.sources.scan import file_rows

TABLES = {
    "chunks": schemas.CHUNKS, "files": schemas.FILES + ", validator string", "vectors": schemas.VECTORS + ", source_id string",
    "counts": "path string, chunks bigint, tokens bigint, vectors bigint", "codes": "id bigint, code binary, source_id string",
}
#: The column that a table's rows are removed by.
KEYS = {"chunks": "source_id", "files": "path", "vectors": "source_id", "counts": "path", "codes": "source_id"}
#: Tables that a commit makes of its others.
DERIVED = ("counts", "codes")
LINE = "number long, folder string, base boolean, after long, first long, top long, book string"
Encoder = Callable[[Column], Column]
Reader = Callable[[DataFrame], DataFrame]
#: Failures in a row after which a source is left alone, as long as the store object lives.
STRIKES = 3
FAILURES = "path string, ts bigint, ok boolean"
#: Times that an update is begun, and seconds that a number without a line is waited for.
ATTEMPTS, WAIT_S = 5, 10
#: Commits since the last compaction after which an update compacts.
MOST_COMMITS = 64


class Conflict(RuntimeError):
    """Another writer has touched the same paths since this one read the store."""


@dataclass(frozen=True)
class Commit:
    """A line of the log, or one to come. Ids of its rows count from ``first`` where they are ``relative``; ``most`` is the highest of them."""

    folder: str
    base: bool = False
    compacts: bool = False
    relative: bool = False
    most: int = 0
    number: int = 0
    after: int = 0
    first: int = 0
    top: int | None = 0
    #: The codebook of its codes.
    book: str | None = None


class Store:
    """Chunks with vectors of dimension ``dim`` under ``path`` (any file system that Spark reaches)."""

    def __init__(self, spark: SparkSession, path: str, encoder: Encoder, dim: int, metric: str = "cosine", limits: Limits = Limits()):
        self.spark, self.path, self.encoder, self.dim, self.metric, self.limits = spark, path.rstrip("/"), encoder, dim, metric, limits
        self.since = time.time_ns()
        self._pending: list[Commit] | None = None
        self._opened = 0
        self._books: dict[str, np.ndarray] = {}

    def _log(self) -> list[Commit]:
        """All published commits in order; only files of a few lines are read. Lines that an older version wrote have no ids of their own."""
        try:
            lines = self.spark.read.schema(LINE).json(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        made = [Commit(r.folder, bool(r.base), number=r.number, after=r.number - 1 if r.after is None else r.after, first=r.first or 0, top=r.top, book=r.book) for r in lines]
        return sorted(made, key=lambda c: c.number)

    def _numbered(self, made: list[Commit], log: list[Commit], snapshot: int) -> list[Commit]:
        """``made`` as they would be published behind ``log``."""
        number, top, out = max((c.number for c in log), default=0), self._top(log), []
        for c in made:
            number, first = number + 1, top if c.relative else 0
            top = max(top, first + c.most)
            out.append(replace(c, number=number, after=snapshot if c.compacts else number - 1, first=first, top=top))
        return out

    def _top(self, log: list[Commit]) -> int:
        """The highest id given out so far."""
        if any(c.top is None for c in log):
            return max([c.top or 0 for c in log] + [self._live("chunks", _visible(log)).agg(F.max("id")).first()[0] or 0])
        return max((c.top for c in log), default=0)

    def _snapshot(self) -> int:
        return self._opened if self._pending is not None else max((c.number for c in self._log()), default=0)

    def _touched(self, folders: list[str]) -> DataFrame:
        read = lambda n: self.spark.read.schema("path string").parquet(*[f"{self.path}/{f}/{n}" for f in folders])
        return read("gone").union(read("files")).union(read("counts")).distinct()

    def _publish(self, made: list[Commit], snapshot: int) -> bool:
        """Write the lines of new commits in one file whose name holds the first number, behind what came in since ``snapshot``. False if a compaction comes too late."""
        checked = snapshot
        while True:
            log = self._log()
            later = [c for c in log if c.number > checked]
            if any(c.base for c in later) and any(c.compacts for c in made):
                return False
            # a compaction changes no path
            if later and not all(c.compacts for c in made):
                cleared = any(c.base and c.after == c.number - 1 for c in later)
                others = [c.folder for c in later if not c.base]
                if cleared or others and self._touched([c.folder for c in made]).join(self._touched(others), "path", "left_semi").take(1):
                    raise Conflict("a path was changed by another writer")
            lines = self._numbered(made, log, snapshot)
            if self._write_lines(lines):
                return True
            checked = max([checked, *(c.number for c in log)])

    def _write_lines(self, lines: list[Commit]) -> bool:
        """False if the number is taken. A number whose writer has died before its line was written is freed after WAIT_S."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{lines[0].number:012d}.json")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at.getParent())
        keys = [f.split()[0] for f in LINE.split(", ")]
        text = "".join(json.dumps({k: getattr(c, k) for k in keys}) + "\n" for c in lines).encode()
        try:
            _write_new(fs, at, text)
        except (FileExistsError, Py4JJavaError) as e:
            if isinstance(e, Py4JJavaError) and not fs.exists(at):
                raise
            until = time.time() + WAIT_S
            while fs.exists(at) and not fs.getFileStatus(at).getLen():
                if time.time() > until:
                    fs.delete(at, False)
                time.sleep(0.05)
            return False
        # a writer that was taken for dead may find another's line
        return any(c.folder == lines[0].folder for c in self._log())

    @contextmanager
    def transaction(self) -> Iterator[Store]:
        """All commits inside count together, at the end; an error inside, or a path that another writer touched meanwhile, leaves the store as it was. Reads inside see them already."""
        if self._pending is not None:
            raise RuntimeError("a transaction is open")
        snapshot = self._opened = self._snapshot()
        self._pending = []
        try:
            yield self
            made = self._pending
        finally:
            self._pending = None
        if made:
            self._publish(made, snapshot)

    def _commits(self) -> list[Commit]:
        """The commits that readers take, with those of an open transaction."""
        log = self._log()
        return _visible(log + self._numbered(self._pending or [], log, self._opened))

    def table(self, name: str) -> DataFrame:
        """The live rows of a table."""
        return self._live(name, self._commits())

    def _live(self, name: str, commits: list[Commit], among: list[Commit] | None = None) -> DataFrame:
        """The rows of a table that ``commits`` leave, of all of them or only of those that ``among`` them made."""
        among = commits if among is None else among
        if not among:
            return self.spark.createDataFrame([], TABLES[name])
        about = F.create_map(*[F.lit(x) for c in commits for x in (c.folder, F.struct(F.lit(c.after if c.base else c.number).alias("number"), F.lit(c.first).alias("first")))])
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(data-[0-9a-f]{32})/[^/]+/[^/]+\z", 1)
        read = lambda n, s, own: self.spark.read.schema(s).parquet(*[f"{self.path}/{c.folder}/{n}" for c in own]).withColumn("commit", F.element_at(about, folder))
        gone = read("gone", "path string", commits).groupBy("path").agg(F.max("commit.number").alias("gone_at"))
        rows, key = read(name, TABLES[name], among), KEYS[name]
        if "id" in rows.columns:
            rows = rows.withColumn("id", F.col("id") + F.col("commit.first"))
        live = rows.join(gone, rows[key] == gone["path"], "left").where(F.col("gone_at").isNull() | (F.col("commit.number") >= F.col("gone_at")))
        return live.select(*[rows[c] for c in schemas.names(TABLES[name])])

    def commit(self, gone: DataFrame | None = None, base: bool = False, snapshot: int | None = None, relative: bool = False, book: str | None = None, **tables: DataFrame) -> bool:
        """Add rows and remove the older rows of the paths in ``gone``; with ``base`` nothing older counts. False if a compaction comes too late.

        ``snapshot`` is the number of the last commit that the rows were made from (by default what is there now); with tables a ``base`` replaces
        what was there then. Ids that are ``relative`` count from the highest id given out. Vectors are coded by ``book``, by default the store's.
        """
        snapshot = self._snapshot() if snapshot is None else snapshot
        folder = f"data-{uuid.uuid4().hex}"
        compacts = base and bool(tables)
        tables["gone"] = self.spark.createDataFrame([], "path string") if gone is None else gone.select("path").distinct()
        for name, schema in (TABLES | {"gone": "path string"}).items():
            if name in DERIVED:
                continue
            df = tables.get(name)
            df = self.spark.createDataFrame([], schema) if df is None else df.select(*[c if c in df.columns else F.lit(None).cast("string").alias(c) for c in schemas.names(schema)])
            df.write.parquet(f"{self.path}/{folder}/{name}")
        most = self._count(folder)
        book = (book or _book(self._commits())) if "vectors" in tables else None
        if book:
            written = self.spark.read.schema(TABLES["vectors"]).parquet(f"{self.path}/{folder}/vectors")
            pq.coded(written, self._codebook(book), "source_id").write.parquet(f"{self.path}/{folder}/codes")
        made = Commit(folder, base, compacts, relative, most, book=book)
        if self._pending is None:
            return self._publish([made], snapshot)
        self._pending.append(made)
        return True

    def _count(self, folder: str) -> int:
        """Write down what the commit adds to the statistics of each path; returns its highest id."""
        written = lambda n: self.spark.read.schema(TABLES[n]).parquet(f"{self.path}/{folder}/{n}")
        chunks = written("chunks")
        zero = F.lit(0).cast("long")
        parts = chunks.select(F.col("source_id").alias("path"), F.lit(1).alias("chunks"), F.col("token_count").alias("tokens"), zero.alias("vectors"))
        parts = parts.union(written("vectors").select(F.col("source_id"), zero, zero, F.lit(1)))
        parts.groupBy("path").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("chunks", "tokens", "vectors")]).write.parquet(f"{self.path}/{folder}/counts")
        return chunks.agg(F.max("id")).first()[0] or 0

    def _embedded(self, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Chunks, numbered from 1, and their vectors."""
        place = F.regexp_extract("chunk_id", r"_(\d+)\z", 1).cast("int")
        made = chunk_documents(sources.select("source", "content"), self.limits).withColumn("place", place)
        # ids follow (source, place); the chunks are written once on the way
        rows = numbered(made, "doc_uri", "place").withColumn("id", F.col("row") + 1)
        m = F.col("metadata")
        rows = rows.select(
            "id", F.col("text").alias("content"), F.col("doc_uri").alias("source_id"), m["unit"].alias("unit"), m["type"].alias("type"), m["start"].alias("start_pos"),
            m["end"].alias("end_pos"), m["token_count"].alias("token_count"), F.current_timestamp().alias("created_at"),
        )
        vec = rows.select("id", self.encoder(labelled(F.col("content"), filename(F.col("source_id")))).alias("embedding"), "source_id")
        return rows, vec

    def embed(self, sources: DataFrame, read: Reader | None = None) -> dict[str, int]:
        """Add all sources that aren't tracked yet, as ``update`` does; returns how many were new, tracked already or failed.

        A source that gets no vectors is left out, the others go on. If none gets any, the first error is raised.
        """
        found = self._repeated(sources, read, None, ("new",))
        return {"new": found.get("new", 0), "tracked": sum(n for kind, n in found.items() if kind in ("unchanged", "modified")), "failed": found.get("failed", 0)}

    def failures(self) -> DataFrame:
        """(path, ts, ok): the log of sources that failed in an update, and of their first success after."""
        try:
            return self.spark.read.schema(FAILURES).parquet(f"{self.path}/failures")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], FAILURES)

    def _log_failures(self, bad: DataFrame, good: DataFrame, log: DataFrame) -> None:
        """Add failures, and the successes of sources whose last entry is a failure."""
        last = log.groupBy("path").agg(F.max_by("ok", "ts").alias("ok")).where(~F.col("ok"))
        ts = F.lit(time.time_ns())
        rows = bad.select("path", ts.alias("ts"), F.lit(False).alias("ok")).union(good.join(last, "path", "left_semi").select("path", ts, F.lit(True)))
        rows.write.mode("append").parquet(f"{self.path}/failures")

    def update(self, sources: DataFrame, ignored: DataFrame | None = None, read: Reader | None = None) -> dict[str, int]:
        """Bring the store to the state of ``sources`` in one step; returns what changed, and how many sources failed.

        ``sources`` is read for source, last_modified and file_size (and, if there, validator) only; contents are read of what is new or
        modified: by ``read``, which gets their names (source) and returns the rows with content, by default from ``sources``. A row without a file_size
        is told by its validator (an ETag); where it has none, or another, it is read, and counts as unchanged if the content's hash is.
        A source that isn't there any more when it is read counts as deleted. Nothing is written if nothing has changed.

        A source fails if one of its chunks gets no vector (null) or one of another dimension; it stays as it was, the others go on. After
        STRIKES failures without a success in between it is ignored, as are the paths in ``ignored``. An update in whose paths another writer was faster begins anew.
        """
        return self._repeated(sources, read, ignored, ("new", "modified", "deleted"))

    def _repeated(self, *how: Any) -> dict[str, int]:
        for left in reversed(range(ATTEMPTS)):
            try:
                found = self._brought(*how)
                break
            except Conflict:
                if not left or self._pending is not None:
                    raise
        if self._pending is None and len(self._commits()) > MOST_COMMITS:
            self.compact()
        return found

    def _listed(self, sources: DataFrame) -> DataFrame:
        """(path, last_modified, file_size, validator): what is told by an equal validator has the tracked time and size, other such rows none that was tracked."""
        validator = F.col("validator") if "validator" in sources.columns else F.lit(None).cast("string")
        rows = sources.select(F.col("source").alias("path"), "last_modified", "file_size", validator.alias("validator"))
        there = self.table("files").select("path", *[F.col(c).alias(f"then_{c}") for c in ("last_modified", "file_size", "validator")])
        told = rows.where("file_size is null").join(there, "path", "left")
        same = F.coalesce(F.col("validator") == F.col("then_validator"), F.lit(False))
        time_, size = (F.when(same, F.col(f"then_{c}")).otherwise(F.lit(-1)).alias(c) for c in ("last_modified", "file_size"))
        return rows.where("file_size is not null").union(told.select("path", time_, size, "validator"))

    def _brought(self, sources: DataFrame, read: Reader | None, ignored: DataFrame | None, kinds: tuple[str, ...]) -> dict[str, int]:
        snapshot, log = self._snapshot(), self.failures()
        struck = changes.failures(log.where(F.col("ts") >= self.since), STRIKES).select("path")
        ignored = struck if ignored is None else struck.union(ignored.select("path")).distinct()
        listed = self._listed(sources).cache()
        found = changes.detect_changes(listed, self.table("files"), ignored).cache()
        summary = {r.change_type: r.n for r in changes.change_summary(found).collect()}
        if set(summary) & set(kinds):
            wanted = found.where(F.col("change_type").isin([k for k in kinds if k != "deleted"])).select(F.col("path").alias("source"))
            read = read or (lambda names: sources.join(names, "source", "left_semi"))
            # read once: what is cut and tracked is the same content
            path = scratch(self.spark, "sources")
            validators = listed.select(F.col("path").alias("source"), F.col("validator").alias("told"), F.col("file_size").alias("listed_size")).dropDuplicates(["source"])
            hashed = F.when(F.col("listed_size") == -1, F.coalesce("told", F.concat(F.lit("sha256:"), F.sha2(F.col("content"), 256))))
            got = read(wanted).dropDuplicates(["source"]).drop("validator").join(validators, "source")
            got.withColumn("validator", hashed).select("source", "content", "last_modified", "file_size", "validator").write.parquet(path)
            fresh = self.spark.read.parquet(path)
            # without a validator of its own, a source is told by its content
            hashes = self.table("files").where("validator like 'sha256:%'").select(F.col("path").alias("source"), "validator")
            same = fresh.join(hashes, ["source", "validator"], "left_semi").select("source").cache()
            vanished = wanted.join(fresh, "source", "left_anti").cache()
            for n, kind in ((same.count(), "unchanged"), (vanished.count(), "deleted")):
                if n:
                    lost = (same if kind == "unchanged" else vanished).join(found, F.col("source") == F.col("path")).groupBy("change_type").count().collect()
                    for r in lost:
                        summary[r.change_type] -= r["count"]
                        if kind == "unchanged" or r.change_type == "modified":
                            summary[kind] = summary.get(kind, 0) + r["count"]
            summary = {k: n for k, n in summary.items() if n}
            fresh = fresh.join(same, "source", "left_anti")
            if set(summary) & set(kinds):
                self._exchange(found, fresh, same, summary, kinds, log, snapshot)
            same.unpersist()
            vanished.unpersist()
        found.unpersist()
        listed.unpersist()
        return summary

    def _exchange(self, found: DataFrame, fresh: DataFrame, same: DataFrame, summary: dict[str, int], kinds: tuple[str, ...], log: DataFrame, snapshot: int) -> None:
        """Commit the rows of ``fresh`` in place of what is modified or deleted."""
        gone = found.where(F.col("change_type").isin([k for k in kinds if k != "new"])).select("path").join(same, F.col("path") == F.col("source"), "left_anti")
        rows, vec = self._embedded(fresh)
        made = scratch(self.spark, "vectors")
        vec.write.parquet(made)
        vec = self.spark.read.schema(vec.schema).parquet(made)
        bad = vec.where(F.coalesce(F.size("embedding"), F.lit(-1)) != self.dim).select(F.col("source_id").alias("path")).distinct().cache()
        n = bad.count()
        if n:
            if kinds == ("new",) and n == summary["new"]:
                vectors.checked(vec, self.dim).collect()
            summary["failed"] = n
            rows, vec = (x.join(bad, x.source_id == bad.path, "left_anti") for x in (rows, vec))
            gone = gone.join(bad, "path", "left_anti")
            fresh = fresh.join(bad, fresh.source == bad.path, "left_anti")
        files = file_rows(fresh, "validator")
        self.commit(gone, snapshot=snapshot, relative=True, chunks=rows, vectors=vec, files=files)
        if n or log.take(1):
            self._log_failures(bad, fresh.select(F.col("source").alias("path")), log)
        bad.unpersist()

    def delete_source(self, source_id: str) -> int:
        """Remove a source with its chunks and vectors; returns the number of chunks."""
        n = self.table("chunks").where(F.col("source_id") == source_id).count()
        self.commit(self.spark.createDataFrame([(source_id,)], "path string"))
        return n

    def clear(self) -> None:
        self.commit(base=True)

    def compact(self, book: str | None = None) -> bool:
        """Rewrite the live rows, chunks and vectors ordered by source, and code the vectors anew; older commits don't count any more. False if another compaction was faster."""
        if self._pending is not None:
            raise RuntimeError("a transaction is open")
        snapshot = self._snapshot()
        chunks, vecs = (self.table(n).repartitionByRange("source_id") for n in ("chunks", "vectors"))
        return self.commit(base=True, snapshot=snapshot, book=book, chunks=chunks, vectors=vecs.sortWithinPartitions("id"), files=self.table("files"))

    def index(self, sample: int = pq.SAMPLE) -> bool:
        """Fit a codebook on a sample of the vectors and code all of them, in a compaction. False if another compaction was faster."""
        name = f"book-{uuid.uuid4().hex}"
        pq.save(self.spark, pq.fit(self.table("vectors"), sample), f"{self.path}/{name}")
        return self.compact(name)

    def _codebook(self, name: str) -> np.ndarray:
        if name not in self._books:
            self._books = {name: pq.load(self.spark, f"{self.path}/{name}")}
        return self._books[name]

    def _near(self, query: Sequence[float], k: int, metric: str) -> DataFrame:
        """(id, embedding) of the best candidates by their codes, and of all vectors without codes."""
        commits = self._commits()
        book = _book(commits)
        codes = self._live("codes", commits, [c for c in commits if c.book == book])
        best = pq.candidates(codes, self._codebook(book), [(0, list(query))], pq.CANDIDATES * k, metric)
        ids = [r.id for r in best.select("id").collect()]
        rows = self._live("vectors", commits, [c for c in commits if c.book != book]).select("id", "embedding")
        for c in commits:
            own = [i - c.first for i in ids if c.base or c.first < i <= (c.top or 0)] if c.book == book else []
            if own:  # the ids as they are written, so that the filter reaches the scan
                part = self.spark.read.schema(TABLES["vectors"]).parquet(f"{self.path}/{c.folder}/vectors").where(F.col("id").isin(own))
                rows = rows.union(part.select((F.col("id") + c.first).alias("id"), "embedding"))
        return rows

    def search(self, query: Sequence[float], k: int = 10, exact: bool = False) -> DataFrame:
        """The k best chunks, best first; hits whose chunk is gone are dropped. With an index only candidates are scored, unless ``exact``."""
        indexed = not exact and _book(self._commits())
        rows = self._near(query, k, self.metric) if indexed else self.table("vectors")
        top = vectors.knn(rows, [(0, list(query))], k, self.metric)
        c = F.col
        return vectors.with_chunks(top, self.table("chunks")).orderBy(F.desc("similarity"), "id").select(
            "content", "source_id", c("unit").alias("chunk_unit"), c("type").alias("chunk_type"), c("id").alias("chunk_id"), c("start_pos").alias("start"), c("end_pos").alias("end"),
            c("similarity").cast("float").alias("similarity_score"), c("distance").cast("float").alias("distance"),
        )

    def search_with_filter(self, query: Sequence[float], source: str = "", kind: str = "", k: int = 10) -> DataFrame:
        rows = self.table("vectors").join(self.table("chunks").select("id", "type"), "id")
        return vectors.search_with_filter(rows, list(query), k, source, kind, self.metric)

    def chunk(self, chunk_id: int) -> DataFrame:
        return self.table("chunks").where(F.col("id") == chunk_id).select("content", "source_id", "unit", "type", "start_pos", "end_pos")

    def chunk_ids(self, source_id: str) -> DataFrame:
        return self.table("chunks").where(F.col("source_id") == source_id).select("id")

    def vector(self, chunk_id: int) -> list[float]:
        return vectors.vector_of(self.table("vectors"), chunk_id)

    def tracked(self) -> DataFrame:
        return self.table("files").select("path", "last_modified", "file_size", "nof_lines")

    def is_tracked(self, path: str) -> bool:
        return not self.table("files").where(F.col("path") == path).isEmpty()

    def _counts(self) -> DataFrame | None:
        """Statistics by path from those of the commits; None where a commit of an older version has none."""
        commits = self._commits()
        return None if any(c.top is None for c in commits) else self._live("counts", commits).groupBy("path").agg(*[F.sum(c).alias(c) for c in ("chunks", "tokens", "vectors")])

    def chunk_counts(self) -> DataFrame:
        """(source_id, chunks), without reading chunks."""
        counts = self._counts()
        return stats.chunk_counts(self.table("chunks")) if counts is None else counts.where("chunks > 0").select(F.col("path").alias("source_id"), "chunks")

    def stats(self) -> DataFrame:
        """One row: chunks, sources, tokens; vectors, those deleted and those active. Chunks aren't read."""
        counts = self._counts()
        if counts is None:
            return stats.store_stats(self.table("chunks"), self.table("vectors").withColumn("is_deleted", F.lit(False)))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        deleted = F.lit(0).cast("long").alias("deleted")
        return counts.agg(total("chunks"), F.count_if(F.col("chunks") > 0).alias("sources"), total("tokens"), total("vectors")).select("*", deleted, F.col("vectors").alias("active"))


def _write_new(fs: JavaObject, at: JavaObject, text: bytes) -> None:
    """Write a file that isn't there; an error if it is. Hadoop's local file system only looks before it overwrites, so the system itself is asked there."""
    folder = fs.resolvePath(at.getParent()).toUri()
    if folder.getScheme() == "file":
        with open(f"{folder.getPath()}/{at.getName()}", "xb") as out:
            out.write(text)
        return
    out = fs.create(at, False)
    out.write(bytearray(text))
    out.close()


def _visible(log: list[Commit]) -> list[Commit]:
    """What counts of a log: the last base, and what it was not made of."""
    base = next((c for c in reversed(log) if c.base), None)
    return log if base is None else [base, *(c for c in log if not c.base and c.number > base.after)]


def _book(commits: list[Commit]) -> str | None:
    """The codebook of the last compaction."""
    return commits[0].book if commits and commits[0].base else None
