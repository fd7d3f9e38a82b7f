"""Reports over tracked files and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import extension, language, parent


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"))


def store_stats(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, sources, tokens; vectors, those deleted and those active."""
    a = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_id").alias("sources"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    b = vectors.agg(F.count(F.lit(1)).alias("vectors"), F.count_if("is_deleted").alias("deleted"))
    return a.join(b).withColumn("active", F.col("vectors") - F.col("deleted"))


def file_details(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tracked files that exist, with language, folder and number of chunks (0 without any). ``chunks`` are chunks, or their numbers by source."""
    counts = chunks if "chunks" in chunks.columns else chunk_counts(chunks)
    return (
        files.where("exists").join(counts, files.path == F.col("source_id"), "left")
        .select("path", "nof_lines", "file_size", language(F.col("path")).alias("language"), parent(F.col("path")).alias("directory"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    )


def totals(files: DataFrame) -> DataFrame:
    """One row; all tracked files are counted, lines and bytes only of those that exist."""
    there = F.col("exists")
    return files.agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum(F.when(there, F.col("nof_lines"))), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum(F.when(there, F.col("file_size"))), F.lit(0)).alias("total_size_bytes"),
    )


def by(details: DataFrame, column: str) -> DataFrame:
    return details.groupBy(column).agg(F.count(F.lit(1)).alias("files"))


def top_files(details: DataFrame, n: int = 10) -> DataFrame:
    return details.orderBy(F.desc("chunks"), "path").limit(n)


def source_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row with totals, maps by language and folder, and the files of most chunks."""
    details = file_details(files, chunks)
    groups = [by(details, c).agg(F.map_from_entries(F.collect_list(F.struct(c, "files"))).alias(f"by_{c}")) for c in ("language", "directory")]
    top = top_files(details).agg(F.array_sort(F.collect_list(F.struct((-F.col("chunks")).alias("_o"), "path", "nof_lines", "file_size", "language", "chunks"))).alias("top_files"))
    return totals(files).join(groups[0]).join(groups[1]).join(top)


def inventory(sources: DataFrame) -> DataFrame:
    """(extension, files) of plain sources; URLs are counted apart."""
    ext = F.when(F.col("is_url"), "(url)").otherwise(extension(F.col("source")))
    return sources.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.coalesce(F.octet_length("content"), F.lit(0)) == 0).alias("empty"))


def embed_totals(sources: DataFrame, done: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: sources, those skipped as done, chunks and tokens made."""
    marked = sources.join(done.select(F.col("path").alias("source"), F.lit(True).alias("done")), "source", "left")
    a = marked.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.coalesce("done", F.lit(False))).alias("skipped"))
    b = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("metadata.token_count"), F.lit(0)).alias("tokens"))
    return a.join(b)


def column_widths(df: DataFrame) -> DataFrame:
    """(column, width): longest text of each column, at least its name."""
    widths = df.agg(*[F.max(F.char_length(F.col(c).cast("string"))).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(len(c))).cast("long").alias("width")) for c in df.columns])
    return widths.select(F.inline(pairs))
