"""The engine as one object: what the command line offers, as methods."""

from __future__ import annotations

import json
import logging
import os
import sys
import time
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.tokens import count_bytes
from quarry.operators import config, packing, prompts, stats
from quarry.operators.chunking import Limits
from quarry.sources import scan
from quarry.sources.store import Store
from quarry.streaming.watch import WATCH_S


class Engine:
    """A configured store with its sources, encoder and (optional) completer."""

    def __init__(
        self, spark: SparkSession, settings: Mapping[str, Any], path: str, encoder: Callable[[Column], Column], dim: int,
        completer: Callable[[Column], Column] | None = None, fetch: scan.Fetch = scan.http_fetch, requester: Callable[[Column], Column] | None = None, settings_file: str = "",
        probe: scan.Fetch = scan.http_probe,
    ):
        """``completer`` takes prompts, ``requester`` JSON of whole requests; with ``settings_file`` each update reads the settings again."""
        self.spark, self.settings, self.encoder, self.completer, self.fetch = spark, settings, encoder, completer, fetch
        self.requester, self.settings_file, self.probe, self._stats = requester, settings_file, probe, None
        self.store = Store(spark, path, encoder, dim, *self._store_settings())

    def _store_settings(self) -> tuple[str, Limits]:
        chunking = self.settings.get("chunking", {})
        limits = Limits(int(chunking.get("nof_min_tokens", 50)), int(chunking.get("nof_max_tokens", 450)), float(chunking.get("overlap_percentage", 0.1)))
        return self.settings.get("database", {}).get("distance_metric", "cosine"), limits

    def _where(self) -> tuple[list[dict[str, Any]], float]:
        return config.source_specs(self.settings), float(self.settings.get("source", {}).get("max_file_size_mb", scan.MAX_FILE_MB))

    def sources(self) -> DataFrame:
        """All configured sources with content; what can't be read is left out."""
        specs, max_mb = self._where()
        return scan.collect_sources(self.spark, specs, max_mb=max_mb, fetch=self.fetch)

    def listing(self) -> DataFrame:
        """All configured sources without content."""
        specs, max_mb = self._where()
        return scan.list_sources(self.spark, specs, max_mb, self.probe)

    def _read(self, wanted: DataFrame) -> DataFrame:
        specs, max_mb = self._where()
        return scan.read_sources(self.spark, specs, wanted, max_mb, self.fetch)

    def embed(self) -> DataFrame:
        """Add what isn't tracked yet; only that is read."""
        self.store.embed(self.listing(), self._read)
        self._stats = None
        return self.stats()

    def update(self, ignored: DataFrame | None = None) -> dict[str, int]:
        """Bring the store up to date; only what has changed is read. Paths in ``ignored`` (path) are left as they are, as those that failed too often."""
        if self.settings_file:
            self.settings = config.load(self.settings_file) or self.settings
            self.store.metric, self.store.limits = self._store_settings()
        changed = self.store.update(self.listing(), ignored, self._read)
        if set(changed) - {"unchanged"}:
            self._stats = None
        return changed

    def watch(self, seconds: int = WATCH_S, rounds: int | None = None, sleep: Callable[[float], None] | None = None) -> int:
        """Update again and again; a failed round is told and the next one follows. Returns the rounds made."""
        done = 0
        while rounds is None or done < rounds:
            try:
                self.update()
            except Exception as e:  # a round may fail, watching goes on
                logging.getLogger(__name__).warning("update failed: %s", e)
            done += 1
            if rounds is None or done < rounds:
                (sleep or time.sleep)(seconds)
        return done

    def encode(self, text: str) -> list[float]:
        """The vector of one question."""
        fmt = self.settings.get("embedding", {}).get("query_format", "{}")
        return self.spark.range(1).select(self.encoder(prompts.apply_format(F.lit(text), fmt))).first()[0]

    def search(self, question: str, k: int = 5) -> DataFrame:
        return self.store.search(self.encode(question), k)

    def context(self, question: str, k: int = 5, budget: int = 8192, comment_out: bool = False, attached: Sequence[tuple[str, str]] = ()) -> DataFrame:
        """One row: the packed context and its tokens; what is ``attached`` (filename, content) comes before the best chunks."""
        found = self.search(question, k).withColumn("query_id", F.lit(0).cast("long"))
        best = Window.orderBy(F.desc("similarity_score"), "chunk_id")  # of k rows
        ranked = found.withColumn("rank", (F.row_number().over(best) + len(attached)).cast("long")).select("query_id", "rank", "source_id", "content")
        if attached:
            first = [(0, i, name, text) for i, (name, text) in enumerate(attached, 1)]
            ranked = self.spark.createDataFrame(first, "query_id long, rank long, source_id string, content string").union(ranked)
        packed = packing.pack_context(ranked, budget, count_bytes(prompts.QUERY_TEMPLATE.encode()), comment_out=comment_out)
        return packing.context_text(packed)

    def chat(self, question: str, k: int = 5, budget: int = 8192) -> str:
        """The completer's answer to a question in its context."""
        if self.completer is None:
            raise ValueError("no completer is configured")
        row = self.context(question, k, budget).first()
        prompt = prompts.query_prompt(F.lit(row.context if row else ""), F.lit(question))
        return self.spark.range(1).select(prompts.response_content(self.completer(prompt))).first()[0]

    def _asked(self, request: Column) -> DataFrame:
        """One row: the body of the answer."""
        if self.requester is None:
            raise ValueError("no requester is configured")
        return self.spark.range(1).select(self.requester(request).alias("body"))

    def complete(
        self, messages: Sequence[tuple[str, str]], k: int = 5, budget: int = 8192, temperature: float | None = None, max_tokens: int | None = None, stream: bool = False, api: Mapping[str, Any] | None = None,
        attached: Sequence[tuple[str, str]] = (),
    ) -> str:
        """The answer to the last of the (role, text) messages, asked in its context, ``attached`` files (filename, content) first, with those before as history."""
        row, api = self.context(messages[-1][1], k, budget, attached=attached).first(), api or {}
        prompt = prompts.query_prompt(F.lit(row.context if row else ""), F.lit(messages[-1][1]))
        turns = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(text).alias("content")) for role, text in messages])
        knows = api.get("temperature_support", True)
        request = prompts.chat_request(turns, prompt, api.get("model", ""), temperature if knows else None, max_tokens, stream, api.get("max_tokens_name", "max_tokens"))
        read = prompts.sse_content if stream else prompts.response_content
        return self._asked(request).select(read(F.col("body"))).first()[0]

    def fill_in(self, prefix: str, suffix: str, k: int = 5, budget: int = 8192, stops: Sequence[str] = (), temperature: float | None = None, max_tokens: int | None = None, **shape: Any) -> str:
        """What belongs between two pieces of a file; ``shape`` is what ``prompts.fim_request`` takes of the endpoint."""
        row = self.context(prefix + suffix, k, budget, comment_out=True).first()
        fields = {n: v for n, v in (("temperature", temperature), ("max_tokens", max_tokens)) if v is not None}
        request = prompts.fim_request(F.lit(prefix), F.lit(suffix), F.lit(row.context if row else ""), stops=list(stops), fields=fields, **shape)
        return self._asked(request).select(prompts.fim_response(F.col("body"), [*shape.get("api_stops", []), *stops])).first()[0]

    def write_info(self, path: str, port: int = 0, watching: bool = False, interval: int = WATCH_S) -> None:
        """A small JSON file about this process, for those that start it."""
        about = {"port": port, "timestamp": int(time.time()), "watch_enabled": watching, "watch_interval": interval, "pid": os.getpid(), "exec": sys.argv[0]}
        with open(path, "w", encoding="utf-8") as f:
            json.dump(about, f, indent=2)

    def stats(self) -> DataFrame:
        return self.store.stats()

    def source_stats(self, refresh: bool = False) -> DataFrame:
        """Totals and groups of the tracked files; those that are gone from the sources count as tracked only.

        One row, kept until something changes in the store through this engine, or ``refresh``.
        """
        if self._stats is None or refresh:
            row = self._source_stats()
            self._stats = self.spark.createDataFrame(row.collect(), row.schema)
        return self._stats

    def _source_stats(self) -> DataFrame:
        there = self.listing().select(F.col("source").alias("path"), F.lit(True).alias("exists")).distinct()
        files = self.store.tracked().join(there, "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
        return stats.source_stats(files, self.store.chunk_counts())

    def clear(self) -> None:
        self.store.clear()
        self._stats = None

    def compact(self) -> None:
        self.store.compact()

    def index(self) -> None:
        """Make an index of what is there; what comes later is added to it."""
        self.store.index()

    def providers(self) -> list[dict[str, Any]]:
        return [config.api_settings(a) for a in self.settings.get("generation", {}).get("apis", [])]
