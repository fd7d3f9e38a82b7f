"""Encoders and completers that can be put in: a hashing encoder offline, HTTP endpoints optionally."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashing_encoder(dim: int) -> Callable[[Column], Column]:
    """Word hashes with signs, normalised: deterministic, no network, no model. Our own default."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> np.ndarray | None:
            if text is None:
                return None
            out = np.zeros(dim)
            for w in text.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[h % dim] += 1 if h >> 63 else -1
            return (out / max(1e-9, float(np.linalg.norm(out)))).astype(np.float32)

        return texts.map(one)

    return encode


def post_json(url: str, body: dict, headers: dict[str, str], timeout_ms: int) -> str:
    data = json.dumps(body).encode()
    with urlopen(Request(url, data, {"Content-Type": "application/json", **headers}), timeout=timeout_ms / 1000) as r:
        return r.read().decode()


def read_embeddings(body: str, n: int) -> list[list[float]]:
    """The first vector of each item of a response; anything but ``n`` well-formed items is an error."""
    items = json.loads(body)
    if not isinstance(items, list) or len(items) != n:
        raise ValueError(f"{n} embeddings are due")
    out = []
    for item in items:
        rows = item.get("embedding") if isinstance(item, dict) else None
        if not rows or not isinstance(rows[0], list) or not rows[0]:
            raise ValueError("an embedding is not well-formed")
        out.append([float(x) for x in rows[0]])
    return out


def http_encoder(url: str, key: str = "", batch: int = 4, timeout_ms: int = 30_000, post: Callable = post_json) -> Callable[[Column], Column]:
    """An endpoint that takes {content: [...]}; texts are sent in batches from the executors.

    Where a batch fails its texts are sent one by one; a text that fails then has no vector (null).
    """

    def vectors(texts: list[str]) -> list[list[float] | None]:
        try:
            return read_embeddings(post(url, {"content": texts}, {"Authorization": f"Bearer {key}"} if key else {}, timeout_ms), len(texts))
        except (OSError, ValueError):
            return [None] if len(texts) == 1 else [v for t in texts for v in vectors([t])]

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        parts = (texts.iloc[i : i + batch].tolist() for i in range(0, len(texts), batch))
        return pd.Series([v for part in parts for v in vectors(part)], dtype="object")

    return encode


def http_requester(url: str, key: str = "", timeout_ms: int = 30_000, post: Callable = post_json) -> Callable[[Column], Column]:
    """A chat or fill-in endpoint: JSON of a request in, raw response body out (of a stream all its events)."""

    @F.pandas_udf("string")
    def ask(bodies: pd.Series) -> pd.Series:
        headers = {"Authorization": f"Bearer {key}"} if key else {}
        return bodies.map(lambda b: post(url, json.loads(b), headers, timeout_ms))

    return ask


def http_completer(url: str, key: str = "", model: str = "", timeout_ms: int = 30_000, post: Callable = post_json) -> Callable[[Column], Column]:
    """A chat endpoint: prompt in, raw response body out."""

    @F.pandas_udf("string")
    def complete(prompts: pd.Series) -> pd.Series:
        ask = lambda p: post(url, {"model": model, "messages": [{"role": "user", "content": p}], "stream": False}, {"Authorization": f"Bearer {key}"}, timeout_ms)
        return prompts.map(ask)

    return complete
