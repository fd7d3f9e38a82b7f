"""Server-sent streams of completions read as they come in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_text(event: bytes) -> str | None:
    """What an event adds to the text, as ``prompts.sse_content`` has it; None for the end."""
    if not event.startswith(b"data: "):
        return ""
    data = event[6:].decode(errors="replace")
    if data == "[DONE]":
        return None
    try:
        delta = json.loads(data)["choices"][0]["delta"]
        text = delta["content"] if delta.get("content") is not None else delta.get("reasoning_content") if "content" in delta else ""
    except (ValueError, LookupError, TypeError, AttributeError):
        return ""
    return text if isinstance(text, str) else ""


def contents(pieces: DataFrame) -> DataFrame:
    """(stream, content, done): what each batch of ``pieces`` (stream, seq, piece) adds to each stream's text.

    Pieces may be cut anywhere, within an event or a character: the state of a stream is its unfinished event, and nothing else, so it is as
    small as one. Pieces come in order of seq from batch to batch and are sorted within one. What comes behind [DONE] is left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, done = state.get if state.exists else (b"", False)
        pieces = [p for f in frames for p in zip(f["seq"].to_numpy(), f["piece"].to_numpy(), strict=True)]
        pieces.sort(key=lambda p: p[0])
        *events, rest = (bytes(rest) + b"".join(bytes(p) for _, p in pieces)).split(b"\n\n")
        said = []
        for event in () if done else events:
            text = event_text(event)
            if text is None:
                done = True
                break
            said.append(text)
        state.update((b"" if done else rest, done))
        yield pd.DataFrame({"stream": [key[0]], "content": ["".join(said)], "done": [done]})

    return pieces.groupBy("stream").applyInPandasWithState(step, "stream string, content string, done boolean", "rest binary, done boolean", "append", GroupStateTimeout.NoTimeout)
