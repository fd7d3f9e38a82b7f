"""Hashes: FNV-1a and 31-hash as Arrow functions, salted SHA-256 natively."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed parameters of 64-bit FNV-1a.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def _folded(parts: list[np.ndarray], start: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """One hash per array of symbols: position by position, over all arrays that reach it."""
    sizes = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    joined = np.concatenate([*parts, start[:0]]).astype(start.dtype)
    begins, left = (np.cumsum(sizes) - sizes)[order], -sizes[order]
    h = start.copy()
    for place in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(left, -place, side="left"))
        h[:n] = step(h[:n], joined[begins[:n] + place])
    out = np.empty_like(h)
    out[order] = h
    return out


def _mapped(texts: pd.Series, hashed: Callable[[list[str]], list]) -> list:
    known = texts.notna().to_numpy()
    found = iter(hashed(texts[known].tolist()))
    return [next(found) if k else None for k in known]


def fnv1a64_hex(texts: list[str]) -> list[str]:
    """64-bit FNV-1a of the UTF-8 bytes, as 16 hexadecimal digits."""
    parts = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    found = _folded(parts, np.full(len(parts), OFFSET, np.uint64), lambda h, x: (h ^ x) * np.uint64(PRIME))
    return [f"{h:016x}" for h in found.tolist()]


@F.pandas_udf(T.StringType())
def fnv1a64(texts: pd.Series) -> pd.Series:
    return pd.Series(_mapped(texts, fnv1a64_hex), dtype=object)


def hash31_int(texts: list[str]) -> list[int]:
    """31-hash over UTF-16 units in 32 signed bits."""
    parts = [np.frombuffer(t.encode("utf-16-le"), np.uint16) for t in texts]
    return _folded(parts, np.zeros(len(parts), np.uint32), lambda h, x: h * np.uint32(31) + x).view(np.int32).tolist()


@F.pandas_udf(T.IntegerType())
def hash31(texts: pd.Series) -> pd.Series:
    return pd.Series(_mapped(texts, hash31_int), dtype="Int32")


def salted_sha256(password: Column, salt: Column) -> Column:
    """salt$hex, the hash being of salt and password."""
    return F.concat(salt, F.lit("$"), F.sha2(F.concat(salt, password).cast("binary"), 256))


def verify_salted(password: Column, stored: Column) -> Column:
    return salted_sha256(password, F.substring_index(stored, "$", 1)) == stored


def short_hash(text: Column) -> Column:
    """Eight hexadecimal digits that identify a project path; our own choice of hash."""
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(8))
