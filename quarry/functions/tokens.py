"""Token counts and text units as column expressions; WordPiece counts by an automaton, as an Arrow function."""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation and C whitespace, as character class bodies for Java and RE2 alike.
PUNCT = r"!-/:-@\[-`{-~"
SPACE = r" \t\n\x0B\f\r"
#: Ideographs that count as words of their own (fixed ranges).
CJK = "一-鿿㐀-䶿豈-﫿"
UNITS = rf"[{SPACE}]+|[{PUNCT}]|[^{SPACE}{PUNCT}]+"
WORDS = rf"[{PUNCT}]|[^{SPACE}{PUNCT}]+"


def _word_tokens(word: Column) -> Column:
    n = F.octet_length(word)
    return F.when(n <= 4, 1).when(n <= 8, 2).otherwise(F.ceil(n / 4)).cast("long")


def estimate_tokens(text: Column, special: bool = False) -> Column:
    """Estimated tokens: punctuation 1 each; words by their bytes: up to 4 one, up to 8 two, else a quarter, rounded up."""
    spaced = F.regexp_replace(text, f"([{CJK}])", " $1 ")
    words = F.regexp_extract_all(spaced, F.lit(WORDS), F.lit(0))
    return F.aggregate(words, F.lit(2 if special else 0).cast("long"), lambda n, w: n + _word_tokens(w))


def split_units(text: Column) -> Column:
    """Runs of whitespace, single punctuation marks, and runs of anything else."""
    return F.regexp_extract_all(text, F.lit(UNITS), F.lit(0))


_UNITS_B = re.compile(rb"[ \t\n\x0b\f\r]+|[!-/:-@\[-`{-~]|[^ \t\n\x0b\f\r!-/:-@\[-`{-~]+")
_WORDS_B = re.compile(rb"[!-/:-@\[-`{-~]|[^ \t\n\x0b\f\r!-/:-@\[-`{-~]+")
_CJK_S = re.compile(f"([{CJK}])")


def padded(text: bytes) -> bytes:
    """``text`` with spaces around ideographs."""
    return text if text.isascii() else _CJK_S.sub(r" \1 ", text.decode(errors="replace")).encode()


def unit_bytes(text: bytes) -> list[bytes]:
    return _UNITS_B.findall(text)


def count_bytes(text: bytes) -> int:
    """Estimated tokens of UTF-8 bytes; the rule of ``estimate_tokens``."""
    return sum(1 if (n := len(w)) <= 4 else 2 if n <= 8 else -(-n // 4) for w in _WORDS_B.findall(padded(text)))


def unit_counts(units: list[bytes], text: bytes) -> list[int]:
    """Tokens of the units of ``text``: without ideographs a unit's length and kind decide."""
    if not text.isascii() and _CJK_S.search(text.decode(errors="replace")):
        return [count_bytes(u) for u in units]
    return [0 if u[0] in b" \t\n\x0b\f\r" else 1 if (n := len(u)) <= 4 else 2 if n <= 8 else -(-n // 4) for u in units]


class WordPiece:
    """Greedy longest-match counts over a vocabulary, byte by byte; no vocabulary: the estimate."""

    LONGEST = 100

    def __init__(self, vocabulary: Collection[str]):
        self.vocabulary = frozenset(v.encode() for v in vocabulary)
        self.automaton: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def load(cls, path: str) -> WordPiece:
        """The vocabulary of a tokenizer file (``model.vocab``); a missing file leaves the estimate."""
        try:
            with open(path, encoding="utf-8") as f:
                return cls(json.load(f)["model"]["vocab"])
        except FileNotFoundError:
            return cls(())

    def _automaton(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges (state and byte as one number, sorted), the states that they lead to, and whether a piece ends in a state.

        State 0 begins words, state 1 continues them. Edges in order take 17 bytes a letter of the vocabulary at most, and a step for many words is one search among them.
        """
        if self.automaton is None:
            edges, ends, n = {}, set(), 2
            for piece in self.vocabulary:
                inner = piece.startswith(b"##") and len(piece) > 2
                for state, letters in ((1, piece[2:]),) * inner + ((0, piece),):
                    for byte in letters:
                        at = state << 8 | byte
                        if at not in edges:
                            edges[at], n = n, n + 1
                        state = edges[at]
                    ends.add(state)
            keys = np.array(sorted(edges), np.int64)
            accepts = np.zeros(n, bool)
            accepts[list(ends)] = True
            self.automaton = keys, np.array([edges[k] for k in keys.tolist()], np.int64), accepts
        return self.automaton

    def words(self, words: Sequence[bytes], special: bool = False) -> np.ndarray:
        """Tokens of each word: the longest piece that fits, again and again, for all words side by side; where none fits, a byte is one."""
        keys, targets, accepts = self._automaton()
        size = np.fromiter(map(len, words), np.int64, len(words))
        count = np.where(size > self.LONGEST, int(special), 0)
        left = np.flatnonzero((size > 0) & (size <= self.LONGEST))
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        end = np.cumsum(size)
        begin, end = (end - size)[left], end[left]  # where the next piece begins, and the word ends
        at, state, fits = begin.copy(), np.zeros(len(left), np.int64), begin.copy()
        while len(left):
            edge = state << 8 | data[at]
            place = np.searchsorted(keys, edge)
            place[place == len(keys)] = 0
            on = (at < end) & (keys[place] == edge) if len(keys) else np.zeros(len(left), bool)
            state = np.where(on, targets[place] if len(keys) else 0, state)
            at = at + on
            fits = np.where(on & accepts[state], at, fits)
            done = np.flatnonzero(~on)  # the piece ends where it last fitted
            count[left[done]] += 1
            begin[done] = at[done] = fits[done] = np.maximum(fits[done], begin[done] + 1)
            state[done] = 1
            stay = begin < end
            left, begin, end, at, state, fits = (x[stay] for x in (left, begin, end, at, state, fits))
        return count

    def counts(self, texts: Sequence[bytes], special: bool = False) -> np.ndarray:
        """Tokens of each text; each different word is looked up once."""
        if not self.vocabulary:
            return np.array([count_bytes(t) for t in texts], np.int64)
        found = [_WORDS_B.findall(padded(t)) for t in texts]
        kinds = {w: i for i, w in enumerate(dict.fromkeys(w for own in found for w in own))}
        each = self.words(list(kinds), special)
        place = np.fromiter((kinds[w] for own in found for w in own), np.int64, sum(map(len, found)))
        starts = np.cumsum([0, *map(len, found)])
        sums = np.r_[0, np.cumsum(each[place])]
        return sums[starts[1:]] - sums[starts[:-1]] + 2 * special

    def count(self, text: bytes, special: bool = False) -> int:
        return int(self.counts([text], special)[0])

    def udf(self, special: bool = False):
        """The count as a vectorised column function; the vocabulary travels with it."""

        @F.pandas_udf("long")
        def count(texts: pd.Series) -> pd.Series:
            there = texts.notna()
            out = pd.Series(pd.NA, texts.index, "Int64")
            if there.any():
                out[there] = self.counts([t.encode() for t in texts[there]], special)
            return out

        return count
