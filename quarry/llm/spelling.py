"""Spelling variants: words one edit apart, found in forward and reversed dictionaries.

One edit leaves one half of a word intact. So two words that are one edit apart share a prefix of one half or a
suffix of the other: each word stands in blocks of shared prefixes (a range of the sorted dictionary) and of shared suffixes (a range of
the dictionary of reversed words), once for each length that the shorter word of a pair can have. A block with more than MOST pairs
is subdivided: in what is still free of its words, one half or the other is intact again. Subdividing ends where a single
letter is free, so what a block holds is bounded by the alphabet. A pair is counted in one block only: on the way down it goes by
its suffix only if it can't go by its prefix. Words of a block are compared letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, settle, slices, small, spread

#: Letters of a word at least, its occurrences at least, and how much more often its form occurs at least.
LEAST, TWICE, OFTEN = 7, 2, 10
#: One in so many words loses a letter.
LOSES = 31
#: Pairs in a block that is not subdivided.
MOST = 1 << 13
#: Distinct words that a task counts before it passes them on.
HELD = 1 << 16
#: Letters are code points up to U+00FF, so a word is as many bytes of Latin-1.
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST)
_WHOLE = 1 << 30


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of LEAST letters or more, with their occurrences, TWICE or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, 64):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(b"%s:" % (b"" if doc is None else b"%d" % doc))
                for found in RUN.finditer(text or ""):
                    raw = found.group().encode()
                    raw = raw.lower()  # of bytes: A to Z only
                    h = zlib.crc32(raw, seed)
                    if h % LOSES:
                        counts[raw] += 1
                        continue
                    word = raw.decode()
                    at = h % len(word)
                    if len(word) > LEAST:
                        counts[(word[:at] + word[at + 1 :]).encode()] += 1
                if len(counts) > HELD:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TWICE)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with ``key``: of words that share a way down, the first ``a`` letters and the last ``b``."""
    key = F.xxhash64("m", "way", F.substring("word", F.lit(1), F.col("a")), F.right("word", F.col("b")))
    return blocks.select("m", "way", "a", "b", "cap", key.alias("key"), "word", "n")


def _halves(blocks: DataFrame) -> DataFrame:
    """Each row in the two blocks that its block falls into; ``cap``: pairs that share so many first letters are counted elsewhere."""
    free = F.col("m") - F.col("a") - F.col("b")
    k = F.floor(free / 2).cast("int")

    def side(name: str, a: Column, b: Column, cap: Column) -> Column:
        return F.struct(F.concat("way", F.lit(name)).alias("way"), a.alias("a"), b.alias("b"), cap.alias("cap"))

    sides = F.array(
        side("<", F.col("a") + k, F.col("b"), F.col("cap")),
        side(">", F.col("a"), (F.col("b") + free - k).cast("int"), F.least(F.col("cap"), F.col("a") + k)),
    )
    return _placed(blocks.select("m", F.explode(sides).alias("side"), "word", "n").select("m", "side.*", "word", "n"))


def blocks(words: DataFrame, most: int = MOST) -> DataFrame:
    """Written rows (m, way, a, b, cap, key, word, n) of all blocks with a pair of words, none of which has more than ``most`` pairs to compare unless a single letter is free."""
    classes = words.select(F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m"), "word", "n").where(F.col("m") >= LEAST)
    whole = classes.select("m", F.lit("").alias("way"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(_WHOLE).alias("cap"), "word", "n")
    waiting, done = settle(_halves(whole), "blocks"), None
    while True:
        # the shorter words are compared among themselves and with the longer ones
        short = F.sum((F.length("word") == F.col("m")).cast("long"))
        sizes = waiting.groupBy("key", "m", "a", "b").agg((short * F.count(F.lit(1))).alias("pairs"), F.count(F.lit(1)).alias("size")).where("pairs > 1 and size > 1")
        sizes = settle(sizes.select("key", ((F.col("pairs") > most) & (F.col("m") - F.col("a") - F.col("b") > 1)).alias("large")), "block-sizes")
        large, fine = (small(sizes.where(c).select("key")) for c in ("large", "not large"))
        kept = settle(waiting.join(fine, "key", "left_semi"), "blocks-done")
        done = kept if done is None else done.union(kept)
        if not large.take(1):
            return done
        waiting = settle(_halves(waiting.join(large, "key", "left_semi")), "blocks")


def _near(letters: np.ndarray, i: np.ndarray, j: np.ndarray, longer: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the words i (of m letters) and j (of m, or m + 1 where ``longer``) are one edit apart, and the letters shared at front and back."""
    one, other = letters[i, :m], letters[j]
    differ = one != other[:, :m]
    front = np.where(differ.any(1), differ.argmax(1), m)
    differ = np.where(longer[:, None], one != other[:, 1:], differ)[:, ::-1]
    back = np.where(differ.any(1), differ.argmax(1), m)
    return front + back >= np.where(longer, m, m - 1), front, back


class _Best:
    """Of each word: near words, and the best of them."""

    def __init__(self, n: np.ndarray, order: np.ndarray):
        self.n, self.order, self.pairs = n, order, []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.pairs += [(i, j), (j, i)]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, numbers of near words, and the most frequent of these (the first in order among equals)."""
        word, other = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        at = np.lexsort((self.order[other], -self.n[other], word))
        word, other = word[at], other[at]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        return word[first], np.diff(np.r_[first, len(word)]), other[first]


def _compared(table: pa.RecordBatch) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of whole blocks of one ``m``, sorted by key and the words' length."""
    m = table.column("m")[0].as_py()
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(w.ljust(m + 1, b"\0") for w in words), np.uint8).reshape(len(words), m + 1)
    a, b, cap, key, n = (table.column(c).to_numpy() for c in ("a", "b", "cap", "key", "n"))
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    best = _Best(n, order)
    left, d = np.flatnonzero(size == m), 0
    while len(left):
        d += 1
        left = left[left + d < len(words)]
        left = left[key[left] == key[left + d]]
        for i in np.array_split(left, max(1, len(left) * m >> 22)):
            j = i + d
            near, front, back = _near(letters, i, j, size[j] > m, m)
            near &= (front < cap[i]) & (front >= a[i]) & (back >= b[i]) & (cap[i] == cap[j]) & (a[i] == a[j]) & (b[i] == b[j])
            best.add(i[near], j[near])
    word, n_near, other = best.rows() if best.pairs else (np.zeros(0, np.int64),) * 3
    take = table.column("word").take
    return pa.RecordBatch.from_arrays([take(pa.array(word)), pa.array(n_near), pa.array(n[other]), take(pa.array(other))], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, best_n, best): how many words are one edit apart from it, and the most frequent of them (the first in code-point order among equals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                joined = pa.Table.from_batches([held, batch]).combine_chunks()
                batch = joined.to_batches()[0]
            key, m = (batch.column(c).to_numpy() for c in ("key", "m"))
            # the last block may go on in the next batch
            ends = np.flatnonzero((key[1:] != key[:-1]) | (m[1:] != m[:-1])) + 1
            cut = int(ends[-1]) if len(ends) else 0
            classes = np.r_[0, np.flatnonzero(m[1:cut] != m[: max(cut - 1, 0)]) + 1, cut] if cut else [0]
            for x, y in zip(classes[:-1], classes[1:], strict=True):
                yield _compared(batch.slice(x, y - x))
            held = batch.slice(cut)
        if held is not None and held.num_rows:
            yield _compared(held)

    rows = blocks(words, most).withColumn("size", F.length("word"))
    found = spread(rows, "key").sortWithinPartitions("m", "key", "size", "word").drop("way", "size").mapInArrow(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: where following (word, form) ends. Each step doubles what is behind, and frequencies rise tenfold with each form, so steps are few."""
    at = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = settle(step, "roots")
        if not step.where("moved").take(1):
            return step.select("word", "root")
        at = step.select("word", "root")


def spelling_variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of letters up to U+00FF, only A-Z being lower-cased; of a run in one of LOSES cases, told by doc_id and run, a
    letter is left out first. Words of LEAST letters and TWICE occurrences count. Near words are one inserted, deleted or replaced letter
    apart; of them the most frequent (of equals the first in code-point order) is the form, if OFTEN times as frequent. root follows forms to the
    last. Null and empty texts have no words, long ones are read whole, repeated rows count again; a null doc_id is an empty
    one. An empty table gives no rows. Columns other than doc_id and text are not read, whatever their names.
    """
    words = settle(word_counts(docs), "words")
    near = settle(words.join(near_words(words, most), "word"), "near")
    often = F.col("best_n") >= OFTEN * F.col("n")
    forms = near.select("word", "n_near", F.when(often, F.col("best")).alias("form"), F.when(often, F.col("best_n")).alias("form_n"))
    found = words.join(forms, "word", "left").join(roots(forms.where(F.col("form").isNotNull())), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(bytes) * 8),
    lambda i: ((('0x' || substr(hex(bytes), (i // 8 * 2 + 1)::INT, 2))::UBIGINT >> (i % 8)::UBIGINT) & 1::UBIGINT))),
    lambda s, b: xor(s >> 1::UBIGINT, 3988292384::UBIGINT * (xor(s, b) & 1::UBIGINT))), 4294967295::UBIGINT)"""

SQL = {
    "op13_spelling": f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{LEAST},}}')) AS run FROM documents
), counted AS (
  SELECT run, encode(doc || ':' || run) AS bytes, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, {_CRC} AS h FROM counted
), words AS (
  SELECT CASE WHEN h % {LOSES} > 0 THEN run ELSE substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST} AND sum(n) >= {TWICE}
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word)))::INT AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM cut a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, a.word, a.n FROM cut a JOIN words w ON a.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY 1
), near AS (
  SELECT b.word, n_near, most, min(other) AS other FROM best b JOIN pairs p ON p.word = b.word AND p.n = b.most GROUP BY ALL
), forms AS (
  SELECT w.word, CASE WHEN most >= {OFTEN} * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {OFTEN} * w.n THEN most END AS form_n
  FROM words w LEFT JOIN near USING (word)
), walk AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk k ON k.word = f.word JOIN forms e ON e.word = k.root AND e.form IS NULL
"""
}
QUERIES = {"op13_spelling": op13_spelling}
