"""Language-model scoring by context-tree weighting.

Text is read as bytes, each byte as eight binary decisions. Every node (a context of 0 to DEPTH bytes,
with the bits of the present byte so far) has a Krichevsky-Trofimov estimate; a node's weighted
probability halves its own estimate and the product over its longer contexts, and a prediction
mixes the estimates of all depths by the posterior weights that follow.

Counts of byte strings and words are summed over the training documents. Strings are dealt out by their last DEALT bytes of
context, so a subtree is whole in one task and has 256 ** (DEPTH - DEALT + 1) strings at most, whatever the corpus; trees of some HELD strings are
weighed at a time. Each passes the sums of its roots up; what is above (65,536 contexts of two bytes, 255 nodes each, at
12 bytes a node, 200 MB at the very most and a few in practice) is put together on the driver and sent to the tasks.

Documents are packed into batches of BATCH bytes where they lie. A batch asks for its distinct strings, the model
answers by a join on the string, and each batch, a partition of its own, adds up its answers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, blocks, documents, settle, slices, small, spread, text_bytes, word_hashes, word_places
from quarry.operators.numbering import numbered

#: Bytes of context; bytes of context by which strings are dealt; strings weighed at a time; bytes of a batch, and of a block handled at once.
DEPTH, DEALT, HELD, BATCH, BLOCK = 5, 3, 150_000, 24 << 20, 1 << 20
END_OF_TEXT, PAD = b"\xff", b"\x00" * DEPTH
#: Keys with the sign bit are words, others are packed byte strings; this word ends every text.
WORD_BIT, END_WORD = np.uint64(1 << 63), np.uint64((1 << 64) - 1)
ALPHA = 0.1


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; a missing id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[SPACE] = 0x20


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed strings, how many each text has, keys of tokens, how many each text has).

    Texts are lower-cased, words stand one space apart; a packed string is DEPTH + 1 bytes that end at a
    coded byte; every text ends in a byte and a token of their own.
    """
    data = np.frombuffer(b"".join([PAD + t + END_OF_TEXT for t in texts]), np.uint8)
    lengths = np.array([len(t) + DEPTH + 1 for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    frame = np.zeros(len(data), bool)
    frame[(begins[:, None] + np.arange(DEPTH)).ravel()] = True
    frame[begins + lengths - 1] = True
    starts, ends = word_places(data, frame)
    low = LOWER[data]
    first = np.searchsorted(starts, begins)
    n_words = np.diff(np.r_[first, len(starts)])
    # tokens: the words of each text and an end
    keys = np.full(len(starts) + len(texts), END_WORD, np.uint64)
    own = word_hashes(low, starts, ends) | WORD_BIT
    keys[np.arange(len(starts)) + np.repeat(np.arange(len(texts)), n_words)] = np.where(own == END_WORD, END_WORD - np.uint64(1), own)
    # bytes: words, one space before each word but the first, padding and end
    keep = ~SPACE[data] | frame
    spaced = np.ones(len(starts), bool)
    spaced[first[n_words > 0]] = False
    keep[starts[spaced] - 1] = True
    text = low[keep]
    sizes = np.add.reduceat(keep.astype(np.int64), begins)
    packed = np.zeros(len(text) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        packed = (packed << np.uint64(8)) | text[k : len(text) - DEPTH + k]
    real = np.ones(len(text), bool)
    real[((np.cumsum(sizes) - sizes)[:, None] + np.arange(DEPTH)).ravel()] = False
    return packed[real[DEPTH:]], sizes - DEPTH, keys, n_words + 1


class Counts:
    """Sums by key, put together whenever the parts grow large."""

    def __init__(self) -> None:
        self.keys, self.n, self.size = [], [], 0

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        """Weights are 0 or 1."""
        for w in (0, 1):
            found, n = np.unique(keys[weights == w], return_counts=True)
            self.keys.append(found)
            self.n.append(n * w)
            self.size += len(found)
        if self.size > 1_000_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, n = np.concatenate(self.keys), np.concatenate(self.n)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        keys, n = keys[starts], np.add.reduceat(n, starts) if len(starts) else n
        self.keys, self.n, self.size = [keys], [n], 0
        return keys, n


def _body(ids: list, texts: list[bytes]) -> bytes:
    """Ids and texts as one compressed string, its length in front."""
    known = np.array([d is not None for d in ids], np.uint8)
    numbers = np.array([len(ids), *(d or 0 for d in ids), *map(len, texts)], np.int64)
    whole = b"".join([numbers.tobytes(), known.tobytes(), *texts])
    return len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)


def _opened(body: bytes) -> tuple[list, list[bytes]]:
    whole = pa.decompress(memoryview(body)[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True)
    n = int.from_bytes(whole[:8], "little")
    ids, sizes = np.frombuffer(whole, np.int64, 2 * n, 8).reshape(2, n).tolist()
    at = 8 + 16 * n
    known = whole[at : at + n]
    at += n
    texts = []
    for size in sizes:
        texts.append(whole[at : at + size])
        at += size
    return [d if k else None for d, k in zip(ids, known, strict=True)], texts


def packed(docs: DataFrame) -> DataFrame:
    """(batch, body): documents in rows of about BLOCK bytes, compressed; the rows of one ``batch`` hold about BATCH bytes."""
    most = BATCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, size = TaskContext.get().partitionId() << 24, 0
        rows = (row for b in slices(batches) for row in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True))
        for part in blocks(rows, min(BLOCK, most)):
            ids, texts = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([_body(ids, texts)], pa.binary())], ["batch", "body"])
            size += sum(map(len, texts))
            if size >= most:
                batch, size = batch + 1, 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "batch long, body binary")


def _bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    for batch in slices(batches, 1):
        yield batch.column(0)[0].as_py(), *_opened(batch.column(1)[0].as_py())


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _sent(columns: dict[str, np.ndarray], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))
    yield from slices([whole], rows)


def counted(held: DataFrame) -> DataFrame:
    """(key, n): every word and byte string of the corpus, and its count in the training documents (0 is kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for _, ids, texts in _bodies(batches):
            train = np.array([not held_out(d) for d in ids])
            strings, n_strings, words, n_words = coded(texts)
            counts.add(strings, np.repeat(train, n_strings))
            counts.add(words, np.repeat(train, n_words))
        keys, n = counts.merge()
        yield from _sent({"key": keys.view(np.int64), "n": n.astype(np.int64)})

    return held.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def asked(held: DataFrame) -> DataFrame:
    """(batch, key): the distinct strings and words of each batch (twice where a batch's rows are read by two tasks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, size = None, [], 0

        def ended() -> Iterator[pa.RecordBatch]:
            if found:
                keys = _distinct(np.concatenate(found))
                yield from _sent({"batch": np.full(len(keys), now, np.int32), "key": keys.view(np.int64)})

        for batch, _, texts in _bodies(batches):
            if batch != now:
                yield from ended()
                now, found, size = batch, [], 0
            strings, _, words, _ = coded(texts)
            found.append(_distinct(np.concatenate([strings, words])))
            size += len(found[-1])
            if size > 1_000_000:
                found, size = [_distinct(np.concatenate(found))], 0
        yield from ended()

    return held.mapInArrow(run, "batch int, key long")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0, by Stirling's series eight steps up."""
    x = np.asarray(x, float)
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def weigh(own: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, weight of the node's own estimate) from log probabilities."""
    total = math.log(0.5) + np.logaddexp(own, longer)
    return total, np.exp(math.log(0.5) + own - total)


class Tree:
    """Nodes of depth DEALT to DEPTH over packed strings that share whole contexts of DEALT bytes."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        x = keys & np.uint64(0xFF)
        self.prefix = np.stack([(np.uint64(1) << np.uint64(k)) | (x >> np.uint64(8 - k)) for k in range(8)])
        self.bit = np.stack([(x >> np.uint64(7 - k)) & np.uint64(1) for k in range(8)]).astype(np.int64)
        n = np.broadcast_to(n, self.bit.shape)
        self.node, self.zeros, self.ones, self.own, self.at = {}, {}, {}, {}, {}
        self.total = {}
        for d in range(DEPTH, DEALT - 1, -1):
            context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
            self.node[d], at = np.unique((context << np.uint64(8)) | self.prefix, return_inverse=True)
            self.at[d] = at.reshape(self.bit.shape)
            size = len(self.node[d])
            self.ones[d] = np.bincount(self.at[d].ravel(), (n * self.bit).ravel(), size)
            self.zeros[d] = np.bincount(self.at[d].ravel(), (n * (1 - self.bit)).ravel(), size)
            estimate = log_estimate(self.zeros[d], self.ones[d])
            if d == DEPTH:
                self.total[d], self.own[d] = estimate, np.ones(size)
            else:
                longer = np.bincount(np.searchsorted(self.node[d], _parents(self.node[d + 1], d)), self.total[d + 1], size)
                self.total[d], self.own[d] = weigh(estimate, longer)

    def predict(self) -> np.ndarray:
        """Probability of each bit of each string, all depths from DEALT on mixed."""
        p = None
        for d in range(DEPTH, DEALT - 1, -1):
            at = self.at[d]
            hits = np.where(self.bit, self.ones[d][at], self.zeros[d][at])
            kt = (hits + 0.5) / (self.ones[d][at] + self.zeros[d][at] + 1.0)
            p = kt if p is None else self.own[d][at] * kt + (1 - self.own[d][at]) * p
        return p


def _parents(nodes: np.ndarray, depth: int) -> np.ndarray:
    """The nodes of ``depth`` above nodes one byte deeper."""
    return (((nodes >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8)) | (nodes & np.uint64(0xFF))


def _up(nodes: np.ndarray, depth: int, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes of ``depth`` and the sums over the nodes below each."""
    found, at = np.unique(_parents(nodes, depth), return_inverse=True)
    return found, *(np.bincount(at, v, len(found)) for v in sums)


TREES = "keys binary, n binary, strings int, node array<long>, zeros array<double>, ones array<double>, total array<double>"


def trees(counts: DataFrame) -> DataFrame:
    """Rows of some HELD strings and their counts, whole subtrees each, and the sums that their roots pass up (node, zeros, ones, total)."""
    most = HELD
    code = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * DEALT) - 1))
    dealt = spread(counts.where("key >= 0").withColumn("code", code), "code").sortWithinPartitions("code", "key").select("key", "n")

    def weighed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        tree = Tree(keys, n)
        node, *sums = _up(tree.node[DEALT], DEALT - 1, tree.zeros[DEALT], tree.ones[DEALT], tree.total[DEALT])
        pack = lambda x: pa.compress(x.tobytes(), "zstd", asbytes=True)
        columns = [[pack(np.diff(keys, prepend=np.uint64(0)))], [pack(n)], [len(keys)], [node.view(np.int64)], *([v] for v in sums)]
        types = [pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in TREES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy().view(np.uint64)]
            n = np.r_[n, batch.column(1).to_numpy()]
            if len(keys) < most:
                continue
            own = (keys >> np.uint64(8)) & np.uint64((1 << 8 * DEALT) - 1)
            if len(before := np.flatnonzero(own != own[-1])):
                edge = int(before[-1]) + 1
                yield weighed(keys[:edge], n[:edge])
                keys, n = keys[edge:], n[edge:]
        if len(keys):
            yield weighed(keys, n)

    return dealt.mapInArrow(run, TREES)


def string_scores(counts: DataFrame) -> DataFrame:
    """(key, value): log10 of the probability of each string's last byte after the bytes before it."""
    grown = settle(trees(counts), "trees")
    sums = grown.select(F.explode(F.arrays_zip("node", "zeros", "ones", "total")).alias("x")).groupBy("x.node").agg(*[F.sum(f"x.{c}").alias(c) for c in ("zeros", "ones", "total")])
    found = sums.toArrow()  # 65,536 x 255 rows at the very most
    node = found.column("node").to_numpy().view(np.uint64)
    zeros, ones, total = (found.column(c).to_numpy() for c in ("zeros", "ones", "total"))
    above = []  # (node, probability of a one, weight of the own estimate), by depth from DEALT - 1 to 0
    for d in range(DEALT - 1, -1, -1):
        if d < DEALT - 1:
            node, zeros, ones, total = _up(node, d, zeros, ones, total)
        total, own = weigh(log_estimate(zeros, ones), total)
        order = np.argsort(node)
        above.append((node[order].astype(np.uint32), ((ones + 0.5) / (zeros + ones + 1.0))[order].astype(np.float32), own[order].astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in slices(batches, 1) for row in batch.to_pylist()):
            keys, n = (np.frombuffer(pa.decompress(row[c], 8 * row["strings"], "zstd", asbytes=True), t) for c, t in (("keys", np.uint64), ("n", np.int64)))
            keys = np.cumsum(keys, dtype=np.uint64)
            tree = Tree(keys, n)
            p = tree.predict()
            context = keys >> np.uint64(8)
            for k, (nodes, one, own) in enumerate(above):
                d = DEALT - 1 - k
                here = ((context & np.uint64((1 << 8 * d) - 1)) << np.uint64(8)) | tree.prefix
                at = np.searchsorted(nodes, here.astype(np.uint32))
                kt = np.where(tree.bit, one[at], 1 - one[at]).astype(np.float64)
                p = own[at] * kt + (1 - own[at].astype(np.float64)) * p
            yield from _sent({"key": keys.view(np.int64), "value": np.log10(p).sum(axis=0).astype(np.float32)})

    return grown.select("keys", "n", "strings").mapInArrow(score, "key long, value float")


class Table:
    """Open-addressed lookup of 64-bit keys, built and asked in whole arrays."""

    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        mask = (1 << self.bits) - 1
        used, self.keys, self.values = np.full(1 << self.bits, -1, np.int32), np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, values.dtype)
        todo, at = np.arange(len(keys), dtype=np.int32), self._place(keys)
        while len(todo):
            free = used[at] < 0
            used[at[free]] = todo[free]
            lost = used[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & mask
        taken = np.flatnonzero(used >= 0)
        self.keys[taken], self.values[taken] = keys[used[taken]], values[used[taken]]
        # an empty place must not look like a key
        self.keys[used < 0] = ~np.uint64(0) - np.uint64(2)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, all of which must be there."""
        at = self._place(keys)
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return self.values[at]


RESULT = {
    "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(),
    "base_score": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64(), "bits_per_byte": pa.float64(),
}


def scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Training documents are those whose CRC-32 of the id as text is not divisible by ten (no id: held
    out). Texts are lower-cased (A-Z) and read as words with one space between, whole however long, a null text as an empty
    one; the model codes their bytes and an end, n_bytes in all, at bits_per_byte. Every row counts by itself, repeated
    ones too; an empty table gives no rows. Other columns are not read, whatever their names.
    """
    held = settle(packed(docs), "packed")
    numbers = numbered(held.select("batch").distinct(), "batch")
    n_batches = max(1, numbers.count())
    held = held.join(small(settle(numbers, "batches")), "batch").select(F.col("row").cast("int").alias("batch"), "body")
    counts = settle(counted(held), "counts")
    row = counts.where("key < 0").agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, kinds = row[0] or 0, row[1] or 0
    # a float holds word counts exactly up to 2 ** 24
    kind = "float" if tokens < 1 << 24 else "double"
    values = string_scores(counts).select("key", F.col("value").cast(kind).alias("answer")).union(counts.where("key < 0").select("key", F.col("n").cast(kind)))
    answers = asked(held).join(values, "key")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: dict[int, list[bytes]] = {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            number, key, answer, body = (batch.column(k) for k in range(4))
            told = key.is_valid()
            for b in pc.unique(number).to_pylist():
                here = pc.equal(number, b)
                mine = pc.and_(here, told)
                found.setdefault(b, []).append((key.filter(mine).to_numpy(), answer.filter(mine).to_numpy()))
                bodies.setdefault(b, []).extend(body.filter(pc.and_(here, pc.invert(told))).to_pylist())
        log_base = math.log10(tokens + ALPHA * (kinds + 1)) if tokens or kinds else math.log10(ALPHA)
        for b, rows in bodies.items():
            keys, value = (np.concatenate(x) for x in zip(*found.pop(b), strict=True))
            table = Table(keys.view(np.uint64), value)
            del keys, value
            for row_ in rows:
                ids, texts = _opened(row_)
                strings, n_bytes, words, n_words = coded(texts)
                count = table.get(words).astype(np.float64)
                starts = np.cumsum(n_words) - n_words
                known = np.add.reduceat((count > 0).astype(np.int64), starts)
                base = np.add.reduceat(np.log10(count + ALPHA) - log_base, starts)
                score = np.add.reduceat(table.get(strings).astype(np.float64), np.cumsum(n_bytes) - n_bytes)
                columns = [ids, [held_out(d) for d in ids], n_words, known, np.full(len(ids), tokens), base, score, n_bytes, -score / math.log10(2) / n_bytes]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RESULT.values(), strict=True)], list(RESULT))

    told = answers.select("batch", "key", "answer", F.lit(None).cast("binary").alias("body"))
    rows = held.select("batch", F.lit(None).cast("long").alias("key"), F.lit(None).cast(answers.schema["answer"].dataType).alias("answer"), "body")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return told.union(rows).repartitionById(n_batches, F.col("batch")).mapInArrow(add, schema)


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))


QUERIES = {"op8_ctw": op8_ctw}
SQL: dict[str, str] = {}
