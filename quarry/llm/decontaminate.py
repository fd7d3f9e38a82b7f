"""Benchmark decontamination by template canonicalisation.

Numbers, units and names are replaced with typed placeholders, other words with their plain form. All
windows of WIDTH such tokens with PLAIN plain words or more are hashed, windows with fewer by their exact words,
and the windows of the documents are hash-joined with those of the benchmark. An item of fewer tokens is one window;
one of fewer than PLAIN tokens (a bare number, a name) says nothing amid a text, and counts only where it is a whole line, by its exact words.
A Bloom filter, sized by the count of the benchmark's windows (BLOOM_MOST bits at most), keeps windows that no
benchmark item has from being shuffled; the join decides. On each alignment of a document with an item
a content of the item must map to one content (a name always to the same name, a number to the same
number), windows that disagree being left out unless they are verbatim, so a re-parameterised question is caught and a chance likeness of form is not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LAST, Rolling, blocks, documents, mixed, row_key, settle, slices, small, spread, text_bytes

#: Window width, plain words that it needs, and the share of an item's words to be covered.
WIDTH, PLAIN, COVERED = 8, 4, 0.5
#: Bits of the Bloom filter: 16 for each window of the benchmark, in these bounds (16 MB at most).
BLOOM_LEAST, BLOOM_MOST = 1 << 16, 1 << 27
NUMBER = re.compile(rb"[+-]?[$]?\d[\d.,:/%-]*(st|nd|rd|th)?")
QUANTITY = re.compile(rb"([+-]?\d[\d.,]*)([A-Za-z%]{1,3})")
EDGE = b".,;:!?\"'()[]{}<>"
#: Fixed lists in English, German, French and Spanish: number words and units, lower case. Words that are articles, too, are left out.
NUMBER_WORDS = frozenset(
    (
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
        "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
        "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn "
        "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen milliarde milliarden "
        "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf "
        "vingt trente quarante cinquante soixante soixante-dix quatre-vingts quatre-vingt-dix cent cents mille millions milliard milliards "
        "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve "
        "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento doscientos trescientos quinientos mil millón millones"
    ).encode().split()
)
UNITS = frozenset(
    (
        "mm cm m km g kg mg t l ml s sec secs second seconds min mins minute minutes h hr hour hours day days week weeks month months year years "
        "metre metres meter meters kilometre kilometres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms litre litres liter liters "
        "percent % usd eur dollar dollars euro euros cent cents pound pounds watt watts volt volts degree degrees "
        "sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren metern kilometern zentimeter "
        "gramm kilogramm tonne tonnen litern prozent grad pfund "
        "seconde secondes heure heures jour jours semaine semaines mois ans année années mètre mètres kilomètre kilomètres centimètre centimètres "
        "gramme grammes kilogramme kilogrammes tonnes pour-cent centime centimes degré degrés "
        "segundo segundos minuto minutos hora horas día días semana semanas meses año años metro metros kilómetro kilómetros centímetro centímetros "
        "gramo gramos kilogramo kilogramos tonelada toneladas litro litros céntimo céntimos grado grados peso pesos dólar dólares"
    ).encode().split()
)
#: Fixed list: German words after which a capital is a noun's, lower case.
BEFORE_NOUNS = frozenset(
    "der das den dem des ein eine einen einem einer eines kein keine keinen keinem keiner im am zum zur vom beim ins "
    "dieser diese dieses diesen diesem jeder jede jedes jeden jedem sein seine seinen seinem seiner ihr ihre ihren ihrem ihrer viele wie alle".encode().split()
)
WORD_TYPE, NUM, UNIT, NAME = 0, 1, 2, 3
#: Kinds of windows: of template tokens; a whole item amid a sentence, its first word plain; of exact words; of the exact words of a line.
TEMPLATE, WHOLE, EXACT, LINE = 0, 1, 2, 3
_CODES = {NUM: 0x9E3779B97F4A7C15, UNIT: 0xC2B2AE3D27D4EB4F, NAME: 0x165667B19E3779F9}


class Canon(dict):
    """word -> number of its row in the arrays: template hash at a sentence's start and elsewhere, types there, whether a capital after it says nothing, hash of the plain word.

    A capital says nothing after a sentence's end, and nothing where a German noun is due: after a number or an article.
    """

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[tuple[int, int, int, int, bool, int]] = []
        self.hashes, self.types, self.stops = np.zeros((2, 0), np.uint64), np.zeros((2, 0), np.int8), np.zeros(0, bool)
        self.plain = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        core = word.strip(EDGE) or word
        low = core.lower()
        start = other = WORD_TYPE
        if core[0] in b"+-$0123456789" and (NUMBER.fullmatch(core) or QUANTITY.fullmatch(core)) or low in NUMBER_WORDS:
            start = other = NUM
        elif low in UNITS:
            start = other = UNIT
        elif len(core) > 1 and core[:2].decode(errors="ignore")[:1].isupper() and not core.isupper():
            other = NAME
        plain = xxhash.xxh64_intdigest(low, 5)
        ends = word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?")
        self.fresh.append((_CODES.get(start, plain), _CODES.get(other, plain), start, other, ends or start == NUM or low in BEFORE_NOUNS, plain))
        self[word] = n = len(self)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Rows of the words; what is known is forgotten between calls at a quarter of a million words."""
        if len(self) > 250_000:
            self.clear()
            self.__init__()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            h0, h1, t0, t1, stop, plain = zip(*self.fresh, strict=True)
            self.hashes = np.hstack([self.hashes, np.array([h0, h1], np.uint64)])
            self.types = np.hstack([self.types, np.array([t0, t1], np.int8)])
            self.stops = np.hstack([self.stops, np.array(stop, bool)])
            self.plain = np.hstack([self.plain, np.array(plain, np.uint64)])
            self.fresh = []
        return out


def canonical(texts: list[bytes], memo: Canon) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, their sizes by text, template hashes and types, rows of the memo."""
    words, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = t.split()
        words += own
        sizes[i] = len(own)
    n = memo.numbers(words)
    first = np.r_[True, memo.stops[n]][:-1]
    starts = np.cumsum(sizes) - sizes
    first[starts[sizes > 0]] = True
    return words, sizes, np.where(first, memo.hashes[0, n], memo.hashes[1, n]), np.where(first, memo.types[0, n], memo.types[1, n]), n


def _keys(rolled: np.ndarray, width: int, kind: int) -> np.ndarray:
    return mixed(rolled + np.uint64(width + (kind << 8)))


def _inside(sizes: np.ndarray, types: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a window lies inside one text, and its plain words, by its start."""
    n = len(types) - width + 1
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(types))
    words = np.r_[0, np.cumsum(types == WORD_TYPE)]
    return room[:n] >= width, words[width:] - words[:n]


def windows(sizes: np.ndarray, hashes: np.ndarray, types: np.ndarray, width: int, plain: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the windows inside one text that have ``plain`` plain words or more."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside, words = _inside(sizes, types, width)
    at = np.flatnonzero(inside & (words >= plain))
    return _keys(Rolling(hashes).windows(width)[at], width, TEMPLATE), at


def whole_windows(sizes: np.ndarray, hashes: np.ndarray, types: np.ndarray, width: int, plain: int, at_start: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the windows whose first word counts as a name only amid its sentence, that word taken as plain.

    ``at_start``: hashes and types that the words have at a sentence's start.
    """
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside, words = _inside(sizes, types, width)
    n = len(inside)
    at = np.flatnonzero(inside & (types != at_start[1])[:n] & (words + 1 >= plain))
    return _keys(Rolling(hashes).windows(width)[at] - hashes[at] + at_start[0][at], width, WHOLE), at


def exact_windows(sizes: np.ndarray, plain_hashes: np.ndarray, types: np.ndarray, width: int, under: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the exact words of the windows inside one text that have fewer than ``under`` plain words."""
    if len(types) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside, words = _inside(sizes, types, width)
    at = np.flatnonzero(inside & (words < under))
    return _keys(Rolling(plain_hashes).windows(width)[at], width, EXACT), at


def _slots(words: list[bytes], types: np.ndarray, at: np.ndarray, width: int, kind: int = TEMPLATE) -> list[list[str]]:
    """Contents of the placeholders of each window, in order; exact windows have none."""
    if kind in (EXACT, LINE):
        return [[] for _ in at]
    cores = {}
    out = []
    for a in at.tolist():
        own = []
        for k in range(a + (kind == WHOLE), a + width):
            if types[k]:
                if k not in cores:
                    cores[k] = words[k].strip(EDGE).lower().decode(errors="replace")
                own.append(cores[k])
        out.append(own)
    return out


def line_windows(texts: list[bytes], plain_hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the lines of ``width`` words, by their exact words."""
    at, n = [], 0
    for text in texts:
        for line in text.split(b"\n"):
            size = len(line.split(None, width))  # no more than width + 1 parts
            if size == width:
                at.append(n)
            n += size if size <= width else len(line.split())
    found = Rolling(plain_hashes).windows(width)
    return _keys(found[at], width, LINE), np.array(at, np.int64)


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes % np.uint64(size), (hashes >> np.uint64(32)) % np.uint64(size)


ITEM = "hash long, width int, kind int, item long, item_id long, item_start int, item_words int, item_slots array<string>"


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of every item. ``item`` tells items, also those without an item_id or that repeat one; equal rows are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Canon()
        for batch in batches:
            for part in blocks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True), 1 << 20):
                rows = []
                for item, item_id, text in part:
                    words, sizes, hashes, types, row = canonical([text], memo)
                    n = len(words)
                    width = min(WIDTH, n)
                    if not width:
                        continue
                    if n < PLAIN:
                        kinds = [(LINE, *line_windows([b" ".join(words)], memo.plain[row], width))]
                    else:
                        found, at = windows(sizes, hashes, types, width, PLAIN)
                        kinds = [(TEMPLATE, found, at), (EXACT, *exact_windows(sizes, memo.plain[row], types, width, PLAIN))]
                        if n == width:  # an item starts like a sentence
                            kinds.append((WHOLE, _keys(Rolling(hashes).windows(width)[at], width, WHOLE), at))
                    for kind, found, at in kinds:
                        slots = _slots(words, types, at, width, kind)
                        rows += [(h, width, kind, item, item_id, a, n, s) for h, a, s in zip(found.view(np.int64).tolist(), at.tolist(), slots, strict=True)]
                columns = list(zip(*rows, strict=True)) or [()] * 8
                types_ = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types_, strict=True)], [f.split()[0] for f in ITEM.split(", ")])

    item_id, text = F.col("item_id").cast("long"), F.col("text").cast("string")
    rows = benchmark.select(F.xxhash64(item_id.isNull(), item_id, text).alias("item"), item_id.alias("item_id"), text.alias("text"))
    return rows.mapInArrow(run, ITEM).dropDuplicates(["item", "item_start", "kind"])


def _bloom(items: DataFrame) -> np.ndarray:
    """The filter's bits; at most BLOOM_MOST / 64 numbers come to the driver."""
    size = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (16 * items.count()).bit_length()))
    both = F.explode(F.array(F.pmod(F.col("hash"), F.lit(size)), F.pmod(F.shiftrightunsigned("hash", 32), F.lit(size)))).alias("bit")
    words = items.select(both).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(bit, 64) as int)))").alias("bits")).toArrow()
    filled = np.zeros(size // 64, np.int64)
    filled[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(filled.view(np.uint8), bitorder="little").astype(bool)


def document_windows(docs: DataFrame, bloom: np.ndarray, widths: list[tuple[int, int]]) -> DataFrame:
    """(hash, width, kind, doc, same, start, slots) of the windows, of the widths and kinds given, that pass the filter."""
    packed = np.packbits(bloom)
    names = ["hash", "width", "kind", "doc", "same", "start", "slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, filled = Canon(), np.unpackbits(packed).astype(bool)
        for batch in slices(batches):
            for part in blocks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True), 1 << 20):
                texts = [t for *_, t in part]
                words, sizes, hashes, types, row = canonical(texts, memo)
                ids, starts = np.array([x[:2] for x in part], np.int64).reshape(-1, 2), np.cumsum(sizes) - sizes
                for width, kind in widths:
                    if kind == TEMPLATE:
                        found, at = windows(sizes, hashes, types, width, PLAIN)
                    elif kind == WHOLE:
                        found, at = whole_windows(sizes, hashes, types, width, PLAIN, (memo.hashes[0, row], memo.types[0, row]))
                    elif kind == LINE:
                        found, at = line_windows(texts, memo.plain[row], width)
                    else:  # however many are plain here: the item decides
                        found, at = exact_windows(sizes, memo.plain[row], types, width, width + 1)
                    a, b = _bits(found, len(filled))
                    keep = filled[a] & filled[b]
                    found, at = found[keep], at[keep]
                    doc = np.searchsorted(starts + sizes, at, side="right")
                    columns = [found.view(np.int64), np.full(len(at), width, np.int32), np.full(len(at), kind, np.int32), ids[doc, 0], ids[doc, 1], (at - starts[doc]).astype(np.int32)]
                    slots = pa.array(_slots(words, types, at, width, kind), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), slots], names)

    rows = docs.select(*row_key(docs), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "hash long, width int, kind int, doc long, same long, start int, slots array<string>")


def agreeing(hits: list[tuple[int, int, list[str], list[str]]]) -> tuple[set[int], int, bool]:
    """(words of the item covered, windows, whether any content differs) on one alignment; hits are item_start, width, the item's slots, the document's.

    A content of the item maps to the one that most windows give it. Windows that disagree with this are left out,
    unless they are verbatim.
    """
    votes: dict[str, Counter[str]] = {}
    pairs = [set(zip(theirs, own, strict=False)) for *_, theirs, own in hits]
    for a, b in (x for p in pairs for x in p):
        votes.setdefault(a, Counter())[b] += 1
    covered: set[int] = set()
    used, differs = 0, False
    chosen = {a: max(v, key=lambda b: (v[b], b == a, b)) for a, v in votes.items()}
    for (start, width, *_), own in zip(hits, pairs, strict=True):
        verbatim = all(a == b for a, b in own)
        if verbatim or all(chosen[a] == b for a, b in own):
            used += 1
            differs |= not verbatim
            covered.update(range(start, start + width))
    return covered, used, differs


def held_items(rows: Iterable[tuple], share: float) -> Iterator[tuple]:
    """(doc, same, item_id, coverage, windows, reparameterised) of pairs, from hits sorted by pair, alignment and place in the item.

    What is held is one alignment (no more hits than the item has windows) and the words covered of one item.
    """
    pair = place = last = None
    hits: list = []
    covered: set[int] = set()
    item_id = n = used = 0
    differs = False
    for row in _ended(rows):
        now = row and row[:3]
        if hits and (now != pair or row[3] != place):
            words, windows_, other = agreeing(hits)
            covered |= words
            used, differs, hits = used + windows_, differs | other, []
        if now != pair:
            if pair and used and len(covered) >= share * n:
                yield (*pair[:2], item_id, len(covered) / n, used, differs)
            pair, covered, used, differs, last = now, set(), 0, False, None
        if row is None:
            return
        _, _, _, place, start, kind, width, item_id, n, theirs, own = row
        if (place, start, kind) != last:  # rows that repeat a document repeat its windows
            hits.append((start, width, theirs, own))
        last = place, start, kind


def _ended(rows: Iterable[tuple]) -> Iterator[tuple | None]:
    yield from rows
    yield None


FOUND = "doc long, same long, item_id long, coverage double, n_windows long, reparameterised boolean"


def _found(docs: DataFrame, benchmark: DataFrame, share: float) -> DataFrame:
    items = settle(benchmark_windows(benchmark), "items")
    widths = sorted((r.width, r.kind) for r in items.select("width", "kind").distinct().collect())
    hits = document_windows(docs, _bloom(items), widths).join(items, ["hash", "width", "kind"])
    order = ["doc", "same", "item", "place", "item_start", "kind"]
    hits = hits.select("doc", "same", "item", (F.col("start") - F.col("item_start")).alias("place"), "item_start", "kind", "width", "item_id", "item_words", "item_slots", "slots")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True))
        out = list(held_items(rows, share))
        columns = list(zip(*out, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in FOUND.split(", ")])

    return spread(hits, "doc", "same", "item").sortWithinPartitions(*order).mapInArrow(run, FOUND)


def _doc_id() -> Column:
    return F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id")


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = COVERED) -> DataFrame:
    """(doc_id, item_id, coverage, n_windows, reparameterised) of the documents that hold a benchmark item.

    An item is held if windows that agree with it, each of its contents mapping to one, cover ``share`` of its
    words or more. Null and empty texts hold nothing and are nowhere held, in documents and in items; empty tables give no rows. Rows and items
    without an id take part like others; texts that share a doc_id are documents of their own; rows equal in both
    count once. Texts are read whole. Other columns are not read, whatever their names.
    """
    return _found(docs, benchmark, share).select(_doc_id(), "item_id", "coverage", "n_windows", "reparameterised")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document."""
    found = _found(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COVERED)
    by = found.groupBy("doc", "same").agg(
        F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"), F.sum("n_windows").alias("n_windows"), F.max("reparameterised").alias("reparameterised")
    )
    return by.select(_doc_id(), "item_ids", "coverage", "n_windows", "reparameterised")


def clean_of_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; columns unchanged, rows without a doc_id judged like others.

    Only the keys of the documents that go are joined: broadcast while they are few (``small``), so texts don't move.
    """
    gone = settle(_found(docs, benchmark, COVERED).select(F.col("doc").alias("__gone_doc"), F.col("same").alias("__gone_same")).distinct(), "held")
    keyed = docs.select("*", *row_key(docs, "__row_doc", "__row_same"))
    return keyed.join(small(gone), (F.col("__row_doc") == F.col("__gone_doc")) & (F.col("__row_same") == F.col("__gone_same")), "left_anti").select(*docs.columns)


QUERIES = {"op4_decontamination": op4_decontamination}
SQL: dict[str, str] = {}
