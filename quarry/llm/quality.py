"""Line-first quality rules: clean each line, then reject documents that lose too much text.

A line is boilerplate by a fixed phrase, or because it recurs over the corpus between ever different neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Rolling, documents, hashed_words, settle, slices, text_bytes

#: Share of a document's word characters that lines failing a rule may hold. Recurring lines are removed but not counted:
#: where they recur is a weaker sign, so a document goes for them only if nothing else is left.
MOST_LOST = 0.5
#: Repetition: words in repeated windows of WINDOW words, as a percentage of all words.
WINDOW, MOST_REPEATED, LEAST_WORDS = 5, 20, 10
SYMBOLS = b"#*$%&|<>"
#: Fixed phrases that mark boilerplate lines, lower case, in four languages. Only ASCII letters, which all readers lower alike.
BOILERPLATE = (
    b"all rights reserved", b"accept cookies", b"cookie policy", b"privacy policy", b"terms of service",
    b"terms of use", b"enable javascript", b"subscribe to our newsletter", b"click here", b"sign up for",
    b"lorem ipsum", b"powered by wordpress", b"share on facebook", b"follow us on",
    b"alle rechte vorbehalten", b"cookies akzeptieren", b"cookie-richtlinie", b"datenschutzhinweis", b"nutzungsbedingungen",
    b"javascript aktivieren", b"newsletter abonnieren", b"hier klicken", b"jetzt registrieren", b"auf facebook teilen", b"folgen sie uns",
    b"tous droits", b"accepter les cookies", b"politique de confidentialit", b"activer javascript",
    b"abonnez-vous", b"cliquez ici", b"inscrivez-vous", b"partager sur facebook", b"suivez-nous",
    b"todos los derechos reservados", b"aceptar cookies", b"aviso legal", b"aviso de privacidad", b"condiciones de uso",
    b"active javascript", b"habilitar javascript", b"haga clic", b"haz clic", b"compartir en facebook",
)
#: Fixed words of navigation bars, lower case, in four languages.
NAVIGATION = frozenset(
    b"home about contact login logout menu search next previous back top sitemap faq help register "
    b"startseite kontakt impressum anmelden abmelden suche hilfe registrieren warenkorb "
    b"accueil connexion recherche suivant retour aide inscription panier "
    b"inicio contacto buscar siguiente anterior ayuda registro carrito".split()
)
#: Words of a line that may be boilerplate by recurrence, and words of each neighbour that make its surroundings.
SHORT, BESIDE = (3, 25), 3
#: A recurring line has as many different surroundings, at least, and one for every two documents that hold it ...
SURROUNDINGS = 20
#: ... and one for this many short lines of the corpus, so no corpus has more than SHARE recurring lines.
SHARE = 20_000
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000"
_SHAPE = bytes.maketrans(_UPPER, _LOWER)
_BOILER = re.compile(b"|".join(map(re.escape, BOILERPLATE)))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def line_fails(line: bytes) -> str | None:
    """The rule that a line fails, or None. Lines without a word fail nothing.

    symbols: one marking symbol for every two words, or more. navigation: half of the words, or more,
    stand between bars or are words of navigation bars. boilerplate: a fixed phrase in a short line.
    punctuation: half of the words, or more, end in the same two exclamation or question marks or dots.
    """
    words = line.split()
    if not words:
        return None
    n = len(words)
    if 2 * sum(line.count(bytes((s,))) for s in b"#*$%&<>") >= n:
        return "symbols"
    if line.count(b"|") * 3 >= n:
        return "navigation"
    if n <= 12 and 2 * sum(w.lower().strip(b".,:;|/") in NAVIGATION for w in words) > n:
        return "navigation"
    if n <= 25 and _BOILER.search(line.lower()):
        return "boilerplate"
    if n >= 3 and 2 * sum(w.endswith((b"!!", b"??", b"...")) for w in words) >= n:
        return "punctuation"
    return None


def template(words: list[bytes]) -> int:
    """A hash of a line's words, whatever their case (A-Z) and digits."""
    return xxhash.xxh3_64_intdigest(b" ".join(words).translate(_SHAPE)) - (1 << 63)


def short_lines(text: bytes) -> dict[int, int]:
    """The short lines of a text that pass the rules: template and a hash of the surroundings of the first one of it.

    Surroundings are the last words of the line before and the first words of the line after, blank lines left
    out; a text of one line has none.
    """
    lines = [(line, own) for line in text.split(b"\n") if (own := line.split())]
    found: dict[int, int] = {}
    for i, (line, own) in enumerate(lines):
        if len(lines) > 1 and SHORT[0] <= len(own) <= SHORT[1] and not line_fails(line) and (key := template(own)) not in found:
            before = lines[i - 1][1][-BESIDE:] if i else []
            after = lines[i + 1][1][:BESIDE] if i + 1 < len(lines) else []
            found[key] = xxhash.xxh3_64_intdigest(b" ".join(before) + b"\n" + b" ".join(after)) - (1 << 63)
    return found


def recurring(docs: DataFrame) -> frozenset[int]:
    """Templates of the lines that are boilerplate by recurrence: SHARE at most, by the rule that finds them.

    Copies of a document, near ones too, keep a line's surroundings, so their lines don't count as recurring; nor do the lines
    inside of a passage that many documents share. Each row counts a line once. Lines are summed by surroundings before they
    are summed by template, so a line that a third of all rows hold makes no large task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [x for t in text_bytes(batch.column(0)) for x in short_lines(t).items()]
            columns = [*([x[k] for x in found] + [None] for k in (0, 1)), [1] * len(found) + [len(found)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["line", "beside", "n"])

    lines = docs.select(F.col("text").cast("string")).mapInArrow(run, "line long, beside long, n long")
    both = lines.groupBy("line", "beside").agg(F.sum("n").alias("n"))
    each = both.groupBy("line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ways"))
    often = settle(each.where(f"line IS NULL OR (ways >= {SURROUNDINGS} AND 2 * ways >= n)"), "recurring")
    total = often.where("line IS NULL").agg(F.sum("n")).first()[0] or 0
    found = often.where("line IS NOT NULL").where(F.col("ways") * SHARE >= F.lit(total)).select("line")
    return frozenset(found.toArrow().column(0).to_pylist())


def judge(text: bytes, hashes: np.ndarray, most_lost: float = MOST_LOST, often: frozenset[int] = frozenset()) -> dict:
    """Base figures, cleaned text and verdict of one document; ``hashes`` are those of its words, ``often`` the templates of recurring lines."""
    words = text.split()
    data = np.frombuffer(text, np.uint8)
    seen: set[bytes] = set()
    dup, lost, left, lines = 0, 0, 0, []
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
        if line_fails(line):
            lost += sum(map(len, own))
        elif not (often and SHORT[0] <= len(own) <= SHORT[1] and template(own) in often):
            left += len(own)
            lines.append(line)
    n, repeated = len(words), 0
    if n >= WINDOW:
        _, place, count = np.unique(Rolling(hashes).windows(WINDOW), return_inverse=True, return_counts=True)
        covered = np.zeros(n + 1, np.int32)
        starts = np.flatnonzero(count[place] > 1)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + WINDOW, -1)
        repeated = int((np.cumsum(covered) > 0).sum())
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    chars = sum(map(len, words))
    return {
        "n_words": n,
        "word_chars": int((~_SPACE[data] & ((data & 0xC0) != 0x80)).sum()),
        "n_symbols": int(_SYMBOL[data].sum()),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
        "base_failed": failed,
        "kept": not failed and lost <= most_lost * chars and left > 0,
        "n_lines_removed": text.count(b"\n") + 1 - len(lines),
        "cleaned": b"\n".join(lines),
    }


def judged(texts: list[bytes], most_lost: float, often: frozenset[int] = frozenset()) -> list[dict]:
    return [judge(t, h, most_lost, often) for t, h in zip(texts, hashed_words(texts), strict=True)]


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, cleaned string"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def quality(docs: DataFrame, most_lost: float = MOST_LOST, cleaned: bool = True) -> DataFrame:
    """One row per document: doc_id, base figures, verdict and the text without its failing lines.

    A null text has no words and fails the base rules; its cleaned text is empty. Texts are read twice: once for the lines
    that recur over all rows, then each row is judged by itself, whole however long, so repeated rows and null ids need no rule; an empty table
    gives no rows. Other columns are not read, whatever their names.
    """
    often = recurring(docs)
    fields = [f.split() for f in FIELDS.split(", ") if cleaned or not f.startswith("cleaned")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = judged(text_bytes(batch.column(1)), most_lost, often)
            columns = [pa.array([x[k] for x in found], pa.binary()).cast(pa.string()) if k == "cleaned" else pa.array([x[k] for x in found], _TYPES[t]) for k, t in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *[k for k, _ in fields]])

    schema = "doc_id long, " + ", ".join(" ".join(f) for f in fields)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), cleaned=False).drop("n_lines_removed")


def clean_documents(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """The documents that pass, with their failing lines removed; columns as they were.

    ``n_chars``, where there is one, is counted anew. Lines that recur are found first; the verdict is then made row by row.
    """
    often = recurring(docs)
    names = docs.columns
    body = docs.schema["text"].dataType.simpleString()
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = judged(text_bytes(batch.column(place)), most_lost, often)
            texts = pa.array([x["cleaned"] for x in found], pa.binary()).cast(pa.string())
            out = batch.set_column(place, "text", texts).filter(pa.array([x["kept"] for x in found], pa.bool_()))
            yield out

    cast = docs.withColumn("text", F.col("text").cast("string"))
    kept = cast.mapInArrow(run, cast.schema).withColumn("text", F.col("text").cast(body))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*names)


QUERIES = {"op3_quality": op3_quality}
_W = r"[^\x20\x09-\x0D]+"
_PHRASES = "|".join(p.decode() for p in BOILERPLATE)
_NAV = "|".join(sorted(w.decode() for w in NAVIGATION))
SQL = {
    "op3_quality": rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_W}') AS ws, string_split(text, chr(10)) AS ls FROM t),
lines AS (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM w),
worded AS (SELECT *, regexp_extract_all(line, '{_W}') AS lw FROM lines),
ruled AS (
  SELECT r, line, i, lw, len(lw) AS n, list_sum(list_transform(lw, lambda x: strlen(x))) AS chars,
    len(lw) > 0 AND (
      2 * len(regexp_extract_all(line, '[#*$%&<>]')) >= len(lw)
      OR 3 * len(regexp_extract_all(line, '[|]')) >= len(lw)
      OR (len(lw) <= 12 AND 2 * len(list_filter(lw, lambda x: regexp_full_match(lower(x), '[.,:;|/]*({_NAV})[.,:;|/]*'))) > len(lw))
      OR (len(lw) <= 25 AND regexp_matches(lower(line), '{_PHRASES}'))
      OR (len(lw) >= 3 AND 2 * len(list_filter(lw, lambda x: regexp_matches(x, '(!!|\?\?|\.\.\.)$'))) >= len(lw))) AS ruled_out,
    len(lw) > 0 AND row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS dup,
    translate(array_to_string(lw, ' '), '{_UPPER.decode()}', '{_LOWER.decode()}') AS template
  FROM worded),
beside AS (
  SELECT r, i, template, n, ruled_out, count(*) OVER (PARTITION BY r) AS n_lines,
    (coalesce(array_to_string((lag(lw) OVER ordered)[-{BESIDE}:], ' '), ''), coalesce(array_to_string((lead(lw) OVER ordered)[1:{BESIDE}], ' '), '')) AS around
  FROM ruled WHERE n > 0 WINDOW ordered AS (PARTITION BY r ORDER BY i)),
short_ones AS (
  SELECT r, template, arg_min(around, i) AS around FROM beside
  WHERE n_lines > 1 AND n BETWEEN {SHORT[0]} AND {SHORT[1]} AND NOT ruled_out GROUP BY r, template),
often AS (
  SELECT template FROM short_ones GROUP BY template
  HAVING count(DISTINCT around) >= {SURROUNDINGS} AND 2 * count(DISTINCT around) >= count(*)
    AND {SHARE} * count(DISTINCT around) >= (SELECT count(*) FROM short_ones)),
judged AS (
  SELECT *, ruled_out OR (n BETWEEN {SHORT[0]} AND {SHORT[1]} AND template IN (SELECT template FROM often)) AS fails FROM ruled),
per_line AS (
  SELECT r, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(chars) FILTER (ruled_out), 0) AS lost, coalesce(sum(chars) FILTER (NOT fails), 0) AS remaining, coalesce(sum(chars), 0) AS chars
  FROM judged GROUP BY r),
windows AS (
  SELECT r, i, array_to_string(ws[i + 1 : i + {WINDOW}], ' ') AS win
  FROM (SELECT r, ws, unnest(range(len(ws) - {WINDOW} + 1)) AS i FROM w WHERE len(ws) >= {WINDOW})),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, win) AS c FROM windows) WHERE c > 1),
repeats AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY r),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, lost, remaining, chars
  FROM w JOIN per_line USING (r) LEFT JOIN repeats USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND lost <= {MOST_LOST} * chars AND remaining > 0 AS kept
FROM base
"""
}
