"""MinHash near-duplicates: an inverted join on signature coordinates, with counted collisions and exact sets.

The set of a text's shingles has a signature of COORDINATES least hashes. Sets of the wanted similarity agree in ``least_matches``
coordinates, but for a probability below MISSED. Documents are posted under coordinate-value pairs. As in prefix filtering, a document whose pairs are put
in order of rarity needs posting under its first COORDINATES - least_matches + 1 only, of which those that nobody shares are
skipped: documents that agree often enough meet under one of these. Collisions are counted on a byte of each coordinate, packed into four longs.

Meeting documents are not paired one by one. First each is held against the most central document of its list; what passes is
verified on the whole sets and linked. Only in lists that are still of several classes are pairs of different classes looked
at: in lists of up to LISTED documents as rows, in longer ones in tasks on blocks of bounded bytes that yield a spanning forest.
So all documents are connected that are linked by pairs which agree in enough coordinates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LAST, Rolling, blocks, documents, hashed_words, mixed, row_key, settle, slices, small, text_bytes
from quarry.llm.components import components

SHINGLE, PERCENT = 3, 85
COORDINATES, MISSED = 32, 1e-7
LISTED, BLOCK_BYTES = 64, 8 << 20
_FACTORS = np.random.default_rng(20261128).integers(0, 1 << 63, (2, COORDINATES), np.uint64) * np.uint64(2) + np.uint64(1)
_PACKED = [f"s{i}" for i in range(COORDINATES // 8)]


def least_matches(percent: int) -> int:
    """The most coordinates in which all but MISSED of the pairs of that similarity agree."""
    p, below = percent / 100, 0.0
    for t in range(COORDINATES):
        below += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if below > MISSED:
            return max(1, t)
    return COORDINATES


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; fewer words are one shingle, no words none."""
    out = []
    for words in hashed_words([t.lower() for t in texts]):
        width = min(shingle, len(words))
        out.append(np.unique(mixed(Rolling(words).windows(width) + np.uint64(width))) if width else np.zeros(0, np.uint64))
    return out


def _node(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes())


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The coordinate-value pairs of each of the sets, none of which is empty, as hashes."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    found = np.zeros((len(sets), COORDINATES), np.uint64)
    for k, (a, b) in enumerate(_FACTORS.T):
        found[:, k] = mixed(np.minimum.reduceat(joined * a + b, starts) + np.uint64(k))
    return found


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """doc, same and text of rows, in blocks of about a megabyte."""
    for batch in slices(batches):
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True)
        for part in blocks(rows, 1 << 20):
            doc, same, texts = zip(*part, strict=True)
            yield np.array(doc, np.int64), np.array(same, np.int64), list(texts)


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(*row_key(docs), F.col("text").cast("string").alias("text"))


def marked(rows: DataFrame, shingle: int, **more: Callable[[bytes], int]) -> DataFrame:
    """(doc, same, node, n, tokens, s0 to s3) of ``keyed_texts``: a hash of the whole set, its size, its coordinate-value pairs and a byte of each.

    ``more`` adds columns of 64 bits that are made of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, same, texts in _parts(batches):
            sets = shingle_sets(texts, shingle)
            n = np.array([len(s) for s in sets], np.int64)
            found = np.zeros((len(sets), COORDINATES), np.uint64)
            if n.any():
                found[n > 0] = signatures([s for s in sets if len(s)])
            tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(COORDINATES * (n > 0))], pa.int32()), pa.array(found[n > 0].view(np.int64).ravel()))
            packed = np.ascontiguousarray(found.astype(np.uint8)).view(np.int64)
            nodes = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
            others = [np.array([f(t) for t in texts], np.uint64).view(np.int64) for f in more.values()]
            columns = [*map(pa.array, (doc, same, nodes, n)), tokens, *map(pa.array, [*np.ascontiguousarray(packed.T), *others])]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "same", "node", "n", "tokens", *_PACKED, *more])

    return rows.mapInArrow(run, "doc long, same long, node long, n long, tokens array<long>, " + ", ".join(f"{s} long" for s in [*_PACKED, *more]))


def nodes_of(marks: DataFrame) -> DataFrame:
    """Written distinct sets of ``marked``: node, first (doc, same), n, tokens, s0 to s3."""
    first = F.min(F.struct("doc", "same")).alias("first")
    return settle(marks.groupBy("node").agg(first, *[F.any_value(c).alias(c) for c in ("n", "tokens", *_PACKED)]), "sets-found")


def _matches(a: str, b: str) -> Column:
    """Coordinates in which the packed signatures agree, as columns of ``a`` and ``b``."""
    differ = []
    for s in _PACKED:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        differ.append(F.bit_count(x))
    return F.lit(COORDINATES) - reduce(add, differ)


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether sizes allow the similarity, and enough coordinates agree."""
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & (_matches(a, b) >= least_matches(percent))


def postings(nodes: DataFrame, percent: int) -> DataFrame:
    """Written lists with two members at least: (token, node, score, members, n, s0 to s3). ``score``: how often a set shares its coordinates."""
    tokens = nodes.select("node", F.explode("tokens").alias("token"))
    # counts are written before they are joined, so that the join can be broadcast or its large partitions split
    often = small(settle(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1"), "tokens-often"))
    shared = tokens.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("seen", "token"))).alias("all"), F.sum(F.log2("seen")).alias("score"))
    # tokens that nobody shares come first in each order
    prefix = F.slice("all", 1, F.greatest(F.size("all") - least_matches(percent) + 1, F.lit(0)))
    held = shared.select("node", "score", prefix.alias("prefix")).where(F.size("prefix") > 0).join(nodes.drop("tokens", "first"), "node")
    lists = settle(held.select(F.explode("prefix.token").alias("token"), "node", "score", "n", *_PACKED), "postings")
    crowded = small(settle(lists.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "crowded"))
    return settle(lists.join(crowded, "token"), "postings")


def sets_of(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Written (node, hashes) of the ``wanted`` sets. Texts are not moved while the keys of these are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _parts(batches):
            sets = shingle_sets(texts, shingle)
            found = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    asked = small(settle(nodes.join(wanted.distinct(), "node", "left_semi").select("first.doc", "first.same"), "sets-asked"))
    found = rows.join(asked, ["doc", "same"], "left_semi").mapInArrow(run, "node long, hashes binary")
    return settle(found.dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose whole sets have ``percent`` of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    one, other = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_hashes")) for c in "uv")
    return pairs.join(one, "u").join(other, "v").select("u", "v", "u_hashes", "v_hashes").mapInArrow(run, "u long, v long")


def _pairs(joined: DataFrame, a: str, b: str) -> DataFrame:
    return joined.select(F.greatest(f"{a}.node", f"{b}.node").alias("u"), F.least(f"{a}.node", f"{b}.node").alias("v")).distinct()


def forest(sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Links that connect what sets of similarity ``percent`` connect beyond equal labels; with ``cross`` only sets of different sides are compared."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    kinds, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(kinds), bool)
    left, edges = np.arange(len(sets)), []
    while len(left):
        own = labels[left] == labels[left[0]]
        frontier, left = left[own].tolist(), left[~own]
        while frontier and len(left):
            u = frontier.pop()
            can = left[side[left] != side[u]] if cross else left
            can = can[100 * np.minimum(sizes[can], sizes[u]) >= percent * np.maximum(sizes[can], sizes[u])]
            if not len(can):
                continue
            held = ids[starts[u] : starts[u] + sizes[u]]
            mark[held] = True
            if 4 * len(can) > len(sets):
                common = np.add.reduceat(mark[ids], starts, dtype=np.int64)[can]
            else:
                common = np.array([np.count_nonzero(mark[ids[starts[v] : starts[v] + sizes[v]]]) for v in can])
            mark[held] = False
            hit = can[100 * common >= percent * (sizes[u] + sizes[can] - common)]
            edges += [(u, v) for v in hit.tolist()]
            joined = np.isin(labels[left], labels[hit])
            frontier += left[joined].tolist()
            left = left[~joined]
    return edges


def _blocks(lists: DataFrame, sets: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links between classes in long lists: each pair of blocks of a list is a task."""
    count = F.ceil(F.col("bytes") / block_bytes)
    block = F.when(count > 1, F.pmod(F.xxhash64("node", F.lit("block")), count)).otherwise(F.lit(0)).cast("long")
    dealt = (
        lists.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))))
        .select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label")
        .select(F.xxhash64("token", "i", "j").alias("task"), (F.col("i") != F.col("j")).alias("cross"), "block", "node", "label")
    )

    def run(table: pa.Table) -> pa.Table:
        nodes, labels, side = (table.column(c).to_numpy() for c in ("node", "label", "block"))
        sets_ = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        found = forest(sets_, labels, side, table.column("cross")[0].as_py(), percent)
        u, v = (nodes[list(x)] for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return dealt.join(sets, "node").groupBy("task").applyInArrow(run, "u long, v long")


def links(rows: DataFrame, nodes: DataFrame, shingle: int, percent: int, listed: int = LISTED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(u, v) with u > v, written: enough links between distinct sets to connect all that are alike to ``percent``."""
    lists = postings(nodes, percent)
    centre = settle(lists.groupBy("token").agg(F.max(F.struct("score", "node", "n", *_PACKED)).alias("centre")), "centres")
    met = lists.alias("a").join(centre, "token").where(F.col("a.node") != F.col("centre.node"))
    stars = settle(_pairs(met.where(_alike("a", "centre", percent)), "a", "centre"), "stars")
    ends = lambda pairs: pairs.select(F.col("u").alias("node")).union(pairs.select("v"))
    linked = settle(verified(stars, sets_of(rows, nodes, ends(stars), shingle), percent), "star-links")

    roots = components(linked).withColumnRenamed("node", "linked")
    longer = lists.where("members > 2")
    labelled = longer.join(roots, longer.node == roots.linked, "left").drop("linked").withColumn("label", F.coalesce("root", "node")).drop("root")
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"same{i}") for i in range(2)]
    several = labelled.groupBy("token", "members").agg(F.min("label").alias("one"), F.max("label").alias("other"), F.sum(8 * F.col("n")).alias("bytes"), *same).where("one <> other")
    # lists with the same members are one
    several = several.groupBy("members", "same0", "same1").agg(F.min(F.struct("token", "bytes")).alias("list")).select("list.*")
    left = settle(labelled.join(several, "token"), "lists-left")
    if not left.take(1):
        return linked
    few, many = left.where(F.col("members") <= listed), left.where(F.col("members") > listed)
    pairs = few.alias("a").join(few.alias("b"), "token").where((F.col("a.node") > F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & _alike("a", "b", percent))
    pairs = settle(_pairs(pairs, "a", "b").join(stars, ["u", "v"], "left_anti"), "pairs-left")
    sets = sets_of(rows, nodes, ends(pairs).union(many.select("node")), shingle)
    return settle(linked.union(verified(pairs, sets, percent)).union(_blocks(many, sets, percent, block_bytes)).distinct(), "links")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, listed: int = LISTED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of the set of shingles, and the smallest doc_id reachable over sets alike to ``percent``.

    A-Z are lower-cased, words split at white space; fewer words than ``shingle`` are one shingle. Null and empty texts and such without words have the
    empty set and are linked with nothing; long texts are taken whole; an empty table gives no rows. Equal sets are one, told by a hash of 64 bits. Every
    row is reported, those that repeat a doc_id too; rows without a doc_id take part, and name a component only
    among themselves (null). Columns other than doc_id and text are not read, whatever their names.
    """
    rows = keyed_texts(docs)
    marks = settle(marked(rows, shingle), "signatures")
    nodes = nodes_of(marks)
    roots = components(links(rows, nodes, shingle, percent, listed, block_bytes)).withColumnRenamed("node", "linked")
    labelled = nodes.join(roots, nodes.node == roots.linked, "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    heads = labelled.groupBy("root").agg(F.min("first.doc").alias("head"))
    heads = settle(labelled.join(heads, "root").select("node", "head"), "heads")
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    found = marks.where("n > 0").join(heads, "node").select(known("doc").alias("doc_id"), F.col("n").alias("n_shingles"), known("head").alias("component_id"))
    return found.union(marks.where("n = 0").select(known("doc"), "n", known("doc")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = {
    "op12_minhash": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, least(len(w), 1) + 1))) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), near AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sizes UNION SELECT r.u, n.v FROM reach r JOIN near n ON n.u = r.v
), least AS (
  SELECT u, min(v) AS v FROM reach GROUP BY 1
)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.v, w.doc_id) AS component_id, w.doc_id = coalesce(l.v, w.doc_id) AS kept
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.u = w.doc_id
"""
}
QUERIES = {"op12_minhash": op12_minhash}
