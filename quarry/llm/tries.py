"""Prefix trie of conversations: chained cryptographic digests, one row per prefix, sums over subtrees.

Each turn is hashed where it is read; from there on only digests move. Turns are numbered by ranges, so a
conversation may lie in many tasks. The digest of a prefix is the SHA-256 of the digest before it and of the turn's. Chains are cut into
blocks of BLOCK turns that are hashed side by side; the ends of a conversation's blocks are chained in turn, and
each later prefix is the hash of what precedes its block and of its place in it. So a digest depends on the turns alone. Every
prefix is one row, and rows of one (depth, digest) are a node.

The nodes whose smallest member is one conversation are a chain down to that conversation's end. Sums
over subtrees explode nodes to their ancestors, chain by chain: within a chain they are sums from
below; what a chain adds up to goes to each prefix above its top. So the explosion has at most one
row per prefix, however deep the trie, and is summed up before it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import settle, spread

#: Turns of a conversation that are chained, or summed up, in one go.
BLOCK = 1024
#: The textless prefix.
ROOT = bytes(32)
#: Given turns are fewer than this.
MOST_GIVEN = 9
FAMILY = 5


def sha256(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256))


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written turns (conv, part, id, own, n_bytes), and (conv, part, first, ahead, n): with ``ahead`` turns before, ``part`` has ``n`` from ``first`` on."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = sha256(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), own.alias("own"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "own"]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = settle(ranged.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"), "own", "n_bytes"), "turns")
    spans = ranged.groupBy("conv", "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, settle(spans.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "spans")


def paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, own, n_bytes, ends) of every turn, from depth 1, and (conv, length) of every conversation."""
    turns, spans = numbered_turns(conversations)
    convs = spans.groupBy("conv").agg(F.sum("n").alias("length"))
    placed = turns.join(spans.join(convs, "conv"), ["conv", "part"])
    depth = F.col("id") - F.col("first") + F.col("ahead") + 1
    return placed.select("conv", depth.alias("depth"), "own", "n_bytes", (depth == F.col("length")).alias("ends")), convs


def rebuilt_paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``paths`` of conversations that begin with the first turns of the first of their family, in place of as many of their own.

    The family of c begins with c - c % FAMILY; crc32 of c's decimal digits, modulo MOST_GIVEN, tells how many turns are given.
    """
    turns, spans = numbered_turns(conversations)
    convs = spans.groupBy("conv").agg(F.sum("n").alias("turns"))
    convs = convs.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_GIVEN).withColumn("giver", F.col("conv") - F.col("conv") % FAMILY)
    givers = convs.select(F.col("conv").alias("giver"), F.col("turns").alias("has"))
    given = F.least("h", F.coalesce("has", F.lit(0)))
    convs = convs.join(givers, "giver", "left").select("conv", "h", given.alias("given"), (given + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length"))
    convs = settle(convs, "conversations")

    at = F.col("id") - F.col("first") + F.col("ahead")
    depth = at - F.col("h") + F.col("given") + 1
    tail = turns.join(spans.join(convs, "conv"), ["conv", "part"]).where(at >= F.col("h"))
    tail = tail.select("conv", depth.alias("depth"), "own", "n_bytes", (depth == F.col("length")).alias("ends"))
    # conversations whose remainder is d have the sign of what they are divided by
    low, high = (F.when(side, F.col("conv") + d).otherwise(F.col("conv")) for side, d in ((F.col("conv") <= 0, 1 - FAMILY), (F.col("conv") >= 0, FAMILY - 1)))
    first = turns.where(F.col("conv") % FAMILY == 0).join(spans.where(F.col("ahead") < MOST_GIVEN), ["conv", "part"]).where(at < MOST_GIVEN)
    first = first.select(F.explode(F.sequence(low, high)).alias("conv"), (at + 1).alias("depth"), "own", "n_bytes")
    head = first.join(convs, "conv").where("depth <= h").select("conv", "depth", "own", "n_bytes", (F.col("depth") == F.col("length")).alias("ends"))
    return tail.union(head), convs.select("conv", "length")


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def _chained(rows: DataFrame, keys: list[str], order: str, turn: str) -> DataFrame:
    """``rows`` with up and digest: hashes chained over ``turn`` in each group of ``keys``, before and after the row. Groups are streamed."""
    schema = rows.schema.add("up", "binary").add("digest", "binary")
    at, hashed = [rows.columns.index(k) for k in keys], rows.columns.index(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest = None, ROOT
        for batch in batches:
            ups, digests = [], []
            for key, own in zip(zip(*[batch.column(i).to_pylist() for i in at], strict=True), batch.column(hashed).to_pylist(), strict=True):
                if key != group:
                    group, digest = key, ROOT
                ups.append(digest)
                digest = hashlib.sha256(digest + own).digest()
                digests.append(digest)
            columns = [*batch.columns, _column(ups, pa.binary()), _column(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return spread(rows, *keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def prefixes(rows: DataFrame, deep: bool) -> DataFrame:
    """(conv, depth, up, digest, n_bytes, ends): every prefix of ``paths``, ``up`` being the digest before. ``deep`` where some are longer than BLOCK."""
    block = F.floor((F.col("depth") - 1) / BLOCK).cast("long")
    found = _chained(rows.withColumn("block", block), ["conv", "block"], "depth", "own").drop("own")
    if not deep:
        return settle(found.drop("block"), "prefixes")
    found = settle(found, "block-prefixes")
    ends = _chained(found.where(F.col("depth") % BLOCK == 0).select("conv", "block", F.col("digest").alias("inner")), ["conv"], "block", "inner")
    ends = settle(ends.select("conv", (F.col("block") + 1).alias("block"), F.col("digest").alias("ahead")), "block-ends")
    ahead = F.coalesce("ahead", F.lit(ROOT))
    up = F.when((F.col("depth") - 1) % BLOCK == 0, ahead).otherwise(sha256(ahead, F.col("up")))
    whole = found.join(ends, ["conv", "block"], "left").select("conv", "depth", up.alias("up"), sha256(ahead, F.col("digest")).alias("digest"), "n_bytes", "ends")
    return settle(whole, "prefixes")


def _from_below(nodes: DataFrame, deep: bool) -> DataFrame:
    """``nodes`` with ``own_saved``: what they and the deeper nodes of their chain save."""
    block = F.floor((F.col("depth") - 1) / BLOCK).cast("long")
    nodes = nodes.withColumn("block", block)
    inside = Window.partitionBy("conv", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumn("own_saved", F.sum("saves").over(inside))
    if deep:
        deeper = Window.partitionBy("conv").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
        blocks = nodes.groupBy("conv", "block").agg(F.sum("saves").alias("saves"))
        blocks = blocks.select("conv", "block", F.coalesce(F.sum("saves").over(deeper), F.lit(0)).alias("deeper"))
        nodes = nodes.join(blocks, ["conv", "block"]).withColumn("own_saved", F.col("own_saved") + F.col("deeper")).drop("deeper")
    return nodes.drop("block")


def trie(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie over ``paths``, and its written prefixes.

    A node is (depth, digest, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved): its digest tells it, conv_id is its smallest
    member, parent_conv_id its parent's (null at the root). Without conversations there is no node.
    """
    least, n_convs, longest = convs.agg(F.min("conv"), F.count(F.lit(1)), F.max("length")).first()
    deep = (longest or 0) > BLOCK
    steps = prefixes(rows, deep)
    nodes = steps.groupBy("depth", "digest").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.any_value("up").alias("up"), F.any_value("n_bytes").alias("n_bytes"))
    nodes = settle(nodes.withColumn("saves", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settle(_from_below(nodes.join(children, ["depth", "digest"], "left").fillna(0, ["n_children"]), deep), "nodes")

    leaf = F.max((F.col("n_children") == 0).cast("long"))
    chains = nodes.groupBy("conv").agg(F.min("depth").alias("top"), F.sum("saves").alias("total"), leaf.alias("leaf"))
    chains = settle(chains, "chains")
    above = steps.select("conv", "depth", "digest").join(chains.where("total > 0 or leaf > 0"), "conv").where("depth < top")
    above = above.groupBy("depth", "digest").agg(F.sum("total").alias("other_saved"), F.sum("leaf").alias("other_leaves"))

    # below its chain's top, a node's parent has the same smallest member
    nodes = nodes.join(chains.select("conv", "top", "leaf"), "conv").join(above, ["depth", "digest"], "left")
    n_leaves, saved = (F.col(a) + F.coalesce(b, F.lit(0)) for a, b in (("leaf", "other_leaves"), ("own_saved", "other_saved")))
    nodes = nodes.select("depth", "digest", "up", F.col("conv").alias("conv_id"), "n_convs", "n_children", n_leaves.alias("n_leaves"), saved.alias("saved"), (F.col("depth") == F.col("top")).alias("top"))
    nodes = settle(nodes, "sums")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["depth", "digest", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    inner = nodes.where("not top").withColumn("parent_conv_id", F.col("conv_id"))
    tops = nodes.where("top and depth > 1").join(parents, ["depth", "up"])
    upper = nodes.where("top and depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    # the root has no text: it saves what the chains save together
    sums = chains.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"))
    n_children = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"))
    root = sums.join(F.broadcast(n_children)).select(
        F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(least).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(n_convs).cast("long").alias("n_convs"), "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved",
    )
    return inner.select(*columns).union(tops.select(*columns)).union(upper.select(*columns)).union(root.where("n_convs > 0")), steps


def ends_digests(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of the nodes at which conversations end: SHA-256 of their ids in decimal, ascending, joined by commas.

    Ids are sorted by ranges and written down in pieces of a batch each, so what one task gets of a node is a stream of a few long pieces.
    """
    ended = steps.where("ends").select("depth", "digest", "conv").union(convs.where("length = 0").select(F.lit(0).cast("long"), F.lit(ROOT), "conv"))
    n = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces: list[tuple] = []
            for depth, digest, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not pieces or pieces[-1][:2] != (depth, digest):
                    pieces.append((depth, digest, conv, []))
                pieces[-1][3].append(str(conv))
            depth, digest, first, ids = zip(*pieces, strict=True) if pieces else ((),) * 4
            texts = [",".join(x) for x in ids]
            yield pa.RecordBatch.from_arrays([_column(depth, pa.int64()), _column(digest, pa.binary()), _column(first, pa.int64()), _column(texts, pa.string())], ["depth", "digest", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for depth, digest, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)], strict=True):
                if (depth, digest) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (depth, digest), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _rows(done)
            done = []
        if node:
            yield _rows([(*node, state.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        depth, digest, found = zip(*done, strict=True) if done else ((),) * 3
        return pa.RecordBatch.from_arrays([_column(depth, pa.int64()), _column(digest, pa.binary()), _column(found, pa.string())], ["depth", "digest", "ends_sha256"])

    order = ["depth", "digest", "conv"]
    pieces = ended.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(written, "depth long, digest binary, first long, ids string")
    return spread(pieces, "depth", "digest").sortWithinPartitions("depth", "digest", "first").mapInArrow(hashed, "depth long, digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, rebuilt: bool = False) -> DataFrame:
    """One row per distinct sequence of first turns, the empty one included, as ``trie`` tells, with ends_sha256; ``rebuilt`` as in ``rebuilt_paths``.

    Turns are in order of ``turn``, null first; of equal turns the one with the lesser SHA-256 of role and text comes first, so the order
    of rows doesn't matter; repeated rows are turns of their own. A null role or text counts as an empty one; texts are hashed whole, however
    long. Rows without a conv_id belong to no conversation and are left out. An empty table gives no rows. Other columns are
    not read, whatever their names. Savings are the UTF-8 bytes of the texts that a shared prefix spares.
    """
    rows, convs = (rebuilt_paths if rebuilt else paths)(conversations)
    nodes, steps = trie(rows, convs)
    found = nodes.join(ends_digests(steps, convs), ["depth", "digest"], "left")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def op11_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuilt=True)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


#: CRC-32 of decimal digits, bit by bit, lowest first.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(8 * strlen(conv_id::VARCHAR)),
    lambda i: ((ord((conv_id::VARCHAR)[(i // 8 + 1)::INT])::UBIGINT >> (i % 8)::UBIGINT) & 1::UBIGINT))),
    lambda s, b: xor(s >> 1::UBIGINT, 3988292384::UBIGINT * (xor(s, b) & 1::UBIGINT))), 4294967295::UBIGINT)"""

SQL = {
    "op11_tries": f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), given AS (
  SELECT conv_id, turns, ({_CRC} % {MOST_GIVEN})::BIGINT AS h FROM own
), rebuilt AS (
  SELECT g.conv_id, list_concat(coalesce(d.turns, [])[1:g.h], g.turns[g.h + 1:]) AS turns
  FROM given g LEFT JOIN own d ON d.conv_id = g.conv_id - g.conv_id % {FAMILY}
), steps AS (
  SELECT conv_id, turns, len(turns) AS length, unnest(range(len(turns) + 1)) AS depth FROM rebuilt
), nodes AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends
  FROM steps GROUP BY ALL
), kids AS (
  SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), own_sums AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children,
    CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * strlen(n.path[n.depth].text) ELSE 0 END AS saves
  FROM nodes n LEFT JOIN kids k USING (path, depth)
), up AS (
  SELECT path[1:above] AS path, above AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS above FROM own_sums) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves,
  u.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM own_sums n JOIN up u USING (path, depth)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
}
QUERIES = {"op11_tries": op11_tries}
