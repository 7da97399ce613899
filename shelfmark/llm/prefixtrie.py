"""Prefix trie of conversations, counted without building a trie in one place.

A node is a distinct sequence of first turns; the smallest conversation that
passes through a node owns it, so each conversation owns a suffix of its path.
What a subtree saves is then a plain sum over the conversations at its top: the
tokens of the turns of their paths that they do not own.

Turns are dealt out by ranges of (conversation, place), so that a conversation may
be of any length: running sums over its turns are taken within a range, and added
up over its ranges. Whatever is looked up for a conversation is looked up by
(conversation, range), and for a node by (node, block of conversations), so no key
of a join or window holds more than a range or block. Ownership is told by the
least conversation of a node as an aggregate, which adds up map-side, and joined
back by that conversation; a window over the node would hold the root in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACES, materialise, table

#: A base conversation lends its first turns to the FAMILY conversations from it on; each takes crc32 mod HEADS of them.
FAMILY, HEADS = 20, 4
#: Conversations to a block, where those of one node are joined or listed: 2 to this power.
BLOCK_BITS = 12
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
_KEY = ["depth", "a", "b"]


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACES}]+")).cast("long")


def _parts(*what: Column) -> list[Column]:
    """Four hashes of 32 bits; their sums over the turns of a path, with each turn's place in it, tell paths apart."""
    digest = F.md5(F.concat_ws("\x00", *what))
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"s{i}") for i in range(4)]


def _key(sums: list[Column]) -> list[Column]:
    low = [F.pmod(s, F.lit(1 << 32)) for s in sums]
    return [F.shiftleft(low[0], 32).bitwiseOR(low[1]).alias("a"), F.shiftleft(low[2], 32).bitwiseOR(low[3]).alias("b")]


def dealt_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, slot, pos, words, turn_key), written: each turn with its place in its conversation, from 1; slot is its range."""
    own = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "tie"]
    ranges = own.repartitionByRange(*order).withColumn("slot", F.spark_partition_id())
    placed = ranges.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "slot").orderBy(*order[1:])))
    stored = materialise(placed.select("conv_id", "slot", "at", n_words(F.col("text")).alias("words"), F.md5(F.concat(F.md5("role"), F.md5("text"))).alias("turn_key")), "turns")
    before = _before(stored.groupBy("conv_id", "slot").agg(F.count("*").alias("n")), ["n"])
    done = stored.join(before, ["conv_id", "slot"]).withColumn("pos", F.col("at") + F.col("n")).drop("at", "n")
    return materialise(done, "positions", instead_of=stored)


def _before(sums: DataFrame, names: list[str]) -> DataFrame:
    """Sums of (conv_id, slot) replaced by those of the conversation's earlier slots."""
    earlier = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("conv_id", "slot", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names])


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, slot, depth, words, s0 to s3), written, of the rebuilt conversations; slots ascend with depth, and depth 0 has no turn.

    h = crc32(decimal conv_id) mod HEADS. The first h turns are those of conversation
    conv_id - conv_id % FAMILY (all if it has fewer, none if it does not exist); the
    conversation's own turns after its first h follow.
    """
    own = dealt_turns(turns)
    takes = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    heads = own.where(F.col("pos") < HEADS).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "words", "turn_key"))).alias("head"))
    lent = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,words:bigint,turn_key:string>>")), F.lit(1), F.col("takes"))
    each = own.select("conv_id", "slot").distinct().withColumns({"takes": takes, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    # One row for each conversation and range: bounded by a range's conversations, so the own turns find it without a hot key.
    blocks = each.join(heads, "base", "left").select("conv_id", "slot", "takes", lent.alias("lent"))
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("slot"))
    begun = blocks.withColumn("first", first).where("first = 1")
    head = begun.select("conv_id", F.lit(-1).alias("slot"), F.explode("lent").alias("t")).select("conv_id", "slot", F.col("t.pos").alias("depth"), "t.words", "t.turn_key")
    tail = own.join(blocks.select("conv_id", "slot", "takes", F.size("lent").alias("had")), ["conv_id", "slot"]).where("pos > takes")
    tail = tail.select("conv_id", "slot", (F.col("pos") - F.col("takes") + F.col("had")).alias("depth"), "words", "turn_key")
    root = begun.select("conv_id", F.lit(-2).alias("slot"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), *[F.lit(0).cast("long").alias(f"s{i}") for i in range(4)])
    done = head.unionByName(tail).select("conv_id", "slot", "depth", "words", *_parts(F.col("depth").cast("string"), F.col("turn_key"))).unionByName(root)
    return materialise(done, "rebuilt", instead_of=own)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, slot, depth, a, b, pa, pb, upto, words, last), written: each conversation's nodes; a, b and pa, pb name the node and its parent.

    upto is the number of words of the path up to this turn, and last tells whether the conversation ends here.
    """
    sums = [f"s{i}" for i in range(4)] + ["words"]
    rows = rebuilt(turns)
    each = rows.groupBy("conv_id", "slot").agg(*[F.sum(c).alias(c) for c in sums], F.max("depth").alias("deep"))
    ends = each.groupBy("conv_id").agg(F.max("deep").alias("ends"))
    before = _before(each, sums).join(ends, "conv_id").select("conv_id", "slot", "ends", *[F.col(c).alias(f"_{c}") for c in sums])
    within = Window.partitionBy("conv_id", "slot").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({f"r{i}": F.sum(c).over(within) for i, c in enumerate(sums)}).join(before, ["conv_id", "slot"])
    upto = [F.col(f"r{i}") + F.col(f"_{c}") for i, c in enumerate(sums)]
    prior = [u - F.col(c) for u, c in zip(upto, sums)]
    parent = [c.alias(n) for c, n in zip(_key(prior[:4]), ("pa", "pb"))]
    done = run.select("conv_id", "slot", "depth", *_key(upto[:4]), *parent, upto[4].alias("upto"), "words", (F.col("depth") == F.col("ends")).alias("last"))
    return materialise(done, "paths", instead_of=rows)


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes at which conversations end: the hash of their ids, ascending.

    Ids are joined by blocks first; a node's pieces then stream through one task in order, and no list is held.
    """
    block = F.shiftright("conv_id", BLOCK_BITS)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*_KEY, block.alias("block")).agg(listed.alias("ids"))
    dealt = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids"))):
                if key != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*_KEY, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_pydict({**{k: [v] for k, v in zip(_KEY, node)}, "ends_sha256": [digest.hexdigest()]})

    return dealt.select(*_KEY, "ids").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def trie_nodes(turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns has conv_id, turn, role and text; turns are ordered by number (null first),
    then role and text, repeated rows are turns of their own, and a null role or text
    is "". Rows without conv_id are left out. Conversations are rebuilt, see rebuilt();
    one left without turns is a member of the root and ends there. An empty table gives
    no node. saved_tokens is what the subtree's nodes would spare if each turn's words
    were stored once. Texts are hashed and counted whole; other columns are not looked at.
    """
    rows = paths(turns)
    nodes = rows.groupBy(*_KEY).agg(F.min(F.struct("conv_id", (F.col("upto") - F.col("words")).alias("before"))).alias("own"), F.min("last").alias("leaf"))
    nodes = materialise(nodes.select(*_KEY, F.col("own.conv_id").alias("owner"), "own.before", "leaf"), "nodes")
    # Of each conversation: the first depth that it owns, the words above that, and whether it owns a leaf.
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min(F.struct("depth", "before")).alias("first"), F.max("leaf").cast("int").alias("leaf"))
    whole = rows.groupBy("conv_id", "slot").agg(F.max("upto").alias("total"))
    total = whole.groupBy("conv_id").agg(F.max("total").alias("total"))
    facts = total.join(owned, "conv_id", "left").select("conv_id", "first.depth", F.coalesce("first.before", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    known = whole.select("conv_id", "slot").join(facts.withColumnRenamed("depth", "from"), "conv_id")
    seen = rows.join(known, ["conv_id", "slot"])
    unowned = F.col("shared") - (F.col("upto") - F.col("words"))
    child = ~F.col("last") & F.coalesce(F.col("depth") + 1 >= F.col("from"), F.lit(False))
    summed = seen.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.count("*").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(F.greatest(unowned, F.lit(0))).alias("saved_tokens"),
    )
    # Parents: by blocks of children first, so that a node of many children is met once for each block.
    summed = summed.withColumn("block", F.shiftright("conv_id", BLOCK_BITS))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent_conv_id"))
    asked = summed.where("depth > 0").select("depth", "pa", "pb", "block").distinct().join(above, ["depth", "pa", "pb"])
    out = summed.join(asked, ["depth", "pa", "pb", "block"], "left").join(_digests(rows.where("last")), _KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))


def op12_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations."""
    return trie_nodes(table(spark, sf_dir, "conversations"))


PREFIXTRIE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 of the decimal id: its bytes in turn, each by eight steps of the polynomial.
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
        xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
          lambda s, x: list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(s, x)), 4294967295), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
d AS (SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+')) AS words, sha256(list(to_json([role, text])) OVER w::VARCHAR) AS node
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
o AS (SELECT conv_id, 0 AS depth, 0 AS words, '' AS node FROM c UNION ALL SELECT * FROM d),
p AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM o),
n AS (SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(last) AS leaf,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY node),
-- A node lies below those on the path of its owner.
s AS (SELECT p.node, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n.leaf) AS n_leaves FROM p JOIN n ON n.conv_id = p.conv_id AND n.depth >= p.depth GROUP BY p.node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN n q ON q.node = n.parent
"""
