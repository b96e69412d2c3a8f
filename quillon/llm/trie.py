"""Prefix trie of conversations that share their first turns: its nodes, their sizes and sums over their subtrees.

Each conversation's turns become a chain of prefix digests (each of the one before and the turn), every prefix a row, and
rows of equal (depth, digest) are one node. A node stands on the path of each of its members, so a member's prefixes are
the node's ancestors: what a node adds to its subtree sums is exploded to all of them along the path of its smallest
member. Contributions of one path meet on it before they are shuffled (a running sum), so a conversation of n turns sends
n rows and not n * n / 2.

Texts are shuffled once, to put turns in order; everything later carries digests. Chains and digests of member lists are
streamed over sorted rows, one state at a time: no conversation and no list of members is held in memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.storage import drop, written

#: Bytes kept of each SHA-256 prefix digest: 128 bits, so that no two prefixes of any corpus are likely to meet.
DIGEST = 16
#: Conversation ids in one string of the member lists.
BLOCK = 4096
ROOT = hashlib.sha256(b"").digest()[:DIGEST]


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_no, digest, bytes): turns numbered from 1 by turn (null first), then role, then text.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out. digest is that of
    (role, text), bytes the text's length in UTF-8.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("turn_no", F.row_number().over(order).cast("long")).select("conv_id", "turn_no", F.unhex(F.substring(F.sha2(said, 256), 1, 2 * DIGEST)).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its five: crc32 of its decimal id, modulo 9."""
    return F.crc32(conv_id.cast("string")) % 9


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, bytes, length) of turn_digests() after rebuilding, and a row of depth 0 for each conversation.

    A conversation c starts with the first shared_turns(c) turns of conversation c - c % 5 (all if it has fewer, none if
    there is none); its own turns after its first so many follow. length counts the rebuilt turns.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    convs = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).withColumn("shared", shared_turns(F.col("conv_id")))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("shared", F.coalesce("base_size", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("size") - F.col("shared"), F.lit(0)))
    starts = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"), "length")
    first = turns.where((F.col("turn_no") < 9) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "base")
    taken = convs.select("conv_id", "base", "taken", "length").join(first, "base").where("turn_no <= taken").select("conv_id", F.col("turn_no").alias("depth"), "digest", "bytes", "length")
    own = turns.join(convs.select("conv_id", "shared", "taken", "length"), "conv_id").where("turn_no > shared")
    own = own.select("conv_id", (F.col("taken") + F.col("turn_no") - F.col("shared")).alias("depth"), "digest", "bytes", "length")
    return starts.unionByName(taken).unionByName(own)


def prefixes(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, bytes, ends): every prefix of each conversation, its digest chained from the one before.

    sequences has a row of depth 0 for each conversation. ends says that the conversation is no longer than the prefix.
    """
    ordered = sequences.repartition("conv_id").sortWithinPartitions("conv_id", "depth")

    def run(batches):
        node = ROOT
        for batch in batches:
            nodes, parents = [], []
            for depth, digest in zip(batch.column("depth").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                parent, node = (None, ROOT) if depth == 0 else (node, hashlib.sha256(node + digest).digest()[:DIGEST])
                nodes.append(node)
                parents.append(parent)
            ends = np.asarray(batch.column("depth")) == np.asarray(batch.column("length"))
            columns = [batch.column("conv_id"), batch.column("depth"), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), batch.column("bytes"), pa.array(ends)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "node", "parent", "bytes", "ends"])

    return ordered.mapInArrow(run, "conv_id long, depth long, node binary, parent binary, bytes long, ends boolean")


def member_digests(members: DataFrame, key: str = "node", value: str = "conv_id") -> DataFrame:
    """(key, ends_sha256): SHA-256 of each key's values in decimal, ascending, joined by commas.

    Values go through strings of neighbouring values, at most BLOCK in each, and a digest is fed one string after the
    other, in order, so a key with a third of all rows needs no memory for its list.
    """
    block = F.floor(F.col(value) / BLOCK)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(value)), lambda v: v.cast("string")), ",")
    blocks = members.groupBy(key, block.alias("block")).agg(listed.alias("ids"))
    ordered = blocks.repartition(key).sortWithinPartitions(key, "block")
    schema = T.StructType([members.schema[key], T.StructField("ends_sha256", T.StringType())])

    def run(batches):
        now, digest, kind = None, None, schema_arrow
        for batch in batches:
            keys, done = [], []
            for k, ids in zip(batch.column(key).to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if digest is None or k != now:
                    if digest is not None:
                        keys.append(now)
                        done.append(digest.hexdigest())
                    now, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(done)], names=[key, "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], names=[key, "ends_sha256"])

    schema_arrow = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[members.schema[key].dataType.simpleString()]
    return ordered.mapInArrow(run, schema)


def trie(paths: DataFrame) -> DataFrame:
    """One row per node of prefixes(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the node's smallest member; saved_tokens adds (n_convs - 1) * bytes over the subtree, n_leaves its childless
    nodes. The smallest member of a node is that of all nodes below it on its path, so each conversation owns one run of
    nodes, from some depth to its end. A node's sum is that of its members' own runs, less what its own run holds above it.
    """
    nodes = paths.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.max("bytes").alias("bytes"), F.max("parent").alias("parent"))
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    nodes = nodes.select("depth", "node", "conv_id", "n_convs", "parent", leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    nodes = written(nodes, "trie-nodes")
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above")
    placed = nodes.select("depth", "node", "conv_id", "n_convs", "parent", earlier("leaf"), earlier("saved"))
    runs = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    sums = paths.select("conv_id", "node").join(runs, "conv_id").groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    ends = member_digests(paths.where("ends"))
    parents = nodes.join(children.select("node"), "node", "left_semi").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = placed.join(sums, "node").join(children, "node", "left").join(ends, "node", "left").join(parents, "parent", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        (F.col("leaves") - F.col("leaf_above")).alias("n_leaves"), (F.col("saved") - F.col("saved_above")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; an empty table has no conversation and no node. Other columns are ignored."""
    turns = written(turn_digests(conversations), "turns")
    paths = written(prefixes(rebuilt(turns)), "prefixes")
    drop(conversations.sparkSession, turns.scratch_path)
    return trie(paths)


ORACLE = r"""
WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i)),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT s.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h FROM s, crc),
c AS (SELECT h.conv_id, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS m, h.n FROM h LEFT JOIN s b ON b.conv_id = h.base),
r AS (SELECT conv_id, 0 AS depth, '' AS one, 0 AS bytes FROM c
  UNION ALL SELECT c.conv_id, pos, md5(strlen(role) || ':' || role || text), strlen(text) FROM c JOIN t ON t.conv_id = c.base AND pos <= m
  UNION ALL SELECT c.conv_id, m + pos - h, md5(strlen(role) || ':' || role || text), strlen(text) FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (SELECT conv_id, depth, bytes, string_agg(one, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS key, max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM r),
n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM p GROUP BY 1, 2),
k AS (SELECT left(key, 32 * (depth - 1)) AS key, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
a AS (SELECT n.key, n.depth, unnest(range(n.depth + 1)) AS d, (n.n_convs - 1) * n.bytes AS saved, (k.key IS NULL)::INT AS leaf FROM n LEFT JOIN k ON k.key = n.key AND k.depth = n.depth),
z AS (SELECT left(key, 32 * d) AS key, d AS depth, sum(saved) AS saved, sum(leaf) AS leaves FROM a GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, z.leaves::BIGINT AS n_leaves, z.saved::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM n JOIN z ON z.key = n.key AND z.depth = n.depth LEFT JOIN k ON k.key = n.key AND k.depth = n.depth LEFT JOIN n u ON u.depth = n.depth - 1 AND u.key = left(n.key, 32 * (n.depth - 1))
"""
