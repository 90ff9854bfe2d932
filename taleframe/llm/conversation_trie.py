"""A trie of conversation prefixes, built family by family and merged by node.

A family is what shares a base id.  Families are cogrouped with the first turns of their bases, rebuilt, and each
becomes a small trie; nodes of all families meet once, by a 128-bit key of the prefix.  A key is the exclusive or of one
random value a turn, which depends on the turn's role, text and depth, so a long conversation can be cut into blocks that
are keyed apart and joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taleframe.llm.common import read, stage

#: A family is conv_id - conv_id % FAMILY; a rebuilt conversation takes fewer than HEADS turns from its base.
FAMILY, HEADS = 5, 9
#: Turns of a conversation that one task holds at once.
BLOCK = 4096
#: Bases 2^8 apart at most are cogrouped in one call, ids 2^12 apart are hashed as one piece of text.
NEAR_BASES, NEAR_IDS = 8, 12
SALTS = 64
KEY = ["a", "b"]
_BUILT = "kind int, gid long, block long, a long, b long, up_a long, up_b long, depth long, members array<long>, bytes long, total long"


def _numbered(rows: DataFrame) -> DataFrame:
    """gid, base, conv_id, i (from 1, in the order of turns), h, x, y (digests of role and text) and bytes.

    Texts are range-sorted, so a conversation of any length is spread; what crosses the edge of a part is counted part by part.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.where("conv_id is not null").select("conv_id", base.alias("base"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.repartitionByRange("base", "conv_id", "turn", F.left("role", F.lit(64))).sortWithinPartitions("base", "conv_id", "turn", "role", "text")
    rows = rows.select(
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("k"), "base", "conv_id",
        F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit("second"), "text", "role").alias("y"), F.octet_length("text").cast("long").alias("bytes"),
    )
    rows = stage(rows, "turns")
    ahead = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", ahead.alias("before"))
    crossing = F.broadcast(before.where("before is not null"))  # at most one conversation a part
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("k"))
    rows = rows.withColumn("i", inside).join(crossing, ["conv_id", "part"], "left")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    return rows.select(F.shiftright("base", NEAR_BASES).alias("gid"), "base", "conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), h.alias("h"), "x", "y", "bytes")


def _mixed(digest: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """A random value for a turn's digest at a depth (rounds of a public 64-bit mixer)."""
    z = digest.astype(np.uint64) ^ (depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def _running(op: np.ufunc, values: np.ndarray, first: np.ndarray, undo: np.ufunc) -> np.ndarray:
    """``op`` accumulated anew in each run; ``first`` has the place of a row's run's first row."""
    if not len(values):
        return values
    done = op.accumulate(values)
    return undo(done, np.where(first > 0, done[first - 1], 0).astype(values.dtype))


def _build(turns: pa.Table, heads: pa.Table) -> pa.Table:
    """The tries of some families (kind 0, a row for each node) and what each conversation adds up to (kind 1)."""
    col = {n: np.array(turns.column(n)) for n in ("base", "conv_id", "i", "h", "x", "y", "bytes", "block")}
    if not len(col["i"]):
        return pa.table([pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)
    gid, block = turns.column("gid")[0].as_py(), int(col["block"][0])
    order = np.argsort(np.array(heads.column("base")), kind="stable")
    of, head = np.array(heads.column("base"))[order], {n: np.array(heads.column(n))[order] for n in ("i", "x", "y", "bytes")}
    conv, one = np.unique(col["conv_id"], return_index=True)
    base, h = col["base"][one], col["h"][one]
    begin = np.searchsorted(of, base)
    taken = np.minimum(h, np.searchsorted(of, base, side="right") - begin)
    who = np.searchsorted(conv, col["conv_id"])
    own = col["i"] > h[who]
    depth, who, parts = (col["i"] - h[who] + taken[who])[own], who[own], {n: col[n][own] for n in ("x", "y", "bytes")}
    if block == 0:
        copied = np.repeat(np.arange(len(conv)), taken)
        nth = np.arange(len(copied)) - np.repeat(np.cumsum(taken) - taken, taken)
        turn = np.zeros(int(heads.num_rows), dtype=np.int64)
        turn[np.searchsorted(of, of) + head["i"] - 1] = np.arange(len(of))  # heads of a base by their number
        source = turn[np.repeat(begin, taken) + nth] if len(copied) else np.zeros(0, dtype=np.int64)
        depth, who = np.r_[nth + 1, depth], np.r_[copied, who]
        parts = {n: np.r_[head[n][source], parts[n]] for n in parts}
    order = np.lexsort((depth, who))
    depth, who, parts = depth[order], who[order], {n: v[order] for n, v in parts.items()}
    first = np.searchsorted(who, who)
    z = [_mixed(parts[n], depth) for n in ("x", "y")]
    key = [_running(np.bitwise_xor, v, first, np.bitwise_xor) for v in z]
    total = _running(np.add, parts["bytes"], first, np.subtract)
    up = [k ^ v for k, v in zip(key, z, strict=True)]
    last = np.searchsorted(who, np.arange(len(conv)), side="right") - 1
    some = (last >= 0) & (who[last] == np.arange(len(conv))) if len(who) else np.zeros(len(conv), dtype=bool)
    ends = [np.where(some, v[np.maximum(last, 0)], 0) if len(v) else np.zeros(len(conv), dtype=np.int64) for v in (*key, depth, total)]
    if block == 0:  # every conversation passes the root
        none = np.zeros(len(conv), dtype=np.int64)
        who, depth = np.r_[np.arange(len(conv)), who], np.r_[none, depth]
        key, up, total, size = [np.r_[none.astype(np.uint64), k] for k in key], [np.r_[none.astype(np.uint64), k] for k in up], np.r_[none, total], np.r_[none, parts["bytes"]]
    else:
        size = parts["bytes"]
    family = base[who]
    order = np.lexsort((who, depth, key[1], key[0], family))
    same = [v[order] for v in (family, key[0], key[1], depth)]
    new = np.r_[True, np.any([v[1:] != v[:-1] for v in same], axis=0)] if len(order) else np.zeros(0, dtype=bool)
    at = order[new]
    members = pa.ListArray.from_arrays(pa.array(np.r_[np.flatnonzero(new), len(order)].astype(np.int32)), pa.array(conv[who[order]]))
    n, m = len(at), len(conv)
    signed = lambda v: v.astype(np.uint64).view(np.int64)
    tries = [[0] * n, [gid] * n, [block] * n, *(signed(v[at]) for v in (*key, *up)), depth[at], members, size[at], total[at]]
    sums = [[1] * m, [gid] * m, [block] * m, signed(ends[0]), signed(ends[1]), [0] * m, [0] * m, ends[2], pa.array([[c] for c in conv.tolist()], pa.list_(pa.int64())), [0] * m, ends[3]]
    return pa.concat_tables(pa.table([pa.array(c).cast(f.type) for c, f in zip(part, _SCHEMA, strict=True)], schema=_SCHEMA) for part in (tries, sums))


_LONGS = ("a", "b", "up_a", "up_b", "depth")
_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("gid", pa.int64()), ("block", pa.int64()), *((n, pa.int64()) for n in _LONGS), ("members", pa.list_(pa.int64())), ("bytes", pa.int64()), ("total", pa.int64())]
)


def family_tries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of every family (gid, block, key, parent's key, depth, members, bytes of the last text and of all) and
    conversations, a row for each of their blocks (gid, block, conv_id, a, b, depth, total)."""
    turns = stage(_numbered(rows), "numbered").withColumn("block", F.floor((F.col("i") - 1) / BLOCK).cast("long"))
    heads = turns.where(F.col("conv_id") == F.col("base")).where(F.col("i") < HEADS).select(*[F.col(c).alias(c) for c in ("gid", "base", "i", "x", "y", "bytes")])
    # later blocks need only the number of turns of a head, which the same rows tell
    blocks = turns.where("block > 0").select("gid", "base", "block").distinct()
    heads = heads.withColumn("block", F.lit(0).cast("long")).unionByName(heads.join(blocks, ["gid", "base"]).select("gid", "base", "i", "x", "y", "bytes", "block"))
    built = stage(turns.groupBy("gid", "block").cogroup(heads.groupBy("gid", "block")).applyInArrow(_build, _BUILT), "families")
    nodes, sums = built.where("kind = 0").drop("kind"), built.where("kind = 1").select("gid", "block", F.col("members")[0].alias("conv_id"), *KEY, "depth", "total")
    later = nodes.where("block > 0")
    if later.isEmpty():
        return nodes, sums
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("block", "conv_id", F.expr("bit_xor(a)").over(ahead).alias("more_a"), F.expr("bit_xor(b)").over(ahead).alias("more_b"), F.sum("total").over(ahead).alias("more"))
    joined = later.withColumn("conv_id", F.explode("members")).join(carried, ["block", "conv_id"])  # each conversation of a later block has its own row
    xor = lambda c, more: F.col(c).bitwiseXOR(F.col(more)).alias(c)
    whole = joined.select(
        "gid", "block", xor("a", "more_a"), xor("b", "more_b"), xor("up_a", "more_a"), xor("up_b", "more_b"), "depth", F.array("conv_id").alias("members"), "bytes", (F.col("total") + F.col("more")).alias("total"),
    )
    return nodes.where("block = 0").unionByName(whole), sums


_SUMS = "a long, b long, saved long, leaves long"


def _subtree(nodes: pa.Table, owned: pa.Table) -> pa.Table:
    """What a family adds to the sums over the subtrees of its nodes.

    A conversation owns the nodes of which it is the smallest member, from some depth on.  Bytes saved below a node are those
    of members' turns down to where they begin to own; a childless node counts at its owner.
    """
    conv, order = np.array(owned.column("conv_id")), np.argsort(np.array(owned.column("conv_id")))
    until, leaf = np.array(owned.column("until"))[order], np.array(owned.column("leaf").cast(pa.int64()))[order]
    members = nodes.column("members").combine_chunks()
    node = np.array(members.value_parent_indices())
    who = np.searchsorted(conv[order], np.array(members.flatten()))
    above = (np.array(nodes.column("total")) - np.array(nodes.column("bytes")))[node]
    saved, leaves = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
    np.add.at(saved, node, np.maximum(until[who] - above, 0))
    np.add.at(leaves, node, leaf[who])
    return pa.table([nodes.column("a"), nodes.column("b"), saved, leaves], ["a", "b", "saved", "leaves"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and sha of runs of equal keys, whose pieces of text come in order."""
    key, sha = None, None
    for b in batches:
        done: list[tuple] = []
        for *here, ids in zip(*(b.column(n).to_pylist() for n in ("a", "b", "ids")), strict=True):
            if here != key:
                if sha is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = here, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield _digest_rows(done)
    if sha is not None:
        yield _digest_rows([(*key, sha.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "sha"])


def end_digests(ends: DataFrame) -> DataFrame:
    """a, b, sha: SHA-256 of the ascending, comma-joined ids of the conversations (a, b, conv_id) that end at each node.

    Ids near each other become one piece of text first; only pieces go to the task that hashes a node's, one after the other.
    """
    pieces = ends.groupBy(*KEY, F.shiftright("conv_id", NEAR_IDS).alias("near")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select(*KEY, "near", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "near").select(*KEY, "ids").mapInArrow(_digests, "a long, b long, sha string")


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (rows with conv_id, turn, role and text).

    Turns come by turn, role and text, nulls first; null roles and texts are empty; repeated rows are turns of their own; rows
    without conv_id belong to no conversation and are left out; texts are read whole; other columns are ignored; an empty table
    gives an empty result, without a root.  A conversation of any length is spread over ranges and blocks; nodes that many
    conversations share are added up inside families and tasks first, and children meet hot parents in salted groups.
    """
    nodes, sums = family_tries(rows)
    each = nodes.withColumn("conv_id", F.array_min("members")).withColumn("n", F.size("members").cast("long"))
    merged = each.groupBy(*KEY).agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("up_a", "up_b", "depth", "bytes", "total")])
    merged = stage(merged.withColumn("salt", F.pmod("a", F.lit(SALTS))), "nodes")
    up = [F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    groups = stage(merged.where("depth > 0").groupBy(*up, "salt").agg(F.count("*").alias("n")), "children")
    children = groups.groupBy(*KEY).agg(F.sum("n").alias("n_children"))
    merged = stage(merged.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    owned = merged.groupBy("conv_id").agg(F.min_by(F.col("total") - F.col("bytes"), "depth").alias("until"), F.max(F.col("n_children") == 0).alias("leaf"))
    lengths = sums.groupBy("conv_id").agg(F.sum("total").alias("whole"), *[F.expr(f"bit_xor({k})").alias(k) for k in KEY])
    known = lengths.join(owned, "conv_id", "left").select("conv_id", *KEY, F.coalesce("until", "whole").alias("until"), F.coalesce("leaf", F.lit(False)).alias("leaf"))
    known = stage(known, "owners")
    placed = sums.select(*[F.col(c).alias(c) for c in ("gid", "block", "conv_id")]).join(known.drop(*KEY), "conv_id")
    below = nodes.groupBy("gid", "block").cogroup(placed.groupBy("gid", "block")).applyInArrow(_subtree, _SUMS)
    below = below.groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    parents = groups.join(merged.select(*KEY, F.col("conv_id").alias("parent_conv_id")), KEY).select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), "salt", "parent_conv_id")
    out = merged.join(below, KEY).join(end_digests(known), KEY, "left").join(parents, ["up_a", "up_b", "salt"], "left")
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with the first turns of its family's base; see ``conversation_trie`` for edge cases."""
    return conversation_trie(read(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id FROM turns),
sums AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::bigint) ELSE x >> 1 END)) AS crc
  FROM convs),
heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(crc, 4294967295::bigint) % 9 AS h FROM sums),
rebuilt AS (
  SELECT heads.conv_id, 0 AS own, i, role, text FROM heads JOIN turns ON turns.conv_id = base AND i <= h
  UNION ALL SELECT heads.conv_id, 1, i, role, text FROM heads JOIN turns ON turns.conv_id = heads.conv_id AND i > h),
rows AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lasts AS (SELECT conv_id, max(depth) AS last FROM rows GROUP BY conv_id),
nodes AS (
  SELECT path, depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256
  FROM rows JOIN lasts USING (conv_id) GROUP BY path, depth),
linked AS (
  SELECT nodes.*, up.path AS up_path, up_nodes.conv_id AS parent_conv_id
  FROM nodes LEFT JOIN rows up ON up.conv_id = nodes.conv_id AND up.depth = nodes.depth - 1
  LEFT JOIN nodes up_nodes ON up_nodes.path = up.path AND up_nodes.depth = up.depth),
children AS (SELECT up_path AS path, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY up_path),
below AS (
  SELECT above.path, above.depth, count(*) FILTER (children.path IS NULL) AS n_leaves, sum((nodes.n - 1) * nodes.bytes) AS saved
  FROM nodes LEFT JOIN children USING (path) JOIN rows above ON above.conv_id = nodes.conv_id AND above.depth <= nodes.depth
  GROUP BY above.path, above.depth)
SELECT conv_id, depth::bigint AS depth, parent_conv_id, n::bigint AS n_convs, coalesce(n_children, 0)::bigint AS n_children,
       n_leaves::bigint AS n_leaves, saved::bigint AS saved_tokens, ends_sha256
FROM linked LEFT JOIN children USING (path) JOIN below USING (path, depth)
"""
