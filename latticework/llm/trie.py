"""Prefix trie of conversations, summed over subtrees along heavy paths.

A node is a sequence of first turns; its name is the exclusive or of the hashes of its turns, each
hashed with its place, so names are running aggregates and the parent's name needs no look back. Each node's
heavy child is the one with most conversations. Following heavy children splits the trie into paths, each of which ends
at a childless node, and at most log2 of the conversations of paths lie between any node and the root, as a
light child has at most half of its parent's conversations.

Paths are cut into arrays of at most BLOCK nodes. The paths with most light edges above them are summed first, from the bottom up along
their arrays; the total of each is added to the node that it hangs on, and the paths one light edge nearer to the
root follow. So there are as many rounds as light edges on the longest way, and every node is summed in one of them.

Nothing holds a whole conversation or all members of a node: turns are numbered in ranges of a sorted
table, names and sums run within blocks whose totals are then added, and members are counted before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

BLOCK = 1024
NODE = ["k1", "k2", "depth"]
CHUNK = 1 << 20  # bytes of joined ids in a row


def numbered(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, r, g1, g2, words): the turns of each conversation, numbered from 1 by turn (null first).

    Turns of one number stand in the order of their roles and then of the hashes of their texts. A null role or text is empty, rows without a
    conv_id are left out, repeated rows are turns of their own; other columns are not read. g1, g2 are hashes of role and text.

    The table is sorted by ranges, which also split a conversation; its turns are counted within each range, and what stands in the ranges before
    is added. A border between ranges splits at most one conversation, so the counts to add are fewer than the ranges, and are broadcast.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turns = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("g1"),
        F.xxhash64(F.lit(11), role, text).alias("g2"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "g1", "g2", "row"]
    placed = written(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(before)).where("before > 0")
    within = placed.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    out = within.join(F.broadcast(parts.select("conv_id", "part", "before")), ["conv_id", "part"], "left")
    out = written(out.select("conv_id", (F.col("r") + F.coalesce("before", F.lit(0))).cast("long").alias("r"), "g1", "g2", "words"), "numbered")
    forget(placed)
    return out


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations with the opening of the first of their family: (conv_id, len) of each, and (conv_id, depth, len, g1, g2, words) of each turn.

    Conversation c takes the first h turns (or as many as there are) of c - c % ``family``, which may be absent, and its own turns after its
    first h; h = crc32(c) % ``heads``. ``turns`` comes from ``numbered``.
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.crc32(c.cast("string")) % heads).withColumn("first", c - c % family)
    known = sizes.select(c.alias("first"), F.col("n").alias("there"))
    convs = sizes.join(known, "first", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    convs = written(convs.select("conv_id", "first", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "conversations")
    own = turns.join(convs, "conv_id").where("r > h").select("conv_id", (F.col("r") - F.col("h") + F.col("m")).alias("depth"), "len", "g1", "g2", "words")
    opening = turns.where(F.col("r") < heads).withColumnRenamed("conv_id", "first")
    opening = opening.join(convs, "first").where("r <= m").select("conv_id", F.col("r").alias("depth"), "len", "g1", "g2", "words")
    return convs.select("conv_id", "len"), own.unionByName(opening)


def named(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, len, k1, k2, p1, p2, words): the nodes of each conversation, the root included, with their parents' names."""
    turns = turns.withColumn("x1", F.xxhash64("depth", "g1", "g2")).withColumn("x2", F.xxhash64(F.lit(5), "depth", "g2", "g1")).withColumn("block", F.expr(f"depth div {BLOCK}"))
    run = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = turns.where(F.col("len") >= BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    total = total.select("conv_id", "block", F.bit_xor("t1").over(before).alias("b1"), F.bit_xor("t2").over(before).alias("b2")).where("b1 is not null")
    rows = turns.withColumn("k1", F.bit_xor("x1").over(run)).withColumn("k2", F.bit_xor("x2").over(run)).join(total, ["conv_id", "block"], "left")
    for k in "12":
        rows = rows.withColumn(f"k{k}", F.col(f"k{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0)))).withColumn(f"p{k}", F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), "len", zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("words"))
    return rows.select(roots.columns).unionByName(roots)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of rows (k1, k2, depth, conv_id): the digest of each node's ids, ascending and joined by commas.

    Ids are sorted by ranges, which also split a node, and joined to chunks there. A digest of this kind has to see its bytes one after the other, so the
    chunks of a node are then run through by one task, which holds one of them at a time.
    """
    chunk_type = "k1 bigint, k2 bigint, depth bigint, conv_id bigint, ids binary"

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        name = np.stack([batch.column(c).to_numpy() for c in NODE], 1)
        edge = [0, *(np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1).tolist(), len(name)]
        return ((tuple(name[a].tolist()), a, b) for a, b in zip(edge, edge[1:], strict=False))

    def joined(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, rows = batch.column("conv_id").to_pylist(), []
            for node, a, b in runs(batch):
                for at in range(a, b, CHUNK // 20):
                    part = ids[at : min(b, at + CHUNK // 20)]
                    rows.append((*node, part[0], ",".join(map(str, part)).encode()))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*NODE, "conv_id", "ids"])

    def hashed(batches: Iterator) -> Iterator:
        node, digest = None, None

        def made(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*NODE, "ends_sha256"])

        for batch in batches:
            rows, parts = [], batch.column("ids")
            for now, a, b in runs(batch) if batch.num_rows else ():
                if now != node:
                    if node is not None:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = now, sha256(parts[a].as_py())
                    a += 1
                for k in range(a, b):
                    digest.update(b"," + parts[k].as_py())
            if rows:
                yield made(rows)
        if node is not None:
            yield made([(*node, digest.hexdigest())])

    chunks = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(joined, chunk_type)
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(hashed, "k1 bigint, k2 bigint, depth bigint, ends_sha256 string")


def suffix_sums(batches: Iterator) -> Iterator:
    """For each array of a path: what hangs on its nodes is added, then each node gets the sum of the array from it on."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column("leaves").value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        starts, at = ends - sizes, batch.schema.names.index("leaves")
        hung = batch.column("hung")
        counts = hung.value_lengths().fill_null(0).to_numpy()
        place = hung.flatten().field("place").to_numpy() + np.repeat(starts, counts)
        columns = batch.columns[: batch.num_columns - 1]
        for k, name in enumerate(("leaves", "saved")):
            values = batch.column(name).flatten().to_numpy().copy()
            np.add.at(values, place, hung.flatten().field(name).to_numpy())
            total = np.concatenate([[0], np.cumsum(values)])
            sums = np.repeat(total[ends], sizes) - total[:-1]
            columns[at + k] = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(sums))
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations ``convs`` (conv_id, len) with ``turns`` (conv_id, depth from 1 to len, len, g1, g2, words), as ``rebuilt`` gives them.

    Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest conversation of a node and of
    its parent (null at the root), its conversations, children, childless nodes below it (itself included), the words that all nodes below it spare their
    conversations but one, and the digest of the ids that end at it. Conversations without turns end at the root. Without conversations there is no node.
    """
    rows = written(named(convs, turns), "rows")
    at_end = F.col("depth") == F.col("len")
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = written(nodes, "nodes")
    families = nodes.where("depth > 0").groupBy("p1", "p2", (F.col("depth") - 1).alias("up"))
    families = families.agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"), "k1", "k2")).alias("heavy"))
    families = families.toDF(*NODE, "n_children", "heavy")
    own = nodes.join(families, NODE, "left").join(ends_digest(rows.where(at_end).select(*NODE, "conv_id")), NODE, "left")
    above = own.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    linked = own.drop("heavy").join(above, ["p1", "p2", "depth"], "left")
    light = (F.col("chosen.k1") != F.col("k1")) | (F.col("chosen.k2") != F.col("k2"))
    linked = linked.select(
        *NODE, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce(light, F.lit(False)).alias("light"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    linked = written(linked, "linked")

    # each path ends at a childless node, and is named by that node's smallest conversation
    chains = rows.join(linked.where("n_children = 0").select("conv_id"), "conv_id").select(F.col("conv_id").alias("path"), *NODE, "len")
    turnings = chains.where("depth > 0").join(linked.where("light").select(*NODE), NODE).groupBy("path").agg(F.max("depth").alias("top"), F.count(F.lit(1)).alias("level"))
    on_path = chains.join(turnings, "path", "left").fillna(0, ["top", "level"]).where("depth >= top").select("path", "top", "level", *NODE)
    members = written(on_path.join(linked, NODE), "members")
    one = F.struct("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved", "ends_sha256")
    arrays = members.groupBy("path", "top", "level", F.expr(f"depth div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(one)).alias("nodes"))
    arrays = arrays.select("path", "top", "level", "block", "nodes", F.col("nodes.leaf").alias("leaves"), F.col("nodes.saved").alias("saved"))
    arrays = written(arrays.sortWithinPartitions("level"), "paths")
    held_by = members.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("path").alias("to_path"), F.col("top").alias("to_top"))
    tops = members.where("depth = top and depth > 0").select("path", "level", "depth", "p1", "p2")
    hangs = written(tops.join(held_by, ["p1", "p2", "depth"]).select("path", "level", "to_path", "to_top", (F.col("depth") - 1).alias("to_depth")), "hangs")
    deepest = hangs.agg(F.max("level")).first()[0] or 0
    for t in (rows, nodes, linked, members):
        forget(t)

    below = Window.partitionBy("path").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kind = "array<struct<place: bigint, leaves: bigint, saved: bigint>>"
    hung, done = None, []
    for level in range(deepest, -1, -1):
        part = arrays.where(F.col("level") == level)
        part = part.withColumn("hung", F.lit(None).cast(kind)) if hung is None else part.join(hung, ["path", "block"], "left")
        part = part.select(*arrays.columns, F.coalesce("hung", F.array().cast(kind)).alias("hung"))
        sums = part.mapInArrow(suffix_sums, arrays.schema)
        for c in ("leaves", "saved"):
            sums = sums.withColumn(f"{c}_below", F.coalesce(F.sum(F.col(c)[0]).over(below), F.lit(0)))
        done.append(written(sums, "sums"))
        whole = done[-1].where(F.col("block") == F.expr(f"top div {BLOCK}")).select("path", *[(F.col(c)[0] + F.col(f"{c}_below")).alias(c) for c in ("leaves", "saved")])
        totals = hangs.where(F.col("level") == level).join(whole, "path").groupBy("to_path", "to_top", "to_depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        block = F.expr(f"to_depth div {BLOCK}")
        place = F.col("to_depth") - F.greatest(F.col("to_top"), block * BLOCK)
        hung = totals.groupBy(F.col("to_path").alias("path"), block.alias("block")).agg(F.collect_list(F.struct(place.alias("place"), "leaves", "saved")).alias("hung"))
    each = reduce(DataFrame.unionByName, done).select(F.explode(F.arrays_zip("nodes", "leaves", "saved")).alias("n"), "leaves_below", "saved_below")
    return each.select(
        "n.nodes.conv_id", "n.nodes.depth", "n.nodes.parent_conv_id", "n.nodes.n_convs", "n.nodes.n_children", (F.col("n.leaves") + F.col("leaves_below")).alias("n_leaves"),
        (F.col("n.saved") + F.col("saved_below")).alias("saved_tokens"), "n.nodes.ends_sha256",
    )


#: Names of nodes are lists of turns here, crc32 runs bit by bit, and descendants are met through the smallest conversation of each.
ORACLE = r"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS first FROM t GROUP BY conv_id),
z AS (SELECT *, xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
   lambda x: list_concat([ascii(x)::UBIGINT], list_transform(range(7), lambda y: 0::UBIGINT))))), lambda a, b: xor(xor(a, b) >> 1, 3988292384::UBIGINT * (xor(a, b) & 1::UBIGINT))), 4294967295::UBIGINT) % 4 AS h FROM s),
c AS (SELECT z.*, least(z.h, coalesce(f.n, 0)) AS m FROM z LEFT JOIN s f ON f.conv_id = z.first),
u AS (SELECT c.conv_id, CAST(t.r - c.h + c.m AS BIGINT) AS depth, t.role, t.text FROM t JOIN c USING (conv_id) WHERE t.r > c.h
  UNION ALL SELECT c.conv_id, t.r, t.role, t.text FROM c JOIN t ON t.conv_id = c.first AND t.r <= c.m),
k AS (SELECT conv_id, depth, md5(CAST(list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS VARCHAR)) AS name,
  CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS words FROM u
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
w AS (SELECT *, lag(name) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM k),
n AS (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(up) AS up,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM w GROUP BY depth, name),
f AS (SELECT up AS name, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up, depth),
a AS (SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM n LEFT JOIN f USING (name, depth)),
b AS (SELECT k.depth, k.name, count(*) FILTER (WHERE a.n_children = 0) AS n_leaves, sum((a.n_convs - 1) * a.words) AS saved_tokens
  FROM a JOIN k ON k.conv_id = a.conv_id AND k.depth <= a.depth GROUP BY k.depth, k.name)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM a JOIN b USING (depth, name) LEFT JOIN a p ON p.name = a.up AND p.depth = a.depth - 1"""
