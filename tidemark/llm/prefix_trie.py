"""Conversation prefix trie: every distinct beginning of conversations is a node, with what lies below it.

Turns get a rolling digest along their conversation, cut into blocks of `block` turns. Conversations are grouped by the digests
at block ends first: a block that many share is one group from there on. Only where the groups that continue one beginning
differ (siblings, or a conversation that ends earlier) are their turns looked at one by one and grouped again; a block without
siblings is a chain whose nodes all have the group's members.

What lies below a node needs no walk down the trie, as it is a sum over the node's members. Let a node's owner be its smallest
member, which then owns all of its own nodes from there to its end. With T the bytes of a conversation's turns, W those of the
nodes it owns, S = T - W, and P the bytes before the node: each member's bytes from the node on, less the bytes of nodes
below it counted once, are saved, which makes sum of S, less the owner's S, less (members - 1) * P. The leaves below a node are as many
as its members that own a leaf. So one pass finds owners, hence W, and a second one sums S and leaves over members.

Turns are ordered by turn (null first), then role and text, null counting as empty; rows that repeat are turns of their own. Rows with a
null conv_id take no part. An empty table gives an empty result, without a root. Columns beside conv_id, turn, role and text, whatever
their names, aren't read. A conversation's turns pass through one task one after another, as do the ids of all conversations that end at one node: their
digest is one string's. Neither is ever held; Spark's sort spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK = 4
#: The digest of the beginning without turns.
ROOT = bytes(16)
#: Conversations c - c % FAMILY to that + FAMILY - 1 begin with the first one's turns; crc32 of the id modulo SHARED tells how many.
FAMILY, SHARED = 5, 9
_BLOCKS = "conv long, parent binary, end binary, depth long, turns array<struct<node: binary, bytes: long, before: long>>"
_TURN = pa.struct([("node", pa.binary()), ("bytes", pa.int64()), ("before", pa.int64())])


def numbered(turns: DataFrame) -> DataFrame:
    """conv, pos (from 1), role and text of the turns of conversations(conv_id, turn, role, text)."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    pos = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return rows.select("conv", pos.cast("long").alias("pos"), "role", "text")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, role, text of every rebuilt turn; conv of every conversation). The second is a written table.

    Conversation c begins with the first h turns of c - c % family and goes on with its own turns after its first h.
    """
    rows = numbered(turns)
    base = F.col("conv") - F.col("conv") % family
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    sizes = rows.groupBy("conv").agg(F.count("*").alias("size")).withColumns({"base": base, "h": heads})
    convs = common.settle(sizes.join(sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size")), "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("lent")), "conversations")
    own = rows.withColumn("h", heads).where("pos > h").join(convs.select("conv", "lent"), "conv").select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), "role", "text")
    lent = rows.where((F.col("pos") < shared) & (F.col("conv") == base)).join(convs.select(F.col("conv").alias("to"), F.col("base").alias("conv"), "lent"), "conv").where("pos <= lent")
    return own.unionByName(lent.select(F.col("to").alias("conv"), F.col("pos").alias("depth"), "role", "text")), convs.select("conv")


def blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block of each conversation of turns(conv, depth, role, text): the digest before it (parent), the digest after it
    (end), the depth before it, and for each turn the digest up to it, its text's bytes and the bytes before it. A written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda *parts: hashlib.blake2b(b"".join(parts), digest_size=16).digest()
        conv, node, before, depth, parent, held = None, ROOT, 0, 0, ROOT, []
        out: list[tuple] = []
        for batch in common.slices(batches, "text"):
            columns = (batch.column(k) for k in range(batch.num_columns))
            for c, _, role, text in zip(*(x.to_pylist() for x in columns), strict=True):
                if held and (c != conv or len(held) == block):
                    out.append((conv, parent, node, depth - len(held), held))
                    parent, held = node, []
                if c != conv:
                    conv, node, before, depth, parent = c, ROOT, 0, 0, ROOT
                text = text.encode("utf-8", "surrogatepass")
                node = digest(node, digest(role.encode("utf-8", "surrogatepass")), digest(text))
                held.append((node, len(text), before))
                before, depth = before + len(text), depth + 1
            yield from _block_rows(out)
            out = []
        if held:
            yield from _block_rows([(conv, parent, node, depth - len(held), held)])

    dealt = turns.select("conv", "depth", "role", "text").repartition(common.tasks(turns), "conv").sortWithinPartitions("conv", "depth")
    return common.settle(common.in_arrow(dealt, work, _BLOCKS), "blocks")


def _block_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        conv, parent, end, depth, turns = zip(*rows, strict=True)
        turns = [[dict(zip(("node", "bytes", "before"), t, strict=True)) for t in x] for x in turns]
        arrays = [pa.array(conv, pa.int64()), pa.array(parent, pa.binary()), pa.array(end, pa.binary()), pa.array(depth, pa.int64()), pa.array(turns, pa.list_(_TURN))]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv", "parent", "end", "depth", "turns"])


def _refined(groups: DataFrame, sums: list[str]) -> DataFrame:
    """Nodes of groups(parent, depth, turns, alone, conv, n and `sums`): turns of groups with siblings are grouped once more."""
    turn = F.posexplode("turns").alias("k", "turn")
    flat = groups.select("alone", "conv", "n", *sums, F.col("depth"), F.col("parent").alias("block_parent"), "turns", turn)
    nodes = flat.select(
        "alone", "conv", "n", *sums, F.col("turn.node").alias("node"), (F.col("depth") + F.col("k") + 1).alias("depth"),
        F.when(F.col("k") == 0, F.col("block_parent")).otherwise(F.get("turns", F.col("k") - 1)["node"]).alias("parent"),
        F.col("turn.bytes").alias("bytes"), F.col("turn.before").alias("before"),
    )
    same = [F.min(c).alias(c) for c in ("depth", "parent", "bytes", "before")]
    split = nodes.where("not alone").groupBy("node").agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums), *same)
    return nodes.where("alone").drop("alone").unionByName(split)


def nodes(cut: DataFrame, convs: DataFrame) -> DataFrame:
    """node, parent, depth, conv_id, n_convs, bytes, before, unshared (sum of S over members, owner left out), n_leaves; the root included."""
    by_block = cut.groupBy("parent", "end").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.any_value("depth").alias("depth"), F.any_value("turns").alias("turns"))
    fan = cut.groupBy("parent").agg((F.min("end") == F.max("end")).alias("alone"))
    groups = common.settle(by_block.join(fan, "parent"), "groups")
    found = common.settle(_refined(groups, []), "nodes")
    # What each conversation owns, and who owns a leaf.
    total = cut.groupBy("conv").agg(F.sum(F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["bytes"])).alias("total"))
    owned = found.groupBy("conv").agg(F.sum("bytes").alias("owned"))
    leaves = found.join(found.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    shared = F.coalesce("total", F.lit(0)) - F.coalesce("owned", F.lit(0))
    values = common.settle(convs.join(total, "conv", "left").join(owned, "conv", "left").join(leaves, "conv", "left").select("conv", shared.alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "values")
    sums = cut.select("conv", "end").join(values, "conv").groupBy("end").agg(F.sum("shared").alias("shared"), F.sum("leaf").alias("leaf"))
    below = _refined(groups.join(sums, "end"), ["shared", "leaf"]).select("node", "shared", "leaf")
    owner = values.select("conv", F.col("shared").alias("owner_shared"))
    inner = found.join(below, "node").join(owner, "conv").select("node", "parent", "depth", F.col("conv").alias("conv_id"), F.col("n").alias("n_convs"), "bytes", "before", (F.col("shared") - F.col("owner_shared")).alias("unshared"), F.col("leaf").alias("n_leaves"))
    root = values.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("shared").alias("unshared"), F.sum("leaf").alias("n_leaves")).where("n_convs > 0")
    none = F.lit(0).cast("long")
    # The smallest conversation of all owns what it has: its own S is 0. Where no conversation has turns, the root is the leaf.
    root = root.select(F.lit(bytearray(ROOT)).alias("node"), F.lit(None).cast("binary").alias("parent"), none.alias("depth"), "conv_id", "n_convs", none.alias("bytes"), none.alias("before"), "unshared", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"))
    return inner.unionByName(root)


def ends(cut: DataFrame, convs: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of the ascending ids of the conversations that end there. A sorted stream, one id at a time."""
    last = cut.groupBy("conv").agg(F.max_by("end", "depth").alias("node"))
    rows = convs.join(last, "conv", "left").select(F.coalesce("node", F.lit(bytearray(ROOT))).alias("node"), "conv")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != node:
                    done += [(node, digest.hexdigest())] if digest else []
                    node, digest = own, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            yield _end_rows(done)
        if digest:
            yield _end_rows([(node, digest.hexdigest())])

    dealt = rows.repartition(common.tasks(rows), "node").sortWithinPartitions("node", "conv")
    return common.in_arrow(dealt, work, "node binary, ends_sha256 string")


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])


def trie(cut: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of blocks(), with parent_conv_id, n_children, n_leaves, saved_tokens and ends_sha256."""
    found = common.settle(nodes(cut, convs), "trie-nodes")
    children = found.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = found.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    saved = F.col("unshared") - (F.col("n_convs") - 1) * F.col("before")
    return (
        found.join(above, "parent", "left").join(children, "node", "left").join(ends(cut, convs), "node", "left")
        .select(
            "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves",
            saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def prefix_trie(turns: DataFrame, family: int = FAMILY, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations of turns(conv_id, turn, role, text)."""
    rows, convs = rebuilt(turns, family, shared)
    return trie(blocks(rows, block), convs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(common.read(spark, sf_dir, "conversations")).drop("node", "parent")


SQL = f"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({{'r': role, 't': text}} ORDER BY p) AS ts, {common.crc32_sql("c::VARCHAR")} % 9 AS h FROM o GROUP BY c),
r AS (SELECT l.c, list_concat(coalesce(b.ts, [])[1 : l.h], l.ts[l.h + 1 :]) AS ts FROM l LEFT JOIN l b ON b.c = l.c - l.c % 5),
m AS (SELECT c, d, len(ts) AS n, sha256(to_json(ts[1 : d])) AS node, CASE WHEN d > 0 THEN sha256(to_json(ts[1 : d - 1])) END AS parent, coalesce(octet_length(encode(ts[d].t)), 0) AS bytes
      FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM r)),
v AS (SELECT node, any_value(parent) AS parent, any_value(d) AS depth, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM v GROUP BY parent),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (node)),
above AS (SELECT m.node AS under, a.node FROM m JOIN m a ON a.c = m.c AND a.d <= m.d GROUP BY m.node, a.node),
s AS (SELECT above.node, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved FROM above JOIN w u ON u.node = above.under GROUP BY above.node)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s USING (node) LEFT JOIN v p ON p.node = w.parent
"""

QUERY = ("op11_prefix_trie", query, SQL)
