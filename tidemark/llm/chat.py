"""Chat formatting: logged snapshots of a growing conversation are collapsed into it, then conversations are rendered.

Each turn has a digest of its role and text; a rolling digest over them stands for every prefix of a conversation. A
conversation whose whole digest is a shorter prefix of another is a snapshot of it, and an anti-join drops it. Equal
conversations collapse to the smallest conv_id first, so both sides of the anti-join hold each digest once, however many
conversations share a first turn or all turns. All of it is DataFrame expressions.

Turns are ordered by turn, then role (nulls first), then the digest of role and text, so that only digests travel until a
conversation is rendered. A null role or text differs from an empty one in order and digest, and is rendered as empty. Rows with a null conv_id form one conversation of their own. A conversation is one output row,
so its turns must fit in a row; that is the only group that is ever gathered. An empty table has no conversations. Other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"


def _turn_digest(role: Column, text: Column) -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.sha2(c, 256)), F.lit("null"))
    return F.sha2(F.concat(part(role), F.lit(";"), part(text)), 256)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, chain: the rolling digest after each turn."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "digest")))
    rows = turns.select("conv_id", "turn", "role", _turn_digest(F.col("role"), F.col("text")).alias("digest"))
    lists = rows.groupBy("conv_id").agg(ordered.alias("own"))
    chain = F.aggregate("own", F.array().cast("array<string>"), lambda done, t: F.concat(done, F.array(F.sha2(F.concat(F.coalesce(F.element_at(F.when(F.size(done) > 0, done), -1), F.lit("")), t["digest"]), 256))))
    return lists.select("conv_id", chain.alias("chain"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no snapshot of another; of equal ones the smallest conv_id."""
    chains = common.settle(prefixes(turns), "chat-chains")
    whole = chains.groupBy(F.element_at("chain", -1).alias("digest")).agg(F.min_by("conv_id", F.coalesce("conv_id", F.lit(-(2**63)))).alias("conv_id"), F.max(F.size("chain")).alias("n_turns"), F.count("*").alias("n_equal"))
    shorter = chains.select(F.explode(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("digest")).distinct()
    return whole.join(shorter, "digest", "left_anti").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_equal").cast("long").alias("n_equal"))


def render(turns: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """conv_id and text: each turn between marks. A mark inside a text is broken by a space after its first character."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(start), F.lit(f"{start[0]} {start[1:]}")), F.lit(end), F.lit(f"{end[0]} {end[1:]}"))
    line = lambda t: F.concat(F.lit(start), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(f"{end}\n"))
    tie = F.struct("turn", "role", _turn_digest(F.col("role"), F.col("text")).alias("digest"), "text")
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(tie)).alias("own"))
    return lists.select("conv_id", F.array_join(F.transform("own", line), "").alias("text"))


def format_chats(turns: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """conv_id, n_turns, n_equal (equal conversations it stands for, itself included) and text of maximal conversations."""
    turns = turns.select("conv_id", "turn", "role", "text")
    kept = maximal(turns).withColumnRenamed("conv_id", "kept_id")
    own = turns.join(kept.select("kept_id"), F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return render(own, start, end).join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).select("conv_id", "n_turns", "n_equal", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(common.read(spark, sf_dir, "conversations"))


SQL = r"""
WITH d AS (
  SELECT *, sha256(coalesce('=' || sha256(role), 'null') || ';' || coalesce('=' || sha256(text), 'null')) AS digest FROM conversations),
c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, digest) AS ts,
         string_agg('<|im_start|>' || replace(replace(coalesce(role, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
           || replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, digest) AS text
  FROM d GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, ts, count(*) AS n_equal, any_value(text) AS text FROM c GROUP BY ts)
SELECT a.conv_id, CAST(len(a.ts) AS BIGINT) AS n_turns, CAST(a.n_equal AS BIGINT) AS n_equal, a.text
FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE len(b.ts) > len(a.ts) AND b.ts[1 : len(a.ts)] = a.ts)
"""

QUERY = ("op5_chat_format", query, SQL)
