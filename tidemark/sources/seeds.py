"""Deterministic rows for trying a community out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOARDS = ["free", "news", "help"]


def seed_posts(actors: DataFrame, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """id, board, actor, title, created, pinned: a post for each of actors(actor) in their order, an hour apart; the first of each board is pinned.

    Seeds are few: one task numbers them.
    """
    rows = actors.select("actor", (F.row_number().over(Window.orderBy("actor")) - 1).cast("long").alias("id"))
    id_, k = F.col("id"), len(BOARDS)
    board = F.element_at(F.array(*map(F.lit, BOARDS)), (id_ % k + 1).cast("int"))
    created = F.timestamp_add("HOUR", id_, F.lit(start).cast("timestamp_ntz"))
    return rows.select("id", board.alias("board"), "actor", F.concat(board, F.lit(" #"), (id_ / k).cast("long")).alias("title"), created.alias("created"), (id_ < k).alias("pinned"))
