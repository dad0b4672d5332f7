"""Operators on posts, votes, ledgers, limits and threads. Column roles are arguments; every order ends in an id."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import reply_parent
from ..sources.tables import settled


def top_points(ledger: DataFrame, k: int, since: Column | None = None) -> DataFrame:
    """rank, actor, points of the k actors with most points; ties by actor."""
    own = ledger if since is None else ledger.where(F.col("ts") >= since)
    best = own.groupBy("actor").agg(F.sum("delta").alias("points")).orderBy(F.desc("points"), "actor").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("points"), "actor")).cast("long").alias("rank"), "actor", "points")


#: Actor ids that share a sorting task within one points value.
BLOCK = 65_536
#: Points values that share a sorting task.
LEVEL = 1_024


def rank_of(ledger: DataFrame, actors: DataFrame, since: Column | None = None, block: int = BLOCK) -> DataFrame:
    """actor, points, rank of each of actors(actor, a number): 1 + those with more points, or as many and a smaller id.

    Asked actors without a ledger row have 0 points and are not counted for others. A rank is the sum of three counts: actors of
    higher points values (those of higher levels of 1,024 values, and those in the own level), actors of the same value in
    earlier blocks of ids, and actors before it in its own block. So a value that a third of all actors share is sorted block by block, and so are the values.
    """
    own = ledger if since is None else ledger.where(F.col("ts") >= since)
    points = own.groupBy("actor").agg(F.sum("delta").alias("points"), F.lit(1).alias("counts"))
    asked = actors.select("actor").distinct().withColumn("asked", F.lit(True))
    rows = points.join(asked, "actor", "full_outer").select(
        "actor", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("counts", F.lit(0)).alias("counts"), F.coalesce("asked", F.lit(False)).alias("asked"), F.floor(F.col("actor") / block).alias("block")
    )
    until_before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("points", "block").agg(F.sum("counts").alias("n"))
    earlier = F.coalesce(F.sum("n").over(until_before(Window.partitionBy("points").orderBy("block"))), F.lit(0))
    values = blocks.groupBy("points", F.floor(F.col("points") / LEVEL).alias("level")).agg(F.sum("n").alias("n"))
    levels = values.groupBy("level").agg(F.sum("n").alias("n"))
    higher = F.coalesce(F.sum("n").over(until_before(Window.orderBy(F.desc("level")))), F.lit(0))  # a row a level
    inner = F.coalesce(F.sum("n").over(until_before(Window.partitionBy("level").orderBy(F.desc("points")))), F.lit(0))
    above = values.withColumn("inner", inner).join(levels.select("level", higher.alias("higher")), "level").select("points", (F.col("higher") + F.col("inner")).alias("above"))
    before = blocks.withColumn("earlier", earlier).join(above, "points").select("points", "block", (F.col("above") + F.col("earlier")).alias("before"))
    within = F.coalesce(F.sum("counts").over(until_before(Window.partitionBy("points", "block").orderBy("actor"))), F.lit(0))
    return rows.withColumn("within", within).where("asked").join(before, ["points", "block"]).select("actor", "points", (1 + F.col("before") + F.col("within")).alias("rank"))


def confiscate(ledger: DataFrame, target: str, reason: str | None = None) -> DataFrame:
    """target, points taken: the net of each target, never negative. With `reason`, only of ledger rows that have it."""
    own = ledger if reason is None else ledger.where(F.col("reason") == reason)
    return own.groupBy(target).agg(F.greatest(F.lit(0), F.sum("delta")).alias("taken"))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_info(rows: DataFrame, limit: int, asked: int) -> DataFrame:
    """total, pages (1 at least) and the asked page clamped to them."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("long")
    return rows.agg(F.count("*").alias("total")).select("total", pages.alias("pages"), F.least(F.greatest(F.lit(asked), F.lit(1)), pages).cast("long").alias("page"))


def first_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def fold_votes(clicks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """clicks with the state after each: an equal click clears it, another sets it.

    Within a run of equal clicks the odd ones set; runs are numbered by a running count of changes.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = clicks.withColumn("run", F.sum(F.when(F.lag("value").over(w) == F.col("value"), 0).otherwise(1)).over(w))
    k = F.row_number().over(Window.partitionBy(*keys, "run").orderBy(*order))
    return runs.withColumn("state", F.when(k % 2 == 1, F.col("value")).otherwise(0))


def calendar_limit(events: DataFrame, keys: list[str], bucket: Column, order: list[str], limit: int) -> DataFrame:
    """events with admitted: the first `limit` of each key and bucket."""
    own = events.withColumn("bucket", bucket)
    place = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order))
    return own.withColumn("admitted", place <= limit)


def runs_of(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key, run, value, size of runs of equal values."""
    w = Window.partitionBy(key).orderBy(*order)
    own = rows.withColumn("run", F.sum(F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)).over(w).cast("long"))
    return own.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("size"))


def keep_last(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The k first by `order` of each key, and how many each hides."""
    own = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    n = F.count("*").over(Window.partitionBy(key))
    return own.withColumn("hidden", F.greatest(F.lit(0), n - k).cast("long")).where(F.col("place") <= k)


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first by order: replay and view de-duplication."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("first")).select(*keys, "first.*")


def upsert(base: DataFrame, changes: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """base with the rows of changes put in, whole, by key."""
    columns = list(columns)
    b, c = base.select(key, F.struct(*columns).alias("old")), changes.select(key, F.struct(*columns).alias("new"))
    return b.join(c, key, "full_outer").select(key, F.coalesce("new", "old").alias("row")).select(key, "row.*")


def gaps(rows: DataFrame, key: str, seq: str, block: int = BLOCK) -> DataFrame:
    """key, expected, received of every seq that doesn't follow the one before it of its key.

    Sequences are looked at in blocks of numbers: the largest of the earlier blocks is what a block's first follows.
    """
    own = rows.select(key, seq, F.floor(F.col(seq) / block).alias("block"))
    lasts = own.groupBy(key, "block").agg(F.max(seq).alias("last"))
    carried = lasts.select(key, "block", F.lag("last").over(Window.partitionBy(key).orderBy("block")).alias("carried"))
    before = F.lag(seq).over(Window.partitionBy(key, "block").orderBy(seq))
    seen = own.withColumn("before", before).join(carried, [key, "block"])
    expected = F.coalesce("before", "carried") + 1
    return seen.where(F.col(seq) > expected).select(key, expected.alias("expected"), F.col(seq).alias("received"))


def first_reached(moves: DataFrame, key: str, order: list[str], move: str, level: int, block: Column) -> DataFrame:
    """key, best_at: the first time (order[0]) at which the running sum of a key's moves is `level` at least.

    block: an expression that grows with the order. Sums of whole blocks are added first, so a task sorts one block of a key.
    """
    own = moves.withColumn("block", block)
    sums = own.groupBy(key, "block").agg(F.sum(move).alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    until = sums.select(key, "block", F.coalesce(before, F.lit(0)).alias("until"))
    within = F.sum(move).over(Window.partitionBy(key, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    reached = own.withColumn("within", within).join(until, [key, "block"]).where(F.col("until") + F.col("within") >= level)
    return reached.groupBy(key).agg(F.min(order[0]).alias("best_at"))


def reply_edges(comments: DataFrame) -> DataFrame:
    """id, parent of comments(id, body): parent is the comment that a leading >>marker names, if there is one."""
    known = comments.select(F.col("id").alias("parent"))
    marked = comments.select("id", reply_parent(F.col("body")).try_cast(comments.schema["id"].dataType).alias("asked"))
    return marked.join(known, F.col("asked") == F.col("parent"), "left").select("id", "parent")


def thread_paths(edges: DataFrame, id_: str, parent: str) -> DataFrame:
    """id, root, depth, path (ids from the root's child on to the row) of a reply forest: rows without a known parent are roots;
    cycles and what hangs on them vanish.

    Ids must be unique; see `resolve`.
    """
    return resolve(edges, id_, parent)[0].select(id_, "root", "depth", "path")


def resolve(edges: DataFrame, id_: str, parent: str, top: tuple[Column, Column] | None = None, step: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, root, depth, path, asked) of the rows that a root holds, and (id, asked) of the others: cycles and what hangs on them.

    top: root and path of a row without a known parent (itself, and none). step: what another row adds to its parent's path (its id).
    asked: the parent as it was given.

    Pointer jumping: each round takes every open row to the ancestor of its ancestor, so a thread of depth d needs log2(d) rounds. A
    round that finishes no row has only cycles left. Each round writes the open rows only; finished ones stay where they were written.
    """
    known = edges.select(F.col(id_).alias("p_id"))
    rows = edges.join(known, F.col(parent) == F.col("p_id"), "left")
    first, step = F.col("p_id").isNull(), F.array(F.col(id_)) if step is None else step
    top_root, top_path = (F.col(id_), F.slice(step, 1, 0)) if top is None else top
    moved = settled(rows.select(id_, F.when(first, top_root).otherwise(F.col(parent)).alias("root"), F.when(first, 0).otherwise(1).cast("long").alias("depth"), F.when(first, top_path).otherwise(step).alias("path"), F.col(parent).alias("asked"), first.alias("done")))
    done = moved.where("done").drop("done")
    while True:
        open_ = moved.where("not done").drop("done")
        n, finished = moved.agg(F.count("*"), F.count_if("done")).first()
        if finished in (0, n):
            return done, open_.select(id_, "asked")
        above = done.withColumn("done", F.lit(True)).unionByName(open_.withColumn("done", F.lit(False)))
        above = above.select(F.col(id_).alias("a_id"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"), F.col("path").alias("a_path"), F.col("done").alias("a_done"))
        joined = open_.join(above, F.col("root") == F.col("a_id"))
        moved = settled(joined.select(id_, F.col("a_root").alias("root"), (F.col("depth") + F.col("a_depth")).alias("depth"), F.concat("a_path", "path").alias("path"), "asked", F.col("a_done").alias("done")))
        done = done.unionByName(moved.where("done").drop("done"))


def thread_order(paths: DataFrame, id_: str) -> DataFrame:
    """paths with place: each thread's rows as a nested listing shows them, replies under what they answer, in the order of ids."""
    return paths.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("path")).cast("long"))
