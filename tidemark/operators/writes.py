"""Changes as rewrites: each gives the table as it is after the change. A batch rewrite is the unit of atomicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def update_where(rows: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with `values` where the test holds, and a column `changed`."""
    own = rows.withColumn("changed", F.coalesce(test, F.lit(False)))
    return own.withColumns({c: F.when(F.col("changed"), v).otherwise(F.col(c)) for c, v in values.items()})


def increment(totals: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """totals(key, value) with the values of changes added; keys that are new begin with theirs. Keys are unique in both."""
    new = changes.select(key, F.col(value).alias("_change"))
    return totals.join(new, key, "full_outer").select(key, (F.coalesce(value, F.lit(0)) + F.coalesce("_change", F.lit(0))).alias(value))


def rotate(tokens: DataFrame, new: DataFrame, owner: str, revoked: str, at: Column) -> DataFrame:
    """All live tokens of the owners of `new` end at `at`; the new ones follow. Columns are those of `tokens`."""
    owners = new.select(F.col(owner).alias("_owner")).distinct()
    own = tokens.join(owners, F.col(owner) == F.col("_owner"), "left")
    ended = own.withColumn(revoked, F.when(F.col("_owner").isNotNull() & F.col(revoked).isNull(), at).otherwise(F.col(revoked)))
    return ended.drop("_owner").unionByName(new)


def confiscate_once(ledger: DataFrame, targets: DataFrame, done: DataFrame) -> DataFrame:
    """target, author, taken of targets(target, author) that `done`(target) doesn't hold: their net points, 0 at the least.

    ledger(target, delta). A row with taken > 0 also stands for a ledger entry of -taken.
    """
    net = ledger.groupBy("target").agg(F.sum("delta").alias("net"))
    open_ = targets.join(done.select("target"), "target", "left_anti")
    return open_.join(net, "target", "left").select("target", "author", F.greatest(F.lit(0), F.coalesce("net", F.lit(0))).cast("long").alias("taken"))


def claim_names(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """claims(owner, kind, name, key, at) with outcome: own, taken, same_as_other, lost (to an earlier claim) or claimed.

    registry(owner, kind, key) has unique keys. Of several new claims of a key the first by (at, owner, kind) gets it.
    """
    known = registry.select("key", F.col("owner").alias("has_owner"), F.col("kind").alias("has_kind"))
    own = claims.join(known, "key", "left")
    own = own.withColumn("free", F.col("has_owner").isNull())
    first = F.row_number().over(Window.partitionBy("key").orderBy("at", "owner", "kind")) == 1
    return own.withColumn(
        "outcome",
        F.when(~F.col("free") & (F.col("has_owner") != F.col("owner")), "taken")
        .when(~F.col("free") & (F.col("has_kind") != F.col("kind")), "same_as_other")
        .when(~F.col("free"), "own")
        .when(first, "claimed")
        .otherwise("lost"),
    ).drop("free", "has_owner", "has_kind")


def extend_or_create(bans: DataFrame, asked: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """bans(keys, reason, expires) after asked(keys, reason, expires): a live ban takes the new end, and the reason if there is one.

    Keys must be unique among the live bans and among `asked`; null keys match each other.
    """
    live = F.col("b.expires").isNull() | (F.col("b.expires") > at)
    same = live
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}"))
    both = bans.alias("b").join(asked.withColumn("asks", F.lit(True)).alias("a"), same, "full_outer")
    mine = F.coalesce("a.asks", F.lit(False))
    values = [F.coalesce(F.col(f"b.{k}"), F.col(f"a.{k}")).alias(k) for k in keys]
    reason = F.coalesce(F.when(mine, F.nullif("a.reason", F.lit(""))), F.col("b.reason")).alias("reason")
    return both.select(*values, reason, F.when(mine, F.col("a.expires")).otherwise(F.col("b.expires")).alias("expires"))


def fill_names(rows: DataFrame, id_: str, name: str, prefix: str) -> DataFrame:
    """Rows without a usable name get prefix + number; a name that several hold stays with the smallest id.

    Each row's number comes from its own id, so new names collide neither with each other nor in a second run.
    """
    taken = F.row_number().over(Window.partitionBy(name).orderBy(id_)) > 1
    own = rows.withColumn("filled", F.col(name).isNull() | (F.col(name) == "") | taken)
    return own.withColumn(name, F.when(F.col("filled"), F.concat(F.lit(prefix), F.col(id_).cast("string"))).otherwise(F.col(name)))


def insert_or_reuse(base: DataFrame, new: DataFrame, key: str, id_: str) -> DataFrame:
    """new(id, key) with `used`: the id of the row that holds its key, in base or, of several new ones, the smallest; null keys
    conflict with nothing. Rows whose used id is their own are to be inserted."""
    held = base.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_).alias("_held"))
    first = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_).alias("_first"))
    owners = first.join(held, key, "left").select(key, F.coalesce("_held", "_first").alias("used"))
    return new.join(owners, key, "left").withColumn("used", F.coalesce("used", id_))


def violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row holds: a unique constraint as a query."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_parents(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent: a foreign key as a query. Null keys have none to miss."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
