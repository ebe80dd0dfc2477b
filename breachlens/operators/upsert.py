"""Merging fed rows into stored ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.operators.sizing import FEW_ROWS, broadcast_if, checkpointed


def _paired(stored: DataFrame, feed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored and fed versions side by side, as structs that are NULL where absent."""
    old = stored.select(key, F.struct(*columns).alias("old"))
    new = feed.select(key, F.struct(*columns).alias("new"))
    return old.join(new, key, "full_outer")


def upsert(stored: DataFrame, feed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows, replaced by or joined with the fed ones.

    A fed NULL replaces a stored value. The feed has one row per key.
    """
    return _paired(stored, feed, key, columns).select(key, F.coalesce("new", "old").alias("row")).select(
        key, "row.*"
    )


def upsert_status(stored: DataFrame, feed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What an upsert does with each fed key: inserted, changed or same."""
    same = reduce(
        Column.__and__, [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in columns]
    )
    status = F.when(F.col("old").isNull(), "inserted").when(same, "same").otherwise("changed")
    fed = _paired(stored, feed, key, columns).filter(F.col("new").isNotNull())
    return fed.select(key, status.alias("status"))


def upsert_metrics(stored: DataFrame, feed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return upsert_status(stored, feed, key, columns).groupBy("status").agg(F.count("*").alias("n"))


def versioned_upsert(
    stored: DataFrame, feed: DataFrame, key: str, version: str, order: str, columns: list[str]
) -> DataFrame:
    """Apply fed rows one after another; a row takes effect only if its version differs.

    A stored row, and else the first fed row, starts each key; two NULL versions are
    equal. The outcome is the first row of the last unbroken stretch of equal versions.
    That stretch starts after the last row of any other version, so that three
    aggregations find it, each of which merges rows before its shuffle: no key's
    rows are ever gathered or sorted in one place.

    They look at keys, versions and places only. The other columns are read for the rows that
    take effect, at most one of each key: these are few beside the feed, and if they are not
    too many they are broadcast to it, so that no text but theirs is ever shuffled.
    """
    narrow = feed.select(key, version, F.col(order).alias("at"))
    last_of_version = narrow.groupBy(key, version).agg(F.max("at").alias("seen"))
    last = last_of_version.groupBy(key).agg(F.max("seen").alias("last_seen"))
    broken = (
        last_of_version.join(last, key)
        .filter(F.col("seen") < F.col("last_seen"))
        .groupBy(key)
        .agg(F.max("seen").alias("broken_at"))
    )
    stretch = (
        narrow.join(broken, key, "left")
        .filter(F.col("broken_at").isNull() | (F.col("at") > F.col("broken_at")))
        .groupBy(key)
        .agg(F.min(F.struct("at", version)).alias("first"), F.max("broken_at").alias("broken_at"))
    )
    before = stored.select(key, F.col(version).alias("old_version"), F.lit(True).alias("known"))
    unchanged = F.col("known") & F.col("broken_at").isNull() & F.col("old_version").eqNullSafe(F.col(f"first.{version}"))
    winners = checkpointed(
        stretch.join(before, key, "left").filter(~F.coalesce(unchanged, F.lit(False))).select(key, F.col("first.at").alias("at"))
    )
    every = list(dict.fromkeys((version, *columns)))
    few = winners.count() <= FEW_ROWS
    texts = feed.withColumn("at", F.col(order)).join(broadcast_if(winners, few), [key, "at"])
    # One row for each key, unless a place occurs twice in it.
    new = texts.groupBy(key).agg(F.any_value(F.struct(*every)).alias("new"))
    old = stored.select(key, F.struct(*every).alias("old"))
    return old.join(new, key, "full_outer").select(key, F.coalesce("new", "old").alias("row")).select(key, "row.*")
