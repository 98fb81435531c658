"""Cursor moves as set operations on a visible state (k, v; keys distinct)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ranges


def scan(state: DataFrame, reverse: bool = False) -> DataFrame:
    return state.orderBy(F.desc("k") if reverse else F.asc("k"))


def between(state: DataFrame, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """low <= k < high; None is open."""
    if low is not None:
        state = state.where(F.col("k") >= F.lit(low))
    return state if high is None else state.where(F.col("k") < F.lit(high))


def seek(state: DataFrame, target: bytes) -> DataFrame:
    """The first entry with k >= target, or none."""
    return between(state, target).orderBy("k").limit(1)


def seek_for_prev(state: DataFrame, target: bytes) -> DataFrame:
    """The last entry with k <= target, or none."""
    return state.where(F.col("k") <= F.lit(target)).orderBy(F.desc("k")).limit(1)


def first(state: DataFrame) -> DataFrame:
    return state.orderBy("k").limit(1)


def last(state: DataFrame) -> DataFrame:
    return state.orderBy(F.desc("k")).limit(1)


def first_last(state: DataFrame) -> DataFrame:
    return state.agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"))


def ranked(state: DataFrame, reverse: bool = False) -> DataFrame:
    """Adds ``pos`` from 1 in scan order."""
    return ranges.ranked(state, [F.desc("k") if reverse else F.asc("k")], "pos")


def stepped(state: DataFrame) -> DataFrame:
    """Adds the keys that next() and prev() would reach."""
    return ranges.stepped(state, "k", "next_key", "prev_key")


def seek_each(state: DataFrame, targets: DataFrame) -> DataFrame:
    """target, hit: for each distinct target the first key at or after it, null if none.

    Targets and keys go through one ordered pass with a backward running minimum, not a range join."""
    both = targets.select(F.col("target").alias("k")).distinct().withColumn("is_key", F.lit(False)).unionByName(state.select("k", F.lit(True).alias("is_key")))
    hits = ranges.carried(both, "k", {"hit": F.when(F.col("is_key"), F.col("k"))}, forward=False, how="min")
    return hits.where(~F.col("is_key")).select(F.col("k").alias("target"), "hit")


def merged(*logs: DataFrame) -> DataFrame:
    """All entries of the logs in internal order: key, then newest first. No version is dropped."""
    return reduce(DataFrame.unionByName, logs).orderBy("k", F.desc("seq"), F.desc("op"))


def contains(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys that have any version."""
    return keys.select("k").distinct().join(log.select("k"), "k", "left_semi")


def empty(log: DataFrame) -> DataFrame:
    return log.where(F.lit(False))
