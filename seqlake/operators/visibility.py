"""Point, batch and ordered reads of the state at a sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ranges

LATEST = (1 << 56) - 1
VALUE, DELETION = 1, 0


def newest(log: DataFrame, sequence: int = LATEST) -> DataFrame:
    """k, seq, op, v: of each key the newest version at ``sequence``, deletions too.

    A partial aggregate: a key with a third of all versions leaves each task as one row.
    """
    best = log.where(F.col("seq") <= sequence).groupBy("k").agg(F.max_by(F.struct("seq", "op", "v"), "seq").alias("_best"))
    return best.select("k", "_best.seq", "_best.op", "_best.v")


def visible(log: DataFrame, sequence: int = LATEST) -> DataFrame:
    """k, seq, v. Deletions go only after the newest version is chosen, or old values would come back."""
    return newest(log, sequence).where(F.col("op") == VALUE).select("k", "seq", "v")


def get(log: DataFrame, key: bytes, sequence: int = LATEST) -> DataFrame:
    """One row, or none. The key reaches the scan as a pushed filter."""
    return visible(log.where(F.col("k") == F.lit(key)), sequence).select("k", "v")


def lookup(log: DataFrame, keys: DataFrame, sequence: int = LATEST) -> DataFrame:
    """k, state (found, deleted, not_found), v for each distinct key of ``keys``; the log is cut to them first."""
    wanted = keys.select("k").distinct()
    state = newest(log.join(wanted, "k", "left_semi"), sequence)
    named = F.when(F.col("op").isNull(), "not_found").when(F.col("op") == DELETION, "deleted").otherwise("found")
    return wanted.join(state, "k", "left").select("k", named.alias("state"), F.when(F.col("op") == VALUE, F.col("v")).alias("v"))


def as_of(log: DataFrame, probes: DataFrame) -> DataFrame:
    """probes: id, k, at. id, k, at, v: the value of k at sequence ``at``, null if none: one pass for many snapshots.

    Versions and probes lie in one order of (key, sequence), cut into ranges that may part a hot key; the newest
    version so far is carried along, so that a key with many of both costs their sum and not their product."""
    version = F.struct("k", "seq", "op", "v")
    marks = log.select(F.struct("k", "seq", F.lit(0).alias("side")).alias("o"), version.alias("x"))
    asked = probes.select(F.struct("k", F.col("at").cast("long").alias("seq"), F.lit(1).alias("side")).alias("o"), F.struct("id", "k", "at").alias("p"))
    passed = ranges.carried(marks.unionByName(asked, allowMissingColumns=True), "o", {"last": F.col("x")}).where("p is not null")
    here = (F.col("last.k") == F.col("p.k")) & (F.col("last.op") == VALUE)
    return passed.select("p.id", "p.k", "p.at", F.when(here, F.col("last.v")).alias("v"))


def difference(log: DataFrame, earlier: int, later: int = LATEST) -> DataFrame:
    """k, kind (added, removed, changed) between two snapshots, from one pass over the log."""
    at = lambda s: F.max_by(F.when(F.col("seq") <= s, F.struct("op", "v")), F.when(F.col("seq") <= s, F.col("seq")))
    both = log.where(F.col("seq") <= later).groupBy("k").agg(at(earlier).alias("a"), at(later).alias("b"))
    value = lambda x: F.when(F.col(f"{x}.op") == VALUE, F.col(f"{x}.v"))
    both = both.select("k", value("a").alias("a"), value("b").alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("k", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("kind"))
