"""Exact de-duplication by distributed MSD radix partitioning.

Documents are split by their leading characters, then by successive runs of
bytes of the normalised text, each run eight times as long as the one before.
A group leaves the recursion as soon as it holds one row or its texts have
ended; only the rows of open groups go on to the next split. Groups are told
apart by comparing the bytes themselves: no digest takes part.

Each split is a partially aggregated count by (group, bytes, ended), so a group
that holds a third of all rows reaches a reducer as one row from each map task,
joined back with a join whose large side adaptive execution may split.

Defined cases: a null text counts as empty; texts are compared after lower-casing
A-Z only; of equal texts the row with the largest doc_id is kept, a null doc_id
coming last, and of rows that also share the doc_id exactly one is kept; very long texts
are compared to their end; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HEAD = 64
FIRST = 448
GROWTH = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(raw: bytes, head: int) -> list[bytes]:
    """Successive runs of bytes after the first ``head`` ones; none if the text ends there."""
    out, at, width = [], head, FIRST
    while at < len(raw):
        out.append(raw[at : at + width])
        at, width = at + width, width * GROWTH
    return out


@common.on_arrow("struct<sha: binary, runs: array<binary>>")
def _runs(text: pa.Array, head: pa.Array) -> pa.Array:
    """The digest that is reported, and, where a head says how many bytes are settled, what follows it."""
    heads, sha, runs = head.to_pylist(), [], []
    for part in common.chunks(text):
        for raw in part:
            raw, at = raw.lower(), heads[len(sha)]
            sha.append(hashlib.sha256(raw).digest())
            runs.append(None if at is None else cut(raw, at))
    return pa.StructArray.from_arrays([pa.array(sha, pa.binary()), pa.array(runs, pa.list_(pa.binary()))], ["sha", "runs"])


def _head(text: Column) -> Column:
    return F.translate(F.substring(text, 1, HEAD), _UPPER, _LOWER)


def _anew(key: str) -> Column:
    return F.concat(F.col(key), F.lit(""))


def classes(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, and the columns of ``carry``.

    ``carry`` columns, the text among them, are returned under their names as fields of a struct ``row``.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct("text")
    text = lambda c: F.coalesce(c, F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _head(text(F.col("text"))).alias("gid"), row.alias("row"))
    # The counts come with a key that Spark can't take for the one they were grouped by, so that the join deals both sides anew and may split a hot key.
    shared = base.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(_anew("gid").alias("gid"), "n").hint("merge")
    opened = (
        base.join(shared, "gid", "left")
        .withColumn("x", _runs(text(F.col("row.text")), F.when(F.col("n").isNotNull(), F.octet_length("gid"))))
        .select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", (F.col("row") if carry else F.lit(None).cast("int")).alias("row"), "x.sha",
            F.when(F.col("n").isNotNull(), F.col("gid")).alias("gid"), "x.runs",
        )
    )
    state = common.stored(opened, "radix0")
    single = lambda df: df.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "row")
    done, level = [single(state.where("gid is null"))], 0
    state = state.where("gid is not null")
    while state.take(1):
        keyed = state.select("rid", "doc_id", "row", "sha", "gid", "runs", F.coalesce(F.get("runs", F.lit(level)), F.lit(b"")).alias("run"), (F.size("runs") <= level + 1).alias("ended"))
        split = (
            keyed.groupBy("gid", "run", "ended")
            .agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.min("rid").alias("first"), F.count(F.lit(1)).alias("n"))
            .where("n > 1")
            .select(_anew("gid").alias("gid"), "run", "ended", "best", "first", "n")
        )
        joined = keyed.join(split, ["gid", "run", "ended"], "left").select(
            "rid", "doc_id", "row", "sha", "best", "n",
            F.when(~F.col("ended"), F.col("first").cast("string")).alias("gid"),
            F.when(~F.col("ended") & F.col("n").isNotNull(), F.col("runs")).alias("runs"),
        )
        level += 1
        table = common.stored(joined, f"radix{level}")
        done.append(single(table.where("n is null")))
        ended = table.where("n is not null and gid is null")
        done.append(ended.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("best.rid")).alias("kept"), "sha", "row"))
        state = table.where("gid is not null and n is not null").select("rid", "doc_id", "row", "sha", "gid", "runs")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    # Each level has files of its own, and each file was a part: no more parts than a shuffle deals.
    out = out.coalesce(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")
    return out if carry else out.drop("row")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without the copies: all columns, one row of each group of equal texts."""
    names = docs.columns
    return classes(docs, names).where("kept").select(*(F.col("row").getField(c).alias(c) for c in names))
