"""Write batches: arrays of records, their sequences and their concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ranges

#: The cap on a group of batches, and the size up to which a first batch caps it at its own size and as much again.
GROUP_BYTES, SMALL_BYTES = 1 << 20, 128 << 10
RECORDS = "array<struct<op: tinyint, k: binary, v: binary>>"


def inserted(batches: DataFrame) -> DataFrame:
    """batches: sequence, records. The log rows: records take consecutive sequences from the batch's own."""
    rows = batches.select("sequence", F.posexplode("records").alias("pos", "r"))
    value = F.when(F.col("r.op") == 1, F.col("r.v")).otherwise(F.lit(b""))
    return rows.select(F.col("r.k").alias("k"), (F.col("sequence") + F.col("pos")).alias("seq"), F.col("r.op").alias("op"), value.alias("v"))


def sequenced(records: DataFrame, order: list, last: int) -> DataFrame:
    """Dense sequences last + 1, last + 2, ... over all records in an explicit order."""
    return ranges.ranked(records, order, "seq", first=last + 1)


def grouped(batches: DataFrame, most_bytes: int = GROUP_BYTES, small: int = SMALL_BYTES):
    """Group commit as arithmetic: the cap on a group that the given first batch leads, by its size."""
    size = F.col("bytes")
    return batches.withColumn("cap", F.when(size <= small, size + small).otherwise(F.lit(most_bytes)))
