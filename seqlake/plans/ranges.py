"""Ordered computations over a whole table without a one-partition window.

Rows are dealt by key range and stored with their partition's number. Windows then
run inside each range; what must cross ranges (counts, first and last keys, running
extremes) is one summary row for each range, carried over by a window over these few
rows and joined back by broadcast. There are as many ranges as shuffle partitions: the number is
given, as adaptive execution would else merge small ranges into one. Running aggregates
always go up to the current row, from the last key if backward, as Spark keeps those
up to date row by row but computes frames that begin at the current row anew for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .materialise import stored

PART = "_part"


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows, stored, with the number of the key range that they lie in."""
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(number, *order).withColumn(PART, F.spark_partition_id()), "ranged")


def _ranges(parts: DataFrame, *summary: Column) -> DataFrame:
    return parts.groupBy(PART).agg(*summary)


def ranked(df: DataFrame, order: list[Column], out: str, first: int = 1) -> DataFrame:
    """Adds the dense position of each row in the whole order, from ``first``."""
    parts = ranged(df, *order)
    before = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    counts = _ranges(parts, F.count(F.lit(1)).alias("_n")).select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    position = F.row_number().over(W.partitionBy(PART).orderBy(*order)) + F.col("_before") + F.lit(first - 1)
    return parts.join(F.broadcast(counts), PART).withColumn(out, position.cast("long")).drop(PART, "_before")


def stepped(df: DataFrame, key: str, following: str, preceding: str) -> DataFrame:
    """Adds the next and the previous key in order; keys are distinct."""
    parts = ranged(df, key)
    edges = _ranges(parts, F.min(key).alias("_low"), F.max(key).alias("_high"))
    over = W.orderBy(PART)
    edges = edges.select(PART, F.lead("_low").over(over).alias("_after"), F.lag("_high").over(over).alias("_prior"))
    inside = W.partitionBy(PART).orderBy(key)
    return (
        parts.join(F.broadcast(edges), PART)
        .withColumn(following, F.coalesce(F.lead(key).over(inside), F.col("_after")))
        .withColumn(preceding, F.coalesce(F.lag(key).over(inside), F.col("_prior")))
        .drop(PART, "_after", "_prior")
    )


def carried(df: DataFrame, key: str, out: dict[str, Column], forward: bool = True, how: str = "max") -> DataFrame:
    """Adds running aggregates over all rows with a key up to this one (or, backward, from this one on), equal keys included.

    out: column name to the expression that is aggregated; how: max, min or sum.
    """
    agg = getattr(F, how)
    parts = ranged(df.withColumns({f"_in_{n}": e for n, e in out.items()}), key)
    along = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    over = W.orderBy(along(PART)).rowsBetween(W.unboundedPreceding, -1)
    sums = _ranges(parts, *(agg(f"_in_{n}").alias(f"_all_{n}") for n in out))
    sums = sums.select(PART, *(agg(f"_all_{n}").over(over).alias(f"_far_{n}") for n in out))
    inside = W.partitionBy(PART).orderBy(along(key)).rangeBetween(W.unboundedPreceding, W.currentRow)
    joined = parts.join(F.broadcast(sums), PART)
    pick = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}[how]
    joined = joined.withColumns({n: pick(agg(f"_in_{n}").over(inside), F.col(f"_far_{n}")) for n in out})
    return joined.drop(PART, *(f"_in_{n}" for n in out), *(f"_far_{n}" for n in out))
