"""Bloom filters over user keys, one for each file, as rows of set bits.

Filters see the user key alone: one that saw the sequence would hide keys from reads at another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns


def probes_of(bits_per_key: int) -> int:
    return min(30, max(1, int(bits_per_key * 0.69)))


def filter_bits(n: Column, bits_per_key: int) -> Column:
    """Bits of a filter of n keys, in whole bytes."""
    return (F.ceil(F.greatest(F.lit(64), n * bits_per_key) / 8) * 8).cast("long")


def build(keys: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """keys: file, k. file, bits, bit: the bits that are set in each file's filter."""
    own = keys.select("file", "k").distinct()
    sizes = own.groupBy("file").agg(filter_bits(F.count(F.lit(1)), bits_per_key).alias("bits"))
    hashed = own.select("file", columns.hash32("k").alias("h")).join(sizes, "file")
    return hashed.select("file", "bits", F.explode(columns.bloom_probes(F.col("h"), F.col("bits"), probes_of(bits_per_key))).alias("bit")).distinct()


def may_hold(keys: DataFrame, filters: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """keys: file, k. file, k, maybe: whether each key may be in the file; false is certain."""
    sizes = filters.select("file", "bits").distinct()
    hashed = keys.select("file", "k").distinct().withColumn("h", columns.hash32("k")).join(sizes, "file")
    asked = hashed.select("file", "k", F.explode(F.array_distinct(columns.bloom_probes(F.col("h"), F.col("bits"), probes_of(bits_per_key)))).alias("bit"))
    found = asked.join(filters.select("file", "bit", F.lit(True).alias("set")), ["file", "bit"], "left")
    return found.groupBy("file", "k").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("maybe"))
