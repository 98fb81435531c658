"""Helpers that every training-data operator shares.

Texts reach Python as Arrow binary arrays; ``chunks`` cuts a batch into runs of
rows whose texts add up to a bounded number of bytes, so the memory of a task
does not follow the number of rows Spark puts into a batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..plans.materialise import shared_dir, stored

CHUNK_BYTES = 4 << 20


def binary(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Runs of the rows, as lists of bytes (null: empty), of at most ``most`` bytes or one row."""
    raw = binary(texts)
    sizes = _sizes(raw)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(raw):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield [x or b"" for x in raw.slice(at, to - at).to_pylist()]
        at = to


def _sizes(raw: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def on_arrow(kind: str):
    """Decorator: a module's function on Arrow arrays as a column function.

    The UDF is made on the driver at each call, as a type text needs a session to be read.
    """

    def wrap(f):
        @functools.wraps(f)
        def call(*columns: Column | str) -> Column:
            return arrow_udf(f, kind)(*columns)

        call.plain = f
        return call

    return wrap


class Recipe:
    """A model that each Python worker builds from small parts, once; only the parts are sent."""

    def __init__(self, build, *parts):
        self.build, self.parts, self._made = build, parts, None

    def __getstate__(self):
        return {"build": self.build, "parts": self.parts, "_made": None}

    def made(self):
        if self._made is None:
            self._made = self.build(*self.parts)
        return self._made


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def row_numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds a row id. It identifies rows only once the result has been stored."""
    return df.withColumn(name, F.monotonically_increasing_id())


def exclusive_prefix(df: DataFrame, key: str, size: str, out: str, group: list[str] = (), fan: int = 1024) -> DataFrame:
    """Adds, to a table with one row for each (group, key), the sum of ``size`` over smaller keys.

    Keys are integers from 0. Sums go up three levels of ``fan`` keys each, so that
    no window partition holds more than ``fan`` rows up to fan**3 keys.
    """
    from pyspark.sql import Window as W

    group = list(group)
    levels = df.select(*group, F.col(key).alias("_k0"), F.col(size).alias("_s0")).withColumn("_k1", F.expr(f"_k0 div {fan}")).withColumn("_k2", F.expr(f"_k1 div {fan}"))
    one = levels.groupBy(*group, "_k2", "_k1").agg(F.sum("_s0").alias("_s1"))
    two = one.groupBy(*group, "_k2").agg(F.sum("_s1").alias("_s2"))

    def before(frame: DataFrame, by: list[str], order: str, what: str, to: str) -> DataFrame:
        window = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return frame.withColumn(to, F.coalesce(F.sum(what).over(window), F.lit(0)).cast("long"))

    two = before(two, group, "_k2", "_s2", "_p2").select(*group, "_k2", "_p2")
    one = before(one, [*group, "_k2"], "_k1", "_s1", "_p1").select(*group, "_k2", "_k1", "_p1")
    zero = before(levels, [*group, "_k1"], "_k0", "_s0", "_p0")
    return (
        zero.join(one.join(two, [*group, "_k2"]).select(*group, "_k1", "_p1", "_p2"), [*group, "_k1"])
        .select(*group, F.col("_k0").alias(key), F.col("_s0").alias(size), (F.col("_p0") + F.col("_p1") + F.col("_p2")).alias(out))
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["Recipe", "binary", "chunks", "exclusive_prefix", "fold", "on_arrow", "row_numbered", "shared_dir", "stored", "table"]
