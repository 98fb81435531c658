"""Sorted runs: Parquet files dealt by key range, so that no key is ever split between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files
from .manifest import RunFile
from .mappings import SCHEMA


def write(files: Files, rows: DataFrame, name: str, n_files: int, level: int, number: int, bloom: bool = True) -> list[RunFile]:
    """Write rows as files of a level, numbered from ``number``. No rows: no files."""
    spread = rows.select("k", "seq", "op", "v").repartitionByRange(max(1, n_files), "k").sortWithinPartitions("k", F.desc("seq"))
    writer = spread.write.mode("overwrite").option("compression", "zstd")
    if bloom:  # on the user key alone: a filter that saw the sequence would hide keys from reads at another one
        # Adaptive: as large as the file's keys need, where the fixed default takes 1 MiB in the smallest file.
        writer = writer.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(files.path(name))
    read = files.spark.read.schema(SCHEMA).parquet(files.path(name)).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    facts = read.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.hex(F.min("k")).alias("lo"), F.hex(F.max("k")).alias("hi"), F.min("seq").alias("a"), F.max("seq").alias("b")).collect()
    facts.sort(key=lambda r: bytes.fromhex(r["lo"]))
    return [RunFile(level, number + i, f"{name}/{r['file']}", files.size(f"{name}/{r['file']}"), r["n"], r["lo"], r["hi"], r["a"], r["b"]) for i, r in enumerate(facts)]


def read(spark: SparkSession, paths: list[str], verify: bool = False) -> DataFrame:
    """verify: pages whose checksum is wrong are an error."""
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    reader = spark.read.schema(SCHEMA)
    if verify:
        reader = reader.option("parquet.page.verify-checksum.enabled", "true")
    return reader.parquet(*paths)
