"""Typed tables as mutation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "k binary, seq bigint, op tinyint, v binary"


def user_key(number: Column) -> Column:
    """'user-' and six digits: bytes sort as numbers do."""
    return F.concat(F.lit("user-"), F.lpad(number.cast("string"), 6, "0")).cast("binary")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a put for its user; errors are deletions."""
    gone = F.col("event_type") == "error"
    value = F.when(gone, F.lit("")).otherwise(F.concat(F.col("event_type"), F.lit(":"), F.col("event_id").cast("string")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        user_key(F.col("user_id")).alias("k"), (F.col("event_id") + 1).alias("seq"), F.when(gone, 0).otherwise(1).cast("tinyint").alias("op"), value.cast("binary").alias("v")
    )
