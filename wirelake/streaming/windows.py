"""Streams of payloads: decode, watermark, window, and the last message of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codec import decode
from ..schema import Pool
from ..sources import register


def decode_stream(spark: SparkSession, path: str, pool: Pool, message: str, **how) -> DataFrame:
    """The delimited files at a path as a stream of structs in the column value, with path and position."""
    register(spark)
    return spark.readStream.format("delimited").load(path).withColumn("value", decode("payload", pool, message, **how))


def windowed(df: DataFrame, time: Column, width: str, keys: dict[str, Column], aggregates: dict[str, Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window_start, window_end, keys and aggregates by name. What comes later than ``late`` is left out, and state is dropped with it; batches have no watermark."""
    timed = df.select(time.alias("__time"), *[c.alias(n) for n, c in keys.items()], F.struct("*").alias("__row"))
    if df.isStreaming:
        timed = timed.withWatermark("__time", late)
    flat = timed.select("__time", *keys, *[F.col("__row")[c].alias(c) for c in df.columns if c not in keys])
    window = F.window("__time", width, slide) if slide else F.window("__time", width)
    grouped = flat.groupBy(window.alias("window"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The whole last row of each key, in order; in streams with update or complete output."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__last")).select(*keys, "__last.*")
