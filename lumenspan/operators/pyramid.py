"""The data behind plots of long recordings: a pyramid of extremes over time and channels.

A cell of level k covers base * factor^k samples of factor^k channels and keeps their least and largest value. Every level
is grouped from the one below, partly before the exchange; a view reads one level only, as fine as its pixels allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.operators.chunks import Chunked
from lumenspan.operators.timeaxis import let

CELL = ("record_id", "channel_block", "time_block")


def lowest(record: Chunked, base: int) -> DataFrame:
    """Level 0: extremes of `base` samples of one channel; a cell that lies in several chunks is put together."""
    rows = record.chunks.where(F.size("samples") > 0)
    first, last = F.floor(F.col("start") / base), F.floor((F.col("start") + F.size("samples") - 1) / base)

    def cell(s, x, k):
        a = F.greatest(k * base - s, F.lit(0)).cast("int")
        b = F.least((k + 1) * base - s, F.size(x).cast("long")).cast("int")
        return let(F.slice(x, a + 1, b - a), lambda part: F.struct(k.alias("time_block"), F.array_min(part).alias("low"), F.array_max(part).alias("high")))

    cells = let(F.struct(F.col("start").alias("s"), F.col("samples").alias("x")), lambda c: F.transform(F.sequence(first, last), lambda k: cell(c["s"], c["x"], k)))
    parts = rows.select("record_id", F.col("channel_pos").cast("long").alias("channel_block"), F.inline(cells))
    return parts.groupBy(*CELL).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def pyramid(record: Chunked, levels: int, base: int = 64, factor: int = 4) -> DataFrame:
    """level, record_id, channel_block, time_block, low, high for `levels` levels. NaN counts as largest, nulls nowhere."""
    now, found = lowest(record, base), []
    for level in range(levels):
        if level:
            coarser = [F.floor(F.col(c) / factor).alias(c) for c in CELL[1:]]
            now = now.select("record_id", *coarser, "low", "high").groupBy(*CELL).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        found.append(now.select(F.lit(level).alias("level"), *CELL, "low", "high"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def write(record: Chunked, path: str, levels: int, base: int = 64, factor: int = 4) -> None:
    """Level by level, each from the written one below, as Parquet partitioned by level."""
    spark = record.chunks.sparkSession
    now = lowest(record, base)
    for level in range(levels):
        if level:
            coarser = [F.floor(F.col(c) / factor).alias(c) for c in CELL[1:]]
            below = spark.read.parquet(f"{path}/level={level - 1}")
            now = below.select("record_id", *coarser, "low", "high").groupBy(*CELL).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        now.select(*CELL, "low", "high").write.mode("overwrite").parquet(f"{path}/level={level}")


def level_for(samples: int, channels: int, pixels: tuple[int, int], levels: int, base: int = 64, factor: int = 4) -> int:
    """The finest level with no more cells than pixels (time, channels) either way, else the coarsest."""
    for level in range(levels):
        scale = factor**level
        if -(-samples // (base * scale)) <= pixels[0] and -(-channels // scale) <= pixels[1]:
            return level
    return levels - 1


def view(spark: SparkSession, path: str, levels: int, samples: tuple[int, int], channels: tuple[int, int], pixels: tuple[int, int], base: int = 64, factor: int = 4) -> DataFrame:
    """record_id, first_sample, first_channel, low, high of the cells that reach into [samples) and [channels), from the
    one level of a written pyramid of `levels` that fits the pixels; no other level is opened."""
    level = level_for(samples[1] - samples[0], channels[1] - channels[0], pixels, levels, base, factor)
    wide, high = base * factor**level, factor**level
    rows = spark.read.parquet(f"{path}/level={level}")
    rows = rows.where(F.col("time_block").between(samples[0] // wide, (samples[1] - 1) // wide) & F.col("channel_block").between(channels[0] // high, (channels[1] - 1) // high))
    return rows.select("record_id", (F.col("time_block") * wide).alias("first_sample"), (F.col("channel_block") * high).alias("first_channel"), "low", "high")
