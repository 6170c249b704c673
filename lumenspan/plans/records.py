"""Tables used as recordings: E from embeddings, V from events, L from lineitem."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.model import Record, RecordMeta

E_SAMPLES, E_START = 64, datetime(2024, 1, 1)
#: Event types up to which they are numbered in a plan.
MOST_KINDS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str, **meta) -> Record:
    """vec_id is the channel and its position (ids are dense from 0), array positions are samples at 64 Hz."""
    rows = table(spark, sf_dir, "embeddings")
    traces = rows.select(
        F.lit("E").alias("record_id"), F.col("vec_id").cast("int").alias("channel_pos"), F.col("vec_id").cast("double").alias("channel"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )
    return Record(traces, RecordMeta(fs=64.0, n=E_SAMPLES, start_time=E_START, **meta))


def _filled(sums: DataFrame, name: str, n: int, meta: RecordMeta) -> Record:
    """(channel, idx, value) sums, the missing sample numbers 0. A channel's array is as long as the record, whatever
    the number of rows that were summed."""
    grid = sums.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
    full = grid.join(sums, ["channel", "idx"], "left").select("channel", "idx", F.coalesce("value", F.lit(0.0)).alias("value"))
    traces = full.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s"))
    return Record(
        traces.select(F.lit(name).alias("record_id"), F.col("channel").cast("int").alias("channel_pos"), F.col("channel").cast("double").alias("channel"), F.transform("s", lambda s: s["value"]).alias("samples")),
        meta,
    )


def events(spark: SparkSession, sf_dir: str) -> Record:
    """Event types (numbered alphabetically) as channels, hourly sums of value over 30 days as samples; one sample a
    second nominally."""
    rows = table(spark, sf_dir, "events")
    kinds = sorted(r["event_type"] for r in rows.select("event_type").distinct().limit(MOST_KINDS + 1).collect())
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} event types are no channels of a record")
    number = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    hour = F.floor(F.timestamp_diff("MICROSECOND", F.lit(E_START).cast("timestamp_ntz"), F.col("ts")) / 3_600_000_000).cast("int")
    sums = rows.select(number[F.col("event_type")].alias("channel"), hour.alias("idx"), "value").groupBy("channel", "idx").agg(F.sum("value").alias("value"))
    return _filled(sums, "V", 720, RecordMeta(fs=1.0, n=720, start_time=E_START))


def lineitem(spark: SparkSession, sf_dir: str) -> Record:
    """Line numbers as channels (position l_linenumber - 1), daily sums of l_extendedprice as samples."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.to_date("l_shipdate").alias("day"), "l_extendedprice")
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    sums = (
        rows.groupBy((F.col("l_linenumber") - 1).alias("channel"), F.date_diff("day", F.lit(first)).alias("idx"))
        .agg(F.sum("l_extendedprice").alias("value"))
    )
    n = (last - first).days + 1
    return _filled(sums, "L", n, RecordMeta(fs=1.0, n=n, start_time=datetime(first.year, first.month, first.day)))
