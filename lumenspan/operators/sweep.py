"""Joining any number of recordings: one sweep over their intervals decides who speaks when."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.model import RecordMeta
from lumenspan.operators.chunks import COLUMNS, Chunked

#: Samples of a row that fills a gap.
GAP_ROW = 1 << 16


def concatenate_all(chunks: DataFrame, records: DataFrame, meta: RecordMeta, fill: float | None = 0.0, name: str = "all", gap_row: int = GAP_ROW) -> Chunked:
    """One recording of all: chunks of many (record_id, channel_pos, channel, start, samples) and a row for each of them in
    records (record_id, start_time TIMESTAMP_NTZ, fs, n).

    Where recordings overlap, the one that starts first speaks (of equal starts the least record_id); what none covers is
    `fill` (None: NaN), in rows of at most gap_row samples. Channels meet by label; a recording without a channel is a gap
    of that channel, so all channels are equally long. Places are counted in whole samples from the earliest start.

    The sweep runs over intervals, a row for each channel of a recording, with the largest end so far as its only state;
    samples are joined with their recording's share and cut, never sorted or gathered. `meta` is of any recording; its
    start and length are replaced. Recordings of different sampling frequencies are an error."""
    bounds = records.agg(F.min("start_time").alias("t0"), F.min("fs").alias("slow"), F.max("fs").alias("fast")).first()
    if bounds["t0"] is None:
        return Chunked(chunks.select(*COLUMNS, "samples").limit(0), replace(meta, n=0))
    if bounds["slow"] != bounds["fast"]:
        raise ValueError("all recordings need the same sampling frequency")
    fs = bounds["slow"]
    late = F.timestamp_diff("MICROSECOND", F.lit(bounds["t0"]).cast("timestamp_ntz"), F.col("start_time"))
    placed = records.select("record_id", F.round(late * F.lit(fs / 1e6)).cast("long").alias("first"), F.col("n").cast("long").alias("n"))
    total = placed.agg(F.max(F.col("first") + F.col("n"))).first()[0]
    held = chunks.where(F.size("samples") > 0)
    spans = held.groupBy("channel", "record_id").agg(F.min("channel_pos").alias("channel_pos")).join(placed, "record_id")
    order = Window.partitionBy("channel").orderBy("first", "record_id")
    before = F.coalesce(F.max(F.col("first") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("covered")
    place = F.min("channel_pos").over(Window.partitionBy("channel")).alias("place")
    swept = spans.select("channel", "record_id", "first", "n", place, before)

    own = swept.select("channel", "record_id", "place", "first", F.greatest(F.col("covered") - F.col("first"), F.lit(0)).alias("own"))
    met = held.select("record_id", "channel", "start", "samples").join(own, ["record_id", "channel"])
    drop = F.greatest(F.col("own") - F.col("start"), F.lit(0))
    kept = met.where(F.col("start") + F.size("samples") > F.col("own")).select(
        F.lit(name).alias("record_id"), F.col("place").alias("channel_pos"), "channel", (F.col("first") + F.col("start") + drop).alias("start"),
        F.slice("samples", (drop + 1).cast("int"), F.size("samples")).alias("samples"),
    )

    inner = swept.select("channel", "place", F.col("covered").alias("a"), F.col("first").alias("b"))
    ends = swept.groupBy("channel", "place").agg(F.max(F.col("first") + F.col("n")).alias("a")).select("channel", "place", "a", F.lit(total).alias("b"))
    gaps = inner.unionByName(ends).where("b > a").select("channel", "place", "b", F.explode(F.sequence("a", F.col("b") - 1, F.lit(gap_row).cast("long"))).alias("start"))
    filler = F.lit(float("nan") if fill is None else float(fill))
    filled = gaps.select(
        F.lit(name).alias("record_id"), F.col("place").alias("channel_pos"), "channel", "start",
        F.array_repeat(filler, F.least(F.col("b") - F.col("start"), F.lit(gap_row)).cast("int")).alias("samples"),
    )
    return Chunked(kept.unionByName(filled), replace(meta, start_time=bounds["t0"], fs=fs, n=total))
