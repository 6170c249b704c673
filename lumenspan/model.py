"""Records: one row per channel (the trace layout) plus typed metadata; every operation returns a new Record.

traces : record_id STRING, channel_pos INT, channel DOUBLE, samples ARRAY<DOUBLE>      time-axis operations, no shuffle
samples: record_id STRING, channel_pos INT, channel DOUBLE, sample_idx BIGINT, value DOUBLE      operations across channels
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACES = "record_id string, channel_pos int, channel double, samples array<double>"


@dataclass(frozen=True)
class RecordMeta:
    """What the reader knows of a recording. n is the true number of samples a channel; end_time is exclusive."""

    fs: float
    n: int
    start_time: datetime
    spatial_interval: float = 1.0
    gauge_length: float = 1.0
    company: str = "generic"
    format: str = "table"
    fiber: str = "standard"
    filepath: str = ""
    channel_offset: int | None = None
    units: str | None = None
    conv_factor: float | None = None
    corrected: bool = False
    sensing: str = "das"
    properties: dict[str, str] = field(default_factory=dict)

    @property
    def dt(self) -> float:
        return 1.0 / self.fs

    @property
    def time_length(self) -> float:
        return self.n / self.fs

    def time_of(self, index: float) -> datetime:
        """Start plus index samples, from the index in whole microseconds, never accumulated."""
        return self.start_time + timedelta(microseconds=round(index * 1e6 / self.fs))

    @property
    def end_time(self) -> datetime:
        return self.time_of(self.n)


@dataclass(frozen=True)
class Record:
    traces: DataFrame
    meta: RecordMeta

    def copy(self) -> Record:
        """Records never change, so a copy is the record."""
        return self

    def with_samples(self, samples: Column, **changes) -> Record:
        """Same channels, new samples."""
        return Record(self.traces.withColumn("samples", samples), replace(self.meta, **changes))

    def map_traces(self, kernel: Callable[[np.ndarray], np.ndarray], **changes) -> Record:
        """Apply a NumPy function of a (channels, samples) matrix, a batch of equally long traces at a time.

        Arrow keeps NaN apart from null; null samples arrive as NaN. Empty batches are passed over."""

        def run(batches):
            for batch in batches:
                column = batch.column("samples")
                lengths = np.diff(column.offsets.to_numpy())
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
                starts = np.cumsum(lengths) - lengths
                for n in np.unique(lengths):
                    rows = np.flatnonzero(lengths == n)
                    matrix = flat[starts[rows][:, None] + np.arange(n)]
                    out = np.atleast_2d(kernel(matrix)).astype(float)
                    part = batch.take(pa.array(rows))
                    offsets = pa.array(np.arange(len(rows) + 1) * out.shape[1], pa.int32())
                    arrays = [part.column(i) for i in range(3)]
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1))))
                    yield pa.RecordBatch.from_arrays(arrays, ["record_id", "channel_pos", "channel", "samples"])

        plain = self.traces.select("record_id", "channel_pos", "channel", "samples").where(F.col("samples").isNotNull())
        return Record(plain.mapInArrow(run, TRACES), replace(self.meta, **changes))

    def samples(self) -> DataFrame:
        """The sample layout."""
        columns = ("record_id", "channel_pos", "channel")
        long = self.traces.select(*columns, F.posexplode("samples").alias("sample_idx", "value"))
        return long.withColumn("sample_idx", F.col("sample_idx").cast("long"))

    def _time(self, index: Column, time_type: str) -> Column:
        """When sample number index was taken: a timestamp (UTC), an ISO string (isoformat) or days since 1970-01-01
        (matplotlib)."""
        micros = F.round(index * (1e6 / self.meta.fs)).cast("long")
        stamp = F.timestamp_add("MICROSECOND", micros, F.lit(self.meta.start_time).cast("timestamp_ntz"))
        epoch = F.unix_micros(stamp.cast("timestamp"))
        kinds = {
            "UTC": stamp,
            "UTCDateTime": stamp,
            "isoformat": F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
            "matplotlib": epoch / F.lit(86_400e6),
        }
        if time_type not in kinds:
            raise ValueError(f"time_type must be one of {sorted(kinds)}")
        return kinds[time_type]

    def times(self, time_type: str = "UTC") -> DataFrame:
        """sample_idx and time for the actual number of rows."""
        index = self.traces.sparkSession.range(self.meta.n)
        return index.select(F.col("id").alias("sample_idx"), self._time(F.col("id"), time_type).alias("time"))

    def timed_samples(self, time_type: str = "UTC") -> DataFrame:
        """The sample layout with each sample's time."""
        return self.samples().withColumn("time", self._time(F.col("sample_idx"), time_type))

    def metadata(self) -> DataFrame:
        """(key, value) rows of all metadata and properties."""
        own = {k: v for k, v in vars(self.meta).items() if k != "properties"}
        own |= {"dt": self.meta.dt, "end_time": self.meta.end_time, "time_length": self.meta.time_length}
        rows = [(k, None if v is None else str(v)) for k, v in {**own, **self.meta.properties}.items()]
        return self.traces.sparkSession.createDataFrame(rows, "key string, value string")


def from_samples(long: DataFrame, meta: RecordMeta) -> Record:
    """Gather the sample layout into traces; missing sample numbers are not filled."""
    pair = F.struct("sample_idx", "value")
    gathered = long.groupBy("record_id", "channel_pos", "channel").agg(F.array_sort(F.collect_list(pair)).alias("s"))
    return Record(gathered.select("record_id", "channel_pos", "channel", F.transform("s", lambda s: s["value"]).alias("samples")), meta)


def from_matrix(spark: SparkSession, matrix: np.ndarray, meta: RecordMeta, record_id: str = "r", channels=None) -> Record:
    """A record of a small in-memory matrix (time by channel), for tests and interactive use."""
    labels = range(matrix.shape[1]) if channels is None else channels
    rows = [(record_id, i, float(c), [float(x) for x in matrix[:, i]]) for i, c in enumerate(labels)]
    return Record(spark.createDataFrame(rows, TRACES), replace(meta, n=matrix.shape[0]))
