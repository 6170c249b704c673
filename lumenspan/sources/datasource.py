"""spark.read.format("lumenspan"): recordings as a Python data source.

For files on a disk or mount that all executors share; recordings.traces_of reads any path Spark itself can open.
Options: path (a file, folder or glob), vendor, and channels (labels, comma-separated). Filters on channel (=, IN) are
pushed down like the option.

spark.read.format("lumenspan_chunks") reads .npy (time by channel) and TDMS recordings of any size in chunks of time, one a
partition, planned from the files' headers alone; a task maps its file and touches only the wanted channels of its samples
(of interleaved files, only its rows). Options: path, channels, size (samples a chunk, 1,000,000), first and last (samples,
last not included). Filters on channel, and on start (=, <, <=, >, >=), are pushed down: chunks and channels that they
exclude are not planned or read."""

from __future__ import annotations

import glob
import mmap
import os
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lumenspan.model import TRACES
from lumenspan.operators.chunks import CHUNKS
from lumenspan.sources.parsers import measurement_channels, parse, piece_values, tdms_layout


def mapped(file: str):
    """The file's bytes, read as they are touched."""
    with open(file, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class RecordingReader(DataSourceReader):
    """One partition a file; only the wanted channels leave it."""

    def __init__(self, options: dict[str, str]):
        path = options["path"]
        self.files = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path))
        if not self.files:
            raise ValueError(f"no files at {path}")
        self.vendor = options.get("vendor", "silixa")
        self.channels = {float(c) for c in options["channels"].split(",")} if options.get("channels") else None
        self.filtered: set[float] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes those that name channels; all others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("channel",):
                named = {float(v) for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
                self.filtered = named if self.filtered is None else self.filtered & named
            else:
                yield f

    def kept(self, labels: list[float]) -> list[tuple[int, int]]:
        """(position, number in the file) of the wanted channels. Positions count those that the options name, so a filter
        does not move them."""
        named = [i for i, c in enumerate(labels) if self.channels is None or float(c) in self.channels]
        return [(pos, i) for pos, i in enumerate(named) if self.filtered is None or float(labels[i]) in self.filtered]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition):
        if partition.value.endswith(".tdms"):
            data = mapped(partition.value)
            _, pieces = tdms_layout(data)
            channels = measurement_channels(pieces)
            labels, values = [k for k, _ in channels], lambda i: piece_values(data, pieces[channels[i][1]])
        else:
            with open(partition.value, "rb") as f:
                _, matrix, labels = parse(partition.value, self.vendor, f.read())
            values = lambda i: matrix[:, i]
        for pos, i in self.kept(labels):
            columns = [pa.array([partition.value]), pa.array([pos], pa.int32()), pa.array([float(labels[i])]), pa.array([values(i)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["record_id", "channel_pos", "channel", "samples"])


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumenspan"

    def schema(self) -> str:
        return TRACES

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))


@dataclass
class ChunkPartition(InputPartition):
    file: str
    start: int
    end: int


class ChunkReader(RecordingReader):
    """A partition for each chunk of each file."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.size, self.first = int(options.get("size", 1_000_000)), int(options.get("first", 0))
        self.last = int(options["last"]) if options.get("last") else None
        self.bounds: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in super().pushFilters(filters):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("start",):
                self.bounds.append(f)
            else:
                yield f

    def wanted(self, start: int) -> bool:
        holds = {EqualTo: start.__eq__, GreaterThan: start.__gt__, GreaterThanOrEqual: start.__ge__, LessThan: start.__lt__, LessThanOrEqual: start.__le__}
        return all(holds[type(f)](int(f.value)) for f in self.bounds)

    def length(self, file: str) -> int:
        """Samples of a recording, from its headers."""
        if file.endswith(".tdms"):
            _, pieces = tdms_layout(mapped(file))
            return min(sum(p.count for p in pieces[path]) for _, path in measurement_channels(pieces))
        return len(np.load(file, mmap_mode="r", allow_pickle=False))

    def partitions(self) -> list[InputPartition]:
        found = []
        for file in self.files:
            n = self.length(file)
            end = n if self.last is None else min(n, self.last)
            found += [ChunkPartition(file, at, min(at + self.size, end)) for at in range(self.first, end, self.size) if self.wanted(at - self.first)]
        return found

    def read(self, partition: ChunkPartition):
        if partition.file.endswith(".tdms"):
            data = mapped(partition.file)
            _, pieces = tdms_layout(data)
            channels = measurement_channels(pieces)
            labels = [k for k, _ in channels]
            values = lambda i: piece_values(data, pieces[channels[i][1]], partition.start, partition.end)
        else:
            rows = np.load(partition.file, mmap_mode="r", allow_pickle=False)[partition.start : partition.end]
            labels, values = [float(i) for i in range(rows.shape[1])], lambda i: np.asarray(rows[:, i], float)
        for pos, i in self.kept(labels):
            samples = pa.array([values(i)], pa.list_(pa.float64()))
            columns = [pa.array([partition.file]), pa.array([pos], pa.int32()), pa.array([labels[i]]), pa.array([partition.start - self.first]), samples]
            yield pa.RecordBatch.from_arrays(columns, ["record_id", "channel_pos", "channel", "start", "samples"])


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumenspan_chunks"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Both sources, with Spark's pushing of filters into Python sources, which is off otherwise."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
    spark.dataSource.register(ChunkSource)
