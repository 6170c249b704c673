"""Recordings from any path that Spark can read: files arrive as bytes and are parsed on the executors, one a task."""

from __future__ import annotations

import pickle
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenspan.model import TRACES, Record, RecordMeta
from lumenspan.sources.parsers import parse


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def traces_of(spark: SparkSession, path: str, company: str, channels: list[float] | None = None) -> DataFrame:
    """Trace rows of all files under path (a glob or folder works), record_id being the file; channels by label."""
    wanted = None if channels is None else {float(c) for c in (channels if isinstance(channels, (list, tuple)) else [channels])}

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                _, matrix, labels = parse(name, company, content.as_py())
                kept = [i for i, c in enumerate(labels) if wanted is None or float(c) in wanted]
                for pos, i in enumerate(kept):
                    samples = pa.array([matrix[:, i]], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pos], pa.int32()), pa.array([float(labels[i])]), samples], ["record_id", "channel_pos", "channel", "samples"])

    return _files(spark, path).mapInArrow(run, TRACES)


def metas_of(spark: SparkSession, path: str, company: str) -> DataFrame:
    """record_id, start_time, n, fs and the pickled metadata of every file: a row a file, samples stay behind."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                meta = replace(parse(name, company, content.as_py())[0], filepath=name)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([meta.start_time], pa.timestamp("us")), pa.array([meta.n]), pa.array([meta.fs]), pa.array([pickle.dumps(meta)])],
                    ["record_id", "start_time", "n", "fs", "meta"],
                )

    return _files(spark, path).mapInArrow(run, "record_id string, start_time timestamp_ntz, n long, fs double, meta binary")


def open_recording(spark: SparkSession, path: str, company: str = "silixa", channels: list[float] | None = None) -> Record:
    """One file as a Record."""
    rows = metas_of(spark, path, company).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("open_recording takes one file; traces_of and metas_of take many")
    meta: RecordMeta = pickle.loads(bytes(rows[0]["meta"]))
    return Record(traces_of(spark, path, company, channels), meta)


def write_parquet(record: Record, path: str) -> None:
    """Traces as Parquet, by record."""
    record.traces.write.partitionBy("record_id").parquet(path)


def tree(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(file, path, kind) of the groups and datasets of HDF5 files; needs h5py."""

    def run(batches):
        import io

        import h5py

        from lumenspan.sources.parsers import scan_tree

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with h5py.File(io.BytesIO(content.as_py()), "r") as f:
                    rows = list(scan_tree(f, recursive=recursive))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([p for p, _ in rows]), pa.array([k for _, k in rows])], ["file", "path", "kind"])

    return _files(spark, path).mapInArrow(run, "file string, path string, kind string")
