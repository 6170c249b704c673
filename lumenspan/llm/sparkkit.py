"""Small Spark helpers that the corpus operators share: reliable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder from spark.checkpoint.dir. Where it is unset, a local master (tests) gets a
    temporary folder; on a cluster that is an error, as executors do not share such folders."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df once in the shared checkpoint folder; later readers survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Most bytes of a side that is broadcast.
BROADCAST_BYTES = 8 << 20


def bytes_of(schema: T.StructType) -> Column:
    """About how many bytes a row of this schema takes, from the values themselves."""
    own = []
    for f in schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            own.append(F.octet_length(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            own.append(F.octet_length(F.col(f.name).cast("string")))
    return reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), own, F.lit(16 + 8 * len(schema.fields)).cast("long"))


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a materialised df if its rows, counted in bytes, fit the bound; beyond it Spark shuffles."""
    total = df.agg(F.sum(bytes_of(df.schema))).first()[0] or 0
    return F.broadcast(df) if total <= max_bytes else df.hint("merge")


#: Long texts make the usual 10,000 rows a batch heavy on both sides of the pipe to Python.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def light_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCHES (smaller settings stay). Registered queries and pipeline stages call
    this; operators leave the session as it is, and work with any setting."""
    for name, most in BATCHES.items():
        now = str(spark.conf.get(name)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once: Spark inlines a projected column wherever it is used, a lambda's variable
    never."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, width: int = 256) -> Column:
    """Running totals of an array of integers, in blocks of `width`, so that no array grows element by element."""

    def scan(some: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"] + v)).alias("out"))
        return F.aggregate(some, begin, step)["out"]

    def summed(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: F.slice(v, b * width + 1, F.lit(width)))
        starts = lambda parts: F.concat(F.array(F.lit(0)), scan(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), F.lit(0)))
        return let(blocks, lambda parts: F.flatten(F.zip_with(parts, F.slice(starts(parts), F.lit(1), F.size(parts)), scan)))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(F.when(F.size(v) <= width, scan(v, F.lit(0))).otherwise(summed(v))))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of batch with about max_bytes of the text column each (a longer text comes alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column; a null counts as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]
