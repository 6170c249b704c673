"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Every task of the scan (in runs of at most 2^18 rows) is a sender. It sorts the fingerprints of its normalised texts and
sends each owner those of its range, once each, as Golomb-Rice codes of their differences; a few bytes a text. An owner
sees which fingerprints come from several senders and answers each list with a bitmap. Rows whose fingerprint is marked,
or stands twice with their own sender, are suspects; only their texts are shuffled, and compared byte for byte. All other
rows are done. Copies within a task are put together before anything is shuffled, so a text that a third of all rows
share costs an owner no more than another one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.sparkkit import cut, partitions, small

SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a sender and distinct fingerprints of an owner, about at most.
RUN_BITS, OWNED = 18, 1 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def rice(ordered: np.ndarray, base: int, span: int) -> tuple[int, bytes]:
    """Golomb-Rice codes of the steps between distinct ordered numbers in [base, base + span): k and the bits, first all
    quotients in unary, then all remainders in k bits each."""
    n = len(ordered)
    steps = np.diff(ordered, prepend=np.uint64(base))
    k = max(0, int(np.log2(max(1.0, 0.69 * span / max(n, 1)))))
    ends = np.cumsum((steps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)[::-1]
    rest = ((steps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(np.concatenate([unary, rest.ravel()])).tobytes()


def unrice(data: bytes, k: int, n: int, base: int) -> np.ndarray:
    """The numbers that rice() coded."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    ends = np.flatnonzero(bits[: len(bits) - n * k])[:n]
    if not n:
        return np.zeros(0, np.uint64)
    quotients = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    at = int(ends[-1]) + 1
    rest = np.zeros(n, np.uint64)
    for column in bits[at : at + n * k].reshape(n, k).T:
        rest = (rest << np.uint64(1)) | column
    return np.cumsum((quotients << np.uint64(k)) | rest, dtype=np.uint64) + np.uint64(base)


def split(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, how often each stands here, and where each owner's begin (and the last ones end)."""
    ordered, counts = np.unique(prints, return_counts=True)
    owners = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return ordered, counts, np.concatenate([[0], np.searchsorted(ordered, owners), [len(ordered)]])


def unsigned(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


MESSAGE = "sender long, owner int, n int, k int, codes binary"


def send(bits: int):
    """Rows (sender, print), each sender's together, as messages."""
    span = 1 << (64 - bits)

    def messages(sender: int, prints: np.ndarray):
        ordered, _, at = split(prints, bits)
        owners = np.flatnonzero(np.diff(at))
        coded = [rice(ordered[at[o] : at[o + 1]], int(o) * span, span) for o in owners]
        columns = [[sender] * len(owners), owners, np.diff(at)[owners], [k for k, _ in coded], [c for _, c in coded]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["sender", "owner", "n", "k", "codes"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            senders, prints = batch.column("sender").to_numpy(), unsigned(batch.column("print"))
            edges = [0, *(np.flatnonzero(np.diff(senders)) + 1).tolist(), len(senders)] if len(senders) else []
            for a, b in zip(edges, edges[1:]):
                if held and senders[a] != now:
                    yield messages(now, np.concatenate(held))
                    held = []
                now = int(senders[a])
                held.append(prints[a:b])
        if held:
            yield messages(now, np.concatenate(held))

    return run


ANSWER = "sender long, owner int, bitmap binary"


def answer(bits: int):
    """An owner's messages: for each a bitmap of those fingerprints that other senders have too."""
    span = 1 << (64 - bits)

    def run(table: pa.Table) -> pa.Table:
        owner, counts = table.column("owner")[0].as_py(), table.column("n").to_pylist()
        lists = [unrice(c, k, n, owner * span) for c, k, n in zip(table.column("codes").to_pylist(), table.column("k").to_pylist(), counts)]
        _, which, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        parts = np.split(often[which] > 1, np.cumsum(counts)[:-1])
        return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "bitmap": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})

    return run


def mark(bits: int):
    """A sender's rows and the answers to it: the rows, with suspect."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.drop_columns(["sender"]).append_column("suspect", pa.array([], pa.bool_()))
        prints = unsigned(rows.column("print"))
        ordered, counts, at = split(prints, bits)
        marked = counts > 1
        for owner, bitmap in zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist()):
            a, b = at[owner], at[owner + 1]
            marked[a:b] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[: b - a].astype(bool)
        return rows.drop_columns(["sender"]).append_column("suspect", pa.array(marked[np.searchsorted(ordered, prints)]))

    return run


def marked(rows: DataFrame) -> DataFrame:
    """rows (print long, sender long, ...; materialised) with suspect, without sender: false where no other row has the
    fingerprint."""
    spark = rows.sparkSession
    owners = max(partitions(spark), -(-rows.count() // OWNED))
    bits = (owners - 1).bit_length()
    messages = rows.select("sender", "print").mapInArrow(send(bits), MESSAGE)
    answers = messages.groupBy("owner").applyInArrow(answer(bits), ANSWER)
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "sender")
    return rows.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(mark(bits), f"{kinds}, suspect boolean")


def duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space, which decides equality).

    The row with most code points in its text stays, then the smallest doc_id (null before all others), and of rows equal
    in both one. A null text counts as empty; all empty texts are one group. Other columns are not looked at. An empty
    table gives an empty result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = normalised(F.col("text"))
    sha = F.sha2(bare, 256)
    # The fingerprint is the digest's beginning; all 16 digits count, so the number goes through decimal.
    number = F.conv(F.substring("sha", 1, 16), 16, -10).cast("long")
    rows = docs.select("doc_id", F.length(text).cast("long").alias("chars"), sha.alias("sha"), F.shiftright(F.monotonically_increasing_id(), RUN_BITS).alias("sender"))
    rows = cut(rows.select("*", number.alias("print")))
    seen = cut(marked(rows))
    suspects = seen.where("suspect")
    prints = cut(suspects.select("print").distinct())
    texts = docs.select("doc_id", F.length(text).cast("long").alias("chars"), bare.alias("bare"))
    texts = texts.withColumn("print", F.conv(F.substring(F.sha2("bare", 256), 1, 16), 16, -10).cast("long"))
    # Texts are the grouping key, so groups are equal byte for byte; tasks put copies together before they are shuffled.
    alike = texts.join(small(prints), "print", "left_semi").groupBy("bare", "chars").agg(F.count("*").alias("rows"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("least"))
    least = F.when(F.col("rows") == F.col("ids"), F.col("least"))  # a null id comes before all others
    place = F.struct((-F.col("chars")).alias("fewer"), least.alias("doc_id")).alias("place")
    narrow = alike.select(F.sha2("bare", 256).alias("sha"), F.xxhash64("bare").alias("other"), "rows", place)
    groups = narrow.groupBy("sha").agg(F.sum("rows").alias("rows"), F.min("place").alias("best"), F.min("other").alias("a"), F.max("other").alias("b"))
    size = F.when(F.col("a") == F.col("b"), F.col("rows")).otherwise(F.raise_error(F.lit("two texts have one SHA-256")))
    groups = cut(groups.select("sha", "best", size.cast("long").alias("group_size")))
    one = suspects.groupBy("sha", "chars", "doc_id").agg(F.count("*").alias("copies"))  # repeated rows
    each = one.join(small(groups), "sha").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    kept = (F.col("copy") == 1) & (-F.col("chars") == F.col("best.fewer")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    shared = each.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
    alone = seen.where("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(shared)
