"""Near-duplicate components without pairs within groups: buckets of candidates, exact verification, union-find.

Items that share a band key are a bucket; items tied through buckets are a family. A small family is compared as it is.
In a large one every item is first compared with a few pivots, a test each, which joins whatever is alike to them. If
few blocks of items are left outside the largest component, these are compared with the family block by block. Else
only buckets whose items are in different components are compared, each on its own, so that an item goes to no more
groups than it has bands, however large the family. A bucket with many blocks left is dealt out by the prefix filter:
two sets of at least the threshold share one of their first few elements in any common order, here that of a hash with
the elements of one item of the bucket last, so what a template repeats deals out nothing. Which way a family goes
changes what is shipped, never what is found. A task computes exact similarities from the texts and lets only links
out that join components. So no candidate pair across components is left untested, and no row is made for a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm.sparkkit import BROADCAST_BYTES, cut, partitions, slices, small, texts_of
from lumenspan.llm.textkit import MIX, mix64

#: Most items, and about the most set elements, in a block.
BLOCK_ROWS, BLOCK_ELEMENTS = 512, 300_000
#: Blocks left over up to which a family, or a bucket, is compared block by block.
FEW_BLOCKS = 16
#: Pairs in a block from which on all overlaps at once are cheaper than one by one.
MANY = 2000
#: Rows of band keys that a task gathers before it combines them.
COMBINED = 400_000
#: Bytes of text whose sets are in memory at once.
SLICE = 500_000
#: Edges that a task of a union-find step has, about: few edges are no hundreds of files a step.
EDGES = 10_000
BANDED = "id long, key long, tie long, at long"
PACKED = "part int, free binary, tied binary"
TIES = "id long, key long, low long"
Sets = Callable[[list[str]], list[np.ndarray]]


class Combiner:
    """Pre-aggregates band keys (id, key) in a task: of those gathered, one id a key goes on as (id, key, null, key), the
    others as ties to it, (id, key, that id, a hash of id), so that a key that many items have is no large group."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.rows = 0

    def add(self, ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Equally long arrays; yields what is due."""
        self.ids.append(ids)
        self.keys.append(keys)
        self.rows += len(ids)
        if self.rows >= COMBINED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            ids, keys = np.concatenate(self.ids), np.concatenate(self.keys)
            order = np.argsort(keys)
            ids, keys = ids[order], keys[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            low = ids[first][np.cumsum(first) - 1]
            fresh = first | (ids != low)
            ids, keys, first, low = ids[fresh], keys[fresh], first[fresh], low[fresh]
            at = np.where(first, keys, mix64(ids.view(np.uint64) * MIX + np.uint64(1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(low, mask=first), pa.array(at)], ["id", "key", "tie", "at"])
        self.ids, self.keys, self.rows = [], [], 0


def ties_of(bands: DataFrame) -> DataFrame:
    """(id, key, low) for rows of Combiners: the ties as they are, and of the other ids of a key all but one as ties to
    that one. Rows of a key meet sorted, so a task holds no more than the last row of the batch before."""

    def run(batches):
        last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            tie, ids, keys = batch.column("tie"), batch.column("id").to_numpy(), batch.column("key").to_numpy()
            free = tie.is_null().to_numpy(zero_copy_only=False)
            own, key = np.concatenate([last[0], ids[free]]), np.concatenate([last[1], keys[free]])
            low = firsts(own, key)
            last = low[-1:], key[-1:]
            other = own != low
            columns = [own[other], ids[~free]], [key[other], keys[~free]], [low[other], tie.drop_null().to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["id", "key", "low"])

    return bands.repartition("at").sortWithinPartitions("at").select("id", "key", "tie").mapInArrow(run, TIES)


def firsts(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each row the first id of its key; equal keys stand together."""
    first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    return ids[first][np.cumsum(first) - 1]


def packed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of a Combiner, dealt by `at` to parts: one row a part and batch, as arrays of numbers in bytes, so that the
    shuffle handles few rows."""
    for batch in batches:
        ids, keys, at = (batch.column(c).to_numpy() for c in ("id", "key", "at"))
        part = ((at.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        free = batch.column("tie").is_null().to_numpy(zero_copy_only=False)
        low = batch.column("tie").fill_null(0).to_numpy()
        columns: dict[str, list] = {"part": [], "free": [], "tied": []}
        order = np.argsort(part.astype(np.int64) << 1 | ~free, kind="stable")
        ids, keys, low, free, part = ids[order], keys[order], low[order], free[order], part[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        tied = starts + np.add.reduceat(free, starts, dtype=np.int64)
        for start, mid, end in zip(starts.tolist(), tied.tolist(), [*starts[1:].tolist(), len(part)]):
            columns["part"].append(part[start])
            columns["free"].append(ids[start:mid].tobytes() + keys[start:mid].tobytes())
            columns["tied"].append(ids[mid:end].tobytes() + keys[mid:end].tobytes() + low[mid:end].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(columns["part"], pa.int32()), *(pa.array(columns[c], pa.binary()) for c in ("free", "tied"))], ["part", "free", "tied"])


def parts_of(spark: SparkSession) -> int:
    """Parts for packed(): several a shuffle partition, so that a task holds the rows of one at a time."""
    return 4 * partitions(spark)


def packed_ties(bands: DataFrame) -> DataFrame:
    """As ties_of, for packed rows: those of a part meet, and a task holds one part."""

    def numbers(blobs: list[bytes], width: int) -> list[np.ndarray]:
        found = [np.frombuffer(b, np.int64).reshape(width, -1) for b in blobs if b]
        return list(np.concatenate(found, axis=1)) if found else [np.zeros(0, np.int64)] * width

    def tied(free: list[bytes], ties: list[bytes]) -> pa.RecordBatch:
        own, key = numbers(free, 2)
        order = np.argsort(key)
        own, key = own[order], key[order]
        low = firsts(own, key)
        other = own != low
        columns = zip((own[other], key[other], low[other]), numbers(ties, 3))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["id", "key", "low"])

    def run(batches):
        now, free, ties = None, [], []
        for batch in batches:
            for part, some, others in zip(*(batch.column(c).to_pylist() for c in ("part", "free", "tied"))):
                if part != now and now is not None:
                    yield tied(free, ties)
                    free, ties = [], []
                now = part
                free.append(some)
                ties.append(others)
        if now is not None:
            yield tied(free, ties)

    return bands.repartition("part").sortWithinPartitions("part").mapInArrow(run, TIES)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the component's least node.

    Alternating large-star and small-star steps until the edge set stands still: a logarithmic number of rounds, each
    cut by a checkpoint. A node's neighbours are only reduced to their minimum, never gathered; the minima are broadcast
    while they are within the bound, and shuffled beyond it, where Spark splits the join partition of a hub."""
    both = F.struct(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = cut(edges.where(F.col("u") != F.col("v")).select(both.alias("e")).select("e.*").distinct())
    mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    last = now.agg(mark.alias("m")).first()["m"]
    dealt = lambda df: df.coalesce(max(1, -(-last["n"] // EDGES)))
    now = dealt(now)
    while last["n"]:
        side = F.broadcast if 2 * 16 * last["n"] <= BROADCAST_BYTES else (lambda df: df.hint("merge"))
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(side(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(side(low), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(dealt(joined.unionByName(low.select("u", F.col("m").alias("v"))).distinct()))
        mine = now.agg(mark.alias("m")).first()["m"]
        if mine == last:
            break
        last = mine
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sets (arrays without repeats) share."""
    both = np.concatenate((x, y))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set (with every other left one if right is None), by
    matrix products over slices of the items that two sets have."""
    sets = left if right is None else [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    shared = often[item]
    owner, item = owner[shared], number[item[shared]]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    out = np.zeros((len(left), len(sets) - len(left) if right is not None else len(left)), np.float32)
    count = int(often.sum())
    for start in range(0, count, width):
        end = min(start + width, count)
        at, to = np.searchsorted(item, [start, end])
        present = np.zeros((len(sets), end - start), np.float32)
        present[owner[at:to], item[at:to] - start] = 1
        out += present @ present.T if right is None else present[: len(left)] @ present[len(left) :].T
    return out


def prefixes(sets: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    """Each set's rarest elements among these sets, as many as two sets of at least `threshold` cannot both miss: one
    more than a set may lose."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, item, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((item, counts[item], owner))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = rank < (sizes - np.ceil(threshold * sizes - 1e-9) + 1)[owner]
    return np.split(item[order][kept], np.cumsum(np.bincount(owner[kept], minlength=len(sets)))[:-1])


def group_links(ids, roots, sets: list[np.ndarray], left, right, threshold: float) -> list[tuple[int, int]]:
    """Links from left to right positions with a similarity of at least threshold, one for each two components.

    Only pairs whose prefixes meet are compared, which loses no link."""
    parent: dict[int, int] = {}
    names = roots.tolist()

    def find(r):
        while (up := parent.get(r, r)) != r:
            parent[r] = r = parent.get(up, up)
        return r

    out = []

    def compare(x, y) -> None:
        p, q = find(names[x]), find(names[y])
        if p != q:
            shared = common(sets[x], sets[y])
            if shared >= threshold * (len(sets[x]) + len(sets[y]) - shared) - 1e-9:
                parent[p] = q
                out.append((int(ids[x]), int(ids[y])))

    within = len(left) == len(right) and bool((left == right).all())
    if len(left) * len(right) <= 150:
        for i, x in enumerate(left):
            for y in left[i + 1 :] if within else right:
                m, n = len(sets[x]), len(sets[y])
                if min(m, n) >= threshold * max(m, n) - 1e-9 and m:
                    compare(x, y)
        return out
    both = np.union1d(left, right)
    place = {p: i for i, p in enumerate(both.tolist())}
    rare = prefixes([sets[i] for i in both], threshold)
    size = np.array([len(v) for v in sets], np.float32)
    a, b = size[left][:, None], size[right][None]
    meet = lambda own: overlaps([own(i) for i in left], None if within else [own(i) for i in right])
    near = meet(lambda i: rare[place[i]]) > 0
    near &= (roots[left][:, None] != roots[right][None]) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-4)
    near = np.triu(near, 1) if within else near
    if np.count_nonzero(near) <= MANY:
        for i, j in np.argwhere(near):
            compare(left[i], right[j])
        return out
    shared = meet(lambda i: sets[i])
    for i, j in np.argwhere(near & (shared >= threshold * (a + b - shared) - 1e-4)):
        compare(left[i], right[j])
    return out


def pivot_links(large: DataFrame, sets_of: Sets, threshold: float, pivots: int) -> DataFrame:
    """Links (a, b) between the items of large families and a few pivots of each, drawn by hashing."""
    drawn = [F.min_by("id", F.xxhash64("id", F.lit(i))) for i in range(pivots)]
    chosen = large.groupBy("family").agg(F.array_distinct(F.array(*drawn)).alias("ids")).select(F.explode("ids").alias("id"))
    texts = large.join(chosen, "id", "left_semi").groupBy("family", "id").agg(F.first("text").alias("text"))
    sides = cut(texts.groupBy("family").agg(F.collect_list(F.struct("id", "text")).alias("pivots")))
    rows = large.join(small(sides), "family").select("id", "text", "pivots")

    def compare(batches):
        known: dict[int, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
            a, b = [], []
            for own, items, others in zip(batch.column("id").to_pylist(), sets_of(texts_of(batch)), batch.column("pivots")):
                for other in others:
                    pivot = other["id"].as_py()
                    if pivot not in known:
                        if len(known) > 64:
                            known.clear()
                        known[pivot] = sets_of([other["text"].as_py()])[0]
                    shared = common(items, known[pivot])
                    if own != pivot and 0 < shared >= threshold * (len(items) + len(known[pivot]) - shared) - 1e-9:
                        a.append(own)
                        b.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def block_links(members: DataFrame, sets_of: Sets, threshold: float) -> DataFrame:
    """Links (a, b) that join components of a group. members: id, group, text, root, settled, bin (null in a large group),
    loose and fixed (its numbers of blocks of items that are not settled, and of settled ones).

    Small groups share bins. In a large one every two blocks meet in a task of their own, but for two settled ones."""
    own = F.when(F.col("settled"), F.col("loose") + F.pmod(F.xxhash64("id"), F.col("fixed"))).otherwise(F.pmod(F.xxhash64("id"), F.col("loose")))
    last = F.when(F.col("settled"), F.col("loose")).otherwise(F.col("loose") + F.col("fixed")) - 1
    others = F.when(F.col("bin").isNotNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), last))
    met = members.withColumn("block", F.when(F.col("bin").isNotNull(), 0).otherwise(own).cast("long")).withColumn("other", F.explode(others))
    pairs = met.select(F.coalesce("bin", "group").alias("bin"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "group", "id", "root", "text")

    def compare(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        block, group, ids, roots = (table.column(c).to_numpy() for c in ("block", "group", "id", "root"))
        distinct, which = np.unique(ids, return_inverse=True)
        texts = table.column("text").take(pa.array(np.unique(which, return_index=True)[1])).to_pylist()
        known, links = sets_of([t or "" for t in texts]), []
        order = np.lexsort((which, group))
        fresh = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (which[order][1:] != which[order][:-1])])
        order = order[fresh]
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            left, right = np.flatnonzero(block[part] == x), np.flatnonzero(block[part] == y)
            if len(left) and len(right):
                links += group_links(ids[part], roots[part], [known[w] for w in which[part]], left, right, threshold)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return pairs.groupBy("bin", "x", "y").applyInArrow(compare, "a long, b long")


def settled(items: DataFrame) -> DataFrame:
    """items (group, id, root, size) of groups in several components, with n and m, the group's numbers of items and of
    elements, whether an item is settled (its component is the group's largest), and loose and fixed, the group's numbers
    of blocks of other items and of settled ones."""
    main = items.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    marked = items.join(small(cut(main)), "group").withColumn("settled", F.col("root") == F.col("main")).drop("main")
    count = lambda c: F.greatest(F.ceil(F.count_if(c) / BLOCK_ROWS), F.ceil(F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)) / BLOCK_ELEMENTS)).cast("long")
    own = F.col("settled")
    blocks = marked.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("m"), count(~own).alias("loose"), count(own).alias("fixed")).where("loose > 0")
    return cut(marked.join(small(cut(blocks)), "group"))


def distinct_groups(items: DataFrame) -> DataFrame:
    """items (group, id, root, size) of one of the groups that have the same ids each, if they are in several components."""
    same = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    groups = items.groupBy("group").agg(*same, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return items.join(small(cut(groups.groupBy("n", "x", "y").agg(F.min("group").alias("group")).select("group"))), "group")


def bucket_items(ties: DataFrame, items: DataFrame) -> DataFrame:
    """(group, id, root, size): items (id, root, size) once for each band key they have among ties. Materialised, since
    groups are counted several times; ties of other items are left out before repeats are."""
    mine = small(items.select("id", "root", "size"))
    ends = [ties.select(F.col("key").alias("group"), F.col(end).alias("id")).join(mine, "id") for end in ("id", "low")]
    return cut(ends[0].unionByName(ends[1]).select("group", "id", "root", "size").distinct())


def one_block() -> Column:
    return (F.col("n") <= BLOCK_ROWS) & (F.col("m") <= BLOCK_ELEMENTS)


def prefix_members(large: DataFrame, texts: DataFrame, sets_of: Sets, threshold: float) -> DataFrame:
    """(group, id, root, size) for items of large groups, a row for each element of the set's prefix; its group from both.

    The common order of a group: elements of its least item's set last, else by value, as these are hashes."""
    pivots = large.groupBy("group").agg(F.min("id").alias("id"))
    others = cut(pivots.join(texts, "id").groupBy("group").agg(F.first("text").alias("other")))
    rows = large.join(texts, "id").join(small(others), "group").select("group", "id", "root", "size", "text", "other")

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
            keys = batch.column("group").to_numpy()
            for i, items in enumerate(sets_of(texts_of(batch))):
                if keys[i] not in known:
                    if len(known) > 64:
                        known.clear()
                    known[keys[i]] = sets_of([batch.column("other")[i].as_py() or ""])[0]
                order = np.lexsort((items, np.isin(items, known[keys[i]], assume_unique=True)))
                first = items[order][: len(items) - int(np.ceil(threshold * len(items) - 1e-9)) + 1]
                group = mix64(mix64(first.astype(np.uint64)) + keys[i].view(np.uint64)).view(np.int64)
                same = [pa.array(np.full(len(first), batch.column(c)[i].as_py(), np.int64)) for c in ("id", "root", "size")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(group)], ["id", "root", "size", "group"])

    return rows.mapInArrow(run, "id long, root long, size long, group long")


def near_components(
    bands: DataFrame, locate: Callable[[DataFrame], DataFrame], fetch: Callable[[DataFrame], DataFrame], sets_of: Sets, threshold: float, pivots: int = 3
) -> DataFrame | None:
    """(id, root) of the items in components of two or more; None if no two items share a band.

    bands: rows of a Combiner, packed or as they are, repeats allowed. locate: ids -> one row an id with its size (set elements, roughly) and
    where it is. fetch: rows of located ids, any columns more -> the same with text (an id may come again). sets_of:
    texts -> sorted distinct 32-bit hashes of each text's set."""
    ties = cut(packed_ties(bands) if "part" in bands.columns else ties_of(bands))
    if ties.isEmpty():
        return None
    families = cut(connected(ties.select(F.col("id").alias("u"), F.col("low").alias("v"))).select(F.col("node").alias("id"), F.col("root").alias("family")))
    placed = cut(locate(families.select("id")).join(small(families), "id"))
    texts = cut(fetch(placed).select("id", "family", "size", "text"))
    sizes = cut(placed.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("m")).withColumn("big", ~one_block()))
    nothing, columns = F.lit(None).cast("long"), ("id", "group", "text", "root", "settled", "bin", "loose", "fixed")

    def binned(groups: DataFrame) -> Column:
        """Bins for groups (n, m) that are no larger than a block, so that each has about a block's work."""
        n, m = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        return F.pmod(F.xxhash64("group"), F.lit(int(max(n / BLOCK_ROWS, m / BLOCK_ELEMENTS)) + 1))

    sized = texts.join(small(sizes.select("family", "big")), "family").withColumnRenamed("family", "group")
    alone = {"root": F.col("id"), "settled": F.lit(False), "bin": binned(sizes.where("NOT big")), "loose": nothing, "fixed": nothing}
    members = sized.where("NOT big").withColumns(alone).select(*columns)
    links = None
    if not sizes.where("big").isEmpty():
        large = cut(sized.where("big").select("id", F.col("group").alias("family"), F.col("size").cast("long").alias("size"), "text").dropDuplicates(["id"]))
        links = cut(pivot_links(large, sets_of, threshold, pivots))
        roots = small(cut(connected(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))).withColumnRenamed("node", "id")
        rooted = settled(large.join(roots, "id", "left").select(F.col("family").alias("group"), "id", F.coalesce("root", "id").alias("root"), "size"))
        left, many = rooted.where(F.col("loose") <= FEW_BLOCKS).withColumn("bin", nothing), rooted.where(F.col("loose") > FEW_BLOCKS)
        if not many.isEmpty():
            buckets = settled(distinct_groups(bucket_items(ties, many)))
            hot = buckets.where(~one_block() & (F.col("loose") > FEW_BLOCKS))
            buckets = buckets.where(one_block() | (F.col("loose") <= FEW_BLOCKS))
            if not hot.isEmpty():
                buckets = buckets.unionByName(settled(distinct_groups(cut(prefix_members(hot, large.select("id", "text"), sets_of, threshold)))))
            bins = binned(buckets.where(one_block()).groupBy("group").agg(F.first("n").alias("n"), F.first("m").alias("m")))
            left = left.unionByName(buckets.withColumn("bin", F.when(one_block(), bins)))
        members = members.unionByName(left.join(large.select("id", "text"), "id").select(*columns))
    found = block_links(members, sets_of, threshold)
    links = cut(found if links is None else links.unionByName(found))
    return cut(connected(links.select(F.col("a").alias("u"), F.col("b").alias("v")))).withColumnRenamed("node", "id")
