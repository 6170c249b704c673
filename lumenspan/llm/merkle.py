"""A Merkle manifest of a dataset, with inclusion proofs by parent-preimage paths.

Rows are leaves, trees stand in scopes (one a language), and the scopes' roots are the leaves of one more tree. Every
parent is stored with its preimage, the hashes of its children one after another. A leaf joins the preimages of its
ancestors: with its own 64 characters cut out they are the siblings, with another hash put there instead they fold up to
the root that this hash would give.

Trees are built 512 leaves at a time, nine levels in one step, so that a forest of 10^10 leaves takes four shuffles, and no
group is larger than a block whatever a scope holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.sparkkit import cut, partitions, small

#: Characters of a hash as hex text.
SLOT = 64
#: Levels of a block.
HEIGHT = 9
NODE = ("scope", "n", "pos", "hash")


def digest(*columns: str) -> Column:
    """Of one row: its values as `length:value` in UTF-8 bytes, nulls as `-`."""
    shown = [F.col(c).cast("string") for c in columns]
    parts = [F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in shown]
    return F.sha2(F.concat(*parts), 256)


def scope_of(column: str) -> Column:
    """A string that is never null and sorts as the column does, nulls first."""
    return F.when(F.col(column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (scope, hash, ...) with pos, their number in the scope by `order`, nulls first, and n, the scope's nodes.

    Rows are dealt by ranges of (scope, order, input order), so a scope with most rows, or many rows of one place in the
    order, spread over tasks; a rank is a row's number in its task plus what the scope has in the tasks before."""
    place = ["scope", *order, "tie"]
    rows = cut(nodes.withColumn("tie", F.monotonically_increasing_id()))
    dealt = rows.repartitionByRange(partitions(nodes.sparkSession), *place).sortWithinPartitions(*place)
    dealt = cut(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("task", F.shiftright("at", 33))
    here = dealt.groupBy("scope", "task").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    counts = cut(here.selectExpr("scope", "task", "first - coalesce(sum(rows) OVER (PARTITION BY scope ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift", "sum(rows) OVER (PARTITION BY scope) AS n"))
    return dealt.join(small(counts), ["scope", "task"]).withColumn("pos", F.col("at") - F.col("shift")).drop("task", "at", "shift")


def levels_of(n: Column) -> Column:
    """How often n nodes are halved, rounding up, until one is left."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def preimages_over(hashes: Column) -> Column:
    """Every two hashes one after another; a last one without a second alone."""
    pair = lambda j: F.concat(F.get(hashes, 2 * j), F.coalesce(F.get(hashes, 2 * j + 1), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int")), pair)


def blocks_of(nodes: DataFrame) -> DataFrame:
    """scope, n, block, nodes, height, preimages (of each level's parents, from the lowest), hash (the block's top)."""
    held = F.struct("pos", *[c for c in nodes.columns if c not in ("scope", "n", "pos")])
    found = nodes.groupBy("scope", "n", F.shiftright("pos", HEIGHT).alias("block")).agg(F.array_sort(F.collect_list(held)).alias("nodes"))
    found = found.withColumn("height", F.least(F.lit(HEIGHT), levels_of(F.col("n")))).withColumn("h0", F.transform("nodes", lambda x: x["hash"]))
    for k in range(1, HEIGHT + 1):
        parents = preimages_over(F.col(f"h{k - 1}"))
        found = found.withColumn(f"p{k}", F.when(F.col("height") >= k, parents))
        found = found.withColumn(f"h{k}", F.transform(f"p{k}", lambda p: F.sha2(p, 256)))
    top = F.coalesce(*[F.get(f"h{k}", F.lit(0)) for k in range(HEIGHT, -1, -1)])
    preimages = F.slice(F.array(*[f"p{k}" for k in range(1, HEIGHT + 1)]), F.lit(1), F.col("height"))
    return found.select("scope", "n", "block", "nodes", "height", preimages.alias("preimages"), top.alias("hash"))


@dataclass(frozen=True)
class Forest:
    """tiers: blocks, the next tier over the tops of the one before; roots: scope, n, hash."""

    tiers: list[DataFrame]
    roots: DataFrame


def forest(nodes: DataFrame) -> Forest:
    """Trees over ranked nodes: every two consecutive ones become their hash, a last lone one too, until one is left."""
    largest = nodes.agg(F.max("n")).first()[0] or 1
    tiers, roots, now = [], [], nodes
    while True:
        blocks = cut(blocks_of(now))
        tiers.append(blocks)
        roots.append(blocks.where(F.col("n") <= 1 << HEIGHT).select("scope", "n", "hash"))
        if largest <= 1 << HEIGHT:
            break
        largest = -(-largest // (1 << HEIGHT))
        more = F.shiftright(F.col("n") + (1 << HEIGHT) - 1, HEIGHT)
        now = blocks.where(F.col("n") > 1 << HEIGHT).select("scope", more.alias("n"), F.col("block").alias("pos"), "hash")
    every = roots[0]
    for r in roots[1:]:
        every = every.unionByName(r)
    return Forest(tiers, every)


def manifest(found: Forest) -> DataFrame:
    """scope, level (from 1), node, preimage of every parent."""
    parts = []
    for k, blocks in enumerate(found.tiers):
        levels = blocks.select("scope", "block", F.posexplode("preimages").alias("i", "parents"))
        rows = levels.select("scope", "block", "i", F.posexplode("parents").alias("j", "preimage"))
        node = F.expr(f"shiftleft(block, {HEIGHT} - 1 - i) + j")
        parts.append(rows.select("scope", (F.col("i") + 1 + k * HEIGHT).alias("level"), node.alias("node"), "preimage"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def with_paths(found: Forest, upper: DataFrame) -> DataFrame:
    """The nodes of the lowest tier with path, their ancestors' (preimage, slot) from the lowest up. upper: scope, path and
    further columns; its path goes on where a scope's own tree ends, its other columns are carried along."""
    carried = [c for c in upper.columns if c not in ("scope", "path")]
    rows = None
    for blocks in reversed(found.tiers):
        own = blocks.select("scope", "n", "block", "nodes", "preimages")
        last = own.where(F.col("n") <= 1 << HEIGHT).join(upper, "scope")
        joined = last if rows is None else last.unionByName(own.where(F.col("n") > 1 << HEIGHT).join(rows, ["scope", "block"]))
        each = joined.select("scope", "preimages", "path", *carried, F.explode("nodes").alias("node"))
        local = F.col("node.pos").bitwiseAND((1 << HEIGHT) - 1).cast("int").alias("local")
        each = each.select("*", local)
        step = lambda parents, i: F.struct(F.get(parents, F.call_function("shiftright", F.col("local"), i + 1)).alias("preimage"), F.call_function("shiftright", F.col("local"), i).bitwiseAND(1).alias("slot"))
        path = F.concat(F.transform("preimages", step), F.col("path")).alias("path")
        rows = each.select("scope", F.col("node.pos").alias("block"), path, *carried, "node")
        if blocks is not found.tiers[0]:
            rows = rows.drop("node")
    kept = [c for c in found.tiers[0].schema["nodes"].dataType.elementType.fieldNames() if c != "pos"]
    return rows.select("scope", F.col("block").alias("pos"), "path", *carried, *[F.col(f"node.{c}").alias(c) for c in kept])


def siblings(path: Column | str) -> Column:
    """What remains of every preimage without the slot of the path, one after another."""
    others = F.transform(path, lambda s: F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * SLOT), F.substr(s["preimage"], s["slot"] * SLOT + SLOT + 1, F.lit(SLOT))))
    return F.array_join(others, "")


def folded(path: Column | str, leaf: Column | str) -> Column:
    """The root that leaf gives with the siblings of the path."""
    splice = lambda h, s: F.sha2(F.overlay(s["preimage"], h, s["slot"] * SLOT + 1, F.lit(SLOT)), 256)
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, splice)


def prove(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves: scope (never null), hash, claim and what `order` names. Per leaf, in the order's columns: hash, subroot, root,
    proof (all its siblings, from the lowest level up), folded (the root from its claim and these siblings), path.

    Ties in `order` go by hash, rows equal there in input order, which changes nothing but which of them has which proof.
    Nulls in `order` come first. An empty table gives an empty result; other columns are not looked at."""
    own = leaves.select("scope", *order, "hash", "claim")
    trees = forest(ranked(own, [*order, "hash"]))
    roots = cut(trees.roots)
    top = forest(ranked(roots.select(F.lit("").alias("scope"), F.col("scope").alias("name"), "hash"), ["name"]))
    nothing = F.array().cast("array<struct<preimage: string, slot: int>>")
    above = with_paths(top, top.roots.select("scope", nothing.alias("path"), F.col("hash").alias("root")))
    upper = cut(above.select(F.col("name").alias("scope"), "path", F.col("hash").alias("subroot"), "root"))
    found = with_paths(trees, upper)
    return found.select(*order, "hash", "claim", "subroot", "root", siblings("path").alias("proof"), folded("path", "claim").alias("folded"), "path")


def tampered(every: int = 7) -> Column:
    """Whether the check of every seventh row, by the crc32 of its decimal doc_id, is given a changed row; never for a null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))


def check_documents(docs: DataFrame) -> DataFrame:
    """Every row of documents is a leaf; rows that tampered() names are checked with n_chars + 1 (a null n_chars stays, so
    such a row verifies). Null values count in the hash as `-`; a null language is a scope of its own, before all others;
    null ids come first in a scope. Rows of equal doc_id are ordered by their hash, equal rows are leaves each. Columns
    but doc_id, source, lang, n_chars and text are not hashed."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    original = docs.select(*columns)
    leaf = digest(*columns)
    changed = original.select(*columns, leaf.alias("hash")).withColumn("n_chars", F.col("n_chars") + 1)
    claim = F.when(tampered(), digest(*columns)).otherwise(F.col("hash")).alias("claim")
    return prove(changed.select(scope_of("lang").alias("scope"), "doc_id", "hash", claim), ["doc_id"])
