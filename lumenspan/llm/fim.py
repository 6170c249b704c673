"""Fill-in-the-middle: documents cut in three at unit boundaries, as relations of units.

A text is a relation of units, the matches of a pattern from left to right (characters that no match takes are units of
their own). Matches are exploded with their ordinals, windows add up their lengths, requests to cut after so many units
join them by ordinal, their offsets meet per document, and the text is cut there by substring. Matches stand in blocks of
1,024 consecutive ones: a row for each code point would shuffle some twenty times the text, a row a block a fiftieth of
it; within a block that a cut falls into, its first units are added up next to the substring."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.sparkkit import let

#: One code point.
UNIT = "."
BLOCK = 1024
#: Prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
KEY = ["fim_key", "fim_key2"]


def one(unit: str) -> str:
    return f"(?s)(?:{unit}|.)"


def draws(seed: int, doc_id: str = "doc_id") -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of `seed:doc_id`; a null id counts as no characters."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def offsets(texts: DataFrame, seed: int, unit: str = UNIT, block: int = BLOCK) -> DataFrame:
    """texts: KEY, doc_id, text. Per text that has units: KEY, n, and for both cuts the characters before the block that
    the cut falls into (prefix_at, middle_at), the block's characters (.._size) and the units to go there (.._units)."""
    blocks = F.regexp_extract_all("text", F.lit(f"(?s)(?:{unit}|.){{1,{block}}}"), F.lit(0))
    sized = lambda found: F.transform(found, lambda p, i: F.struct(F.when(i < F.size(found) - 1, F.lit(block)).otherwise(F.regexp_count(p, F.lit(one(unit)))).alias("units"), F.length(p).alias("chars")))
    rows = texts.select(*KEY, "doc_id", F.posexplode(let(blocks, sized)).alias("block", "b"))
    rows = rows.groupBy(*KEY, "doc_id", "block").agg(F.max("b.units").cast("long").alias("units"), F.max("b.chars").cast("long").alias("chars"))  # repeated rows
    before = Window.partitionBy(*KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("at"), F.sum("units").over(Window.partitionBy(*KEY)).alias("n"))
    h1, h2 = draws(seed)[:2]
    asked = rows.where("block = 0").select(*KEY, "n", (h1 % (F.col("n") + 1)).alias("a"), (h2 % (F.col("n") + 1)).alias("b"))
    asked = asked.select(*KEY, F.posexplode(F.array(F.least("a", "b"), F.greatest("a", "b"))).alias("cut", "ordinal"))
    asked = asked.select(*KEY, "cut", "ordinal", F.greatest(F.floor((F.col("ordinal") - 1) / block), F.lit(0)).cast("int").alias("block"))
    met = rows.join(asked, [*KEY, "block"])
    of = lambda k, c: F.max(F.when(F.col("cut") == k, c))
    both = [x for k, name in enumerate(("prefix", "middle")) for x in (of(k, F.col("at")).alias(f"{name}_at"), of(k, F.col("chars")).alias(f"{name}_size"), of(k, F.col("ordinal") - F.col("block") * block).alias(f"{name}_units"))]
    return met.groupBy(*KEY).agg(F.max("n").alias("n"), *both)


def transform(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, unit: str = UNIT, sentinels: tuple[str, str, str] = SENTINELS, block: int = BLOCK) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    The draws of a document follow from seed and doc_id alone. Text that is null counts as empty; an empty text, one that
    holds a sentinel and one that is not drawn stays plain: output is the text, both counts are null. Rows of equal doc_id
    and text are cut alike; a null doc_id draws as one without characters. Other columns of docs stay, but those that the
    result adds replace columns of their names. `unit` is a pattern that matches no empty string; sentinels begin with a
    character that they hold once. An empty table gives an empty result."""
    prefix, suffix, middle = sentinels
    if any(s.count(s[0]) > 1 for s in sentinels) or len({s for s in sentinels}) < 3:
        raise ValueError(f"sentinels would not be found again: {sentinels}")
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in docs.columns if c not in added]
    text = F.coalesce(F.col("text"), F.lit(""))
    key = [F.xxhash64("doc_id", text).alias(KEY[0]), F.xxhash64(F.lit(seed), "doc_id", text).alias(KEY[1])]
    cuts = offsets(docs.select(*key, "doc_id", text.alias("text")), seed, unit, block)
    held = docs.select(F.struct(*kept).alias("row"), *key)
    rows = held.join(cuts, KEY, "left").select("row", *cuts.columns[2:], F.coalesce("row.text", F.lit("")).alias("text"), F.col("row.doc_id").alias("doc_id"))
    first = lambda units, r: F.aggregate(F.slice(units, F.lit(1), r.cast("int")), F.lit(0).cast("long"), lambda a, u: a + F.length(u))
    inside = lambda name: F.regexp_extract_all(F.substr("text", (F.col(f"{name}_at") + 1).cast("int"), F.col(f"{name}_size").cast("int")), F.lit(one(unit)), F.lit(0))
    end = lambda name: F.col(f"{name}_at") + first(inside(name), F.col(f"{name}_units"))
    h3, h4 = draws(seed)[2:]
    has = [F.contains("text", F.lit(s)) for s in sentinels]
    plain = (F.col("text") == "") | has[0] | has[1] | has[2] | (h3 % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("row", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"), form.alias("form"), *cuts.columns[3:])
    cut = F.col("form") != "plain"
    rows = rows.select("row", "text", "n", "form", F.when(cut, end("prefix")).alias("p"), F.when(cut, end("middle")).alias("q"))
    number = lambda c: c.cast("int")
    a = F.substr("text", F.lit(1), number(F.col("p")))
    b = F.substr("text", number(F.col("p") + 1), number(F.col("q") - F.col("p")))
    c = F.substr("text", number(F.col("q") + 1), F.length("text"))
    psm = F.concat(F.lit(prefix), a, F.lit(suffix), c, F.lit(middle), b)
    spm = F.concat(F.lit(suffix), c, F.lit(prefix), a, F.lit(middle), b)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("row.*", "n", "form", F.col("p").alias("prefix_chars"), (F.col("q") - F.col("p")).alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, from an output and its form alone."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    order = lambda *at: let(parts, lambda p: F.concat(*[F.get(p, F.lit(k)) for k in at]))
    return F.when(F.col(form) == "psm", order(1, 3, 2)).when(F.col(form) == "spm", order(2, 3, 1)).otherwise(F.col(output))
