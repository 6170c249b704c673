"""Personal data and the terms that give it away, with DataFrame functions only.

Base spans come from patterns (e-mail, IPv4, card, phone). Each value found is a protected entity. The words of the
texts that mention it are judged by information theory, as in C-sanitisation: a term t discloses an entity c if
PMI(c; t) = log p(c, t) / (p(c) p(t)) reaches a share of the entity's own information IC(c) = -log p(c); at the full
share t alone determines c. All counts are over distinct texts, so copies of a text add nothing on either side. Terms
above the thresholds are generalised or removed wherever they occur, also in texts without the value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.sparkkit import cut, let, running, small

KINDS = ("email", "ip", "card", "phone")
#: Working columns beside those of the caller.
KEY, CLEAN = "__lumenspan_key", "__lumenspan_clean"
# Each pattern finds what its plain form in the comment finds, leftmost and without overlaps, in linear time.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WORDS_EACH_SIDE = 5
#: Noncharacters that stand for the spans of each kind while a text is worked on.
MARKS, FILLER = {"email": "\ufdd0", "ip": "\ufdd1", "card": "\ufdd2", "phone": "\ufdd3"}, "\ufdd4"
TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'-]+"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(number), "")
    doubled = F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def accepted(kind: str, match: Column) -> Column:
    if kind == "ip":
        plain = lambda part: F.regexp_replace(part, "^0+(?=.)", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(plain(p)) < 4) & (F.substring(plain(p), 1, 3).cast("int") < 256))
    if kind == "card":
        return F.length(digits(match)).between(14, 19) & luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def likely(text: Column, kind: str) -> Column:
    """A cheap test that spares most texts the pattern."""
    if kind in ("ip", "card"):
        return F.regexp_like(text, F.lit(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][ -]?[0-9]"))
    return F.contains(text, F.lit({"email": "@", "phone": "+"}[kind]))


def matches(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PATTERNS[kind]})"), F.lit(1))


def spans(text: Column, kind: str) -> Column:
    """Array of (start, rank, end, value) of a kind; positions are code points, rank is the kind's place. Work is linear
    in the text, however many matches it has."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, PATTERNS[kind], -1), F.length), F.lit(1), F.size(found))
        steps = F.zip_with(gaps, found, lambda g, v: g + F.length(v))
        rank = F.lit(KINDS.index(kind)).alias("rank")
        row = lambda v, end: F.struct((end - F.length(v)).alias("start"), rank, end.alias("end"), v.alias("value"))
        return F.filter(F.zip_with(found, running(steps), row), lambda s: accepted(kind, s["value"]))

    return F.when(likely(text, kind), let(matches(text, kind), placed)).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>"))


def with_spans(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, key (of the text), base (sorted spans), and the columns to keep."""
    text = F.coalesce("text", F.lit(""))
    base = F.array_sort(reduce(F.concat, [spans(F.col("body"), k) for k in KINDS]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body"), *keep).select(
        "doc_id", F.xxhash64("body").alias("key"), base.alias("base"), *keep, "body"
    )


def masked(text: Column) -> Column:
    """text with each base span replaced by its kind's mark and fillers, as long as before, so that no word of a span is
    taken for a term. A span that another one overlaps may lose only the rest of it: the longer kinds go first."""

    def blank(text: Column, kind: str) -> Column:
        mark = lambda v: F.when(accepted(kind, v), F.concat(F.lit(MARKS[kind]), F.repeat(F.lit(FILLER), F.length(v) - 1))).otherwise(v)
        pieces = lambda found: F.zip_with(F.split(text, PATTERNS[kind], -1), F.concat(F.transform(found, mark), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
        return F.when(likely(text, kind), let(matches(text, kind), lambda found: F.array_join(pieces(found), ""))).otherwise(text)

    of = lambda kind: lambda t: blank(t, kind)
    for kind in ("email", "phone", "card", "ip"):
        text = let(text, of(kind))
    return text


def shown(text: Column) -> Column:
    """A masked text with [EMAIL] and the like for the marks."""
    plain = lambda t: reduce(lambda a, k: F.regexp_replace(a, f"{MARKS[k]}{FILLER}*", f"[{k.upper()}]"), KINDS, t)
    return let(text, lambda t: F.when(F.regexp_like(t, F.lit(f"[{''.join(MARKS.values())}]")), plain(t)).otherwise(t))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1))


def candidates(words: Column) -> Column:
    """Words that may be terms, in lower case; two small letters alone are no name."""
    return F.transform(F.filter(words, lambda w: (F.length(w) > 2) | F.regexp_like(w, F.lit(r"[\p{Lu}\p{Lo}\p{N}]"))), F.lower)


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """A row (key, text) per distinct text, and their number. Only texts that occur more than once are shuffled; of the
    others no more than the hash is."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("rows")))
    again = small(cut(counts.where(F.col("rows") > 1).select("key")))
    copies = rows.join(again, "key", "left_semi").dropDuplicates(["key"])
    return rows.join(again, "key", "left_anti").unionByName(copies), counts.count()


def mentions(found: DataFrame) -> DataFrame:
    """key, entity, window, beside for every mention in the rows (key, body) of distinct texts: the words beside it, up to
    WORDS_EACH_SIDE whole words a side and no further than the neighbouring match of its kind, and their hash."""

    def of(kind: str) -> Column:
        def sides(found: Column) -> Column:
            pieces = F.split("body", PATTERNS[kind], -1)
            lefts = lambda p: F.zip_with(found, F.slice(p, F.lit(1), F.size(found)), lambda v, x: F.struct(v.alias("value"), x.alias("left")))
            both = lambda a, x: F.struct(F.lit(KINDS.index(kind)).alias("rank"), a["value"].alias("value"), a["left"].alias("left"), x.alias("right"))
            return let(pieces, lambda p: F.zip_with(lefts(p), F.slice(p, F.lit(2), F.size(found)), both))

        kept = F.filter(let(matches(F.col("body"), kind), sides), lambda m: accepted(kind, m["value"]))
        return F.when(likely(F.col("body"), kind), kept).otherwise(F.array().cast("array<struct<rank:int,value:string,left:string,right:string>>"))

    m = F.col("m")
    rows = found.select("key", F.explode(reduce(F.concat, map(of, KINDS))).alias("m"))
    last = let(words_of(m["left"]), lambda w: F.slice(w, F.greatest(F.size(w) - WORDS_EACH_SIDE, F.lit(0)) + 1, F.lit(WORDS_EACH_SIDE)))
    near = rows.select("key", F.xxhash64(m["rank"], F.lower(m["value"])).alias("entity"), F.concat(last, F.slice(words_of(m["right"]), 1, WORDS_EACH_SIDE)).alias("words"))
    return near.select("key", "entity", F.xxhash64(F.lower(F.array_join("words", " "))).alias("window"), F.array_distinct(candidates(F.col("words"))).alias("beside"))


def classes(rows: DataFrame, item: str, *kept: str) -> DataFrame:
    """rows (item, key, kept; every pair once): per item size, x and y, which are equal for items with equal sets of keys
    (but for chance, about 2^-128 a pair), and kept."""
    own = F.xxhash64("key"), F.xxhash64("key", F.lit(1))
    return rows.groupBy(item, *kept).agg(F.count("*").alias("size"), F.bit_xor(own[0]).alias("x"), F.bit_xor(own[1]).alias("y"))


def together(terms: DataFrame, owners: DataFrame, min_contexts: int, share: float) -> DataFrame:
    """(term, ratio) of terms that disclose an entity by the texts that have both.

    terms: key, term, df; owners: key, entity, mentions, n, most. Entities of the same texts have the same counts with any
    term, and so have terms of the same texts, so one of each class is counted: a text of ten thousand entities and as many
    terms that all stand in the same texts is one row."""
    wide = owners.where(F.col("mentions") >= min_contexts)
    alike = ["size", "x", "y", "mentions", "n", "most"]
    spoken = cut(classes(wide, "entity", *alike[3:]).groupBy(*alike).agg(F.min("entity").alias("entity")))
    wide = wide.join(small(spoken.select("entity")), "entity", "left_semi")
    same = ["size", "x", "y", "df"]
    known = cut(classes(terms.where(F.col("df") >= min_contexts), "term", "df").where(F.col("size") >= min_contexts))
    first = cut(known.groupBy(*same).agg(F.min("term").alias("term")))
    mine = terms.join(small(first.select("term")), "term", "left_semi")
    both = mine.join(wide, "key").where("df <= most").groupBy("entity", "term", "df", "mentions", "n").agg(F.count("*").alias("both"))
    found = both.where(F.col("both") >= min_contexts).select("term", ratio_of().alias("ratio")).where(F.col("ratio") >= share)
    best = cut(found.groupBy("term").agg(F.max("ratio").alias("ratio")))
    hit = cut(first.join(small(best), "term").drop("term"))
    return known.join(small(hit), same).select("term", "ratio")


def ratio_of() -> Column:
    """PMI over the entity's information, from both, df, mentions and n."""
    n, m = F.col("n"), F.col("mentions")
    return F.log2(F.col("both") / F.greatest("df", "both") * n / m) / F.log2(n / m)


def disclosing(found: DataFrame, texts: DataFrame, n_texts: int, min_contexts: int, share: float) -> DataFrame:
    """(term, ratio) of terms whose PMI with an entity is at least `share` of its information, a row or two a term.

    found: key, body of the distinct texts that mention an entity; texts: key, text of all distinct texts, n_texts in
    number. A pair needs min_contexts distinct texts with both, or as many distinct contexts with the term beside a mention.
    A ratio of share needs df <= mentions * (n / mentions) ** (1 - share) = most, so only such words meet an entity."""
    near = cut(mentions(found))
    entities = near.groupBy("entity").agg(F.count_distinct("key").alias("mentions"), F.count_distinct("window").alias("windows"))
    n = F.greatest(F.lit(float(n_texts)), F.col("mentions") + 1.0)
    often = cut(entities.where(F.greatest("mentions", "windows") >= min_contexts).withColumn("n", n).withColumn("most", F.col("mentions") * F.pow(F.col("n") / F.col("mentions"), F.lit(1 - share)) * (1 + 1e-9)).drop("windows"))
    owners = cut(near.select("key", "entity").distinct().join(small(often), "entity"))
    holders = small(cut(owners.select("key").distinct()))
    every = F.array_distinct(F.transform(words_of(masked(F.col("text"))), lambda w: F.xxhash64(F.lower(w))))
    # An outer explode: the plain one would work out the words once more, to see whether there are any.
    frequency = texts.select(F.explode_outer(every).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    mine = found.join(holders, "key", "left_semi").select("key", F.explode(F.array_distinct(candidates(words_of(masked(F.col("body")))))).alias("term"))
    mine = cut(mine.withColumn("word", F.xxhash64("term")))
    known = cut(frequency.join(mine.select("word").distinct(), "word"))
    held = cut(mine.join(small(known), "word").drop("word"))
    joint = together(held, owners, min_contexts, share)
    beside = near.select("entity", "window", F.explode("beside").alias("term")).groupBy("entity", "term").agg(F.count_distinct("window").alias("windows"))
    close = beside.where(F.col("windows") >= min_contexts).select("entity", "term", F.xxhash64("term").alias("word"))
    close = cut(close.join(small(known), "word").join(small(often), "entity").where("df <= most").select("entity", "term", "df", "mentions", "n"))
    met = held.select("key", "term").join(small(close), "term").join(owners.select("key", "entity"), ["key", "entity"])
    counted = met.groupBy("entity", "term", "df", "mentions", "n").agg(F.count("*").alias("both"))
    shared = counted.select("term", ratio_of().alias("ratio")).where(F.col("ratio") >= share)
    return joint.unionByName(shared)


def guilty_terms(docs: DataFrame, min_contexts: int, share: float) -> DataFrame:
    """(term, ratio): all disclosing terms with their highest ratio."""
    found = with_spans(docs).where(F.size("base") > 0).select("key", "body").dropDuplicates(["key"])
    pairs = disclosing(cut(found), *distinct_texts(docs), min_contexts, share)
    return cut(pairs.groupBy("term").agg(F.max("ratio").alias("ratio")))


#: Words of a text that are looked up at once.
LOOKUP = 256


def pieces_of(body: Column, full: Column, part: Column) -> Column:
    """A masked text in pieces: gap (what stands before the word), word (null at the end), end (its place), level (2 for a
    word in full, 1 for one in part, else 0). Words are looked up some at a time, by intersections, so that work is far
    from the product of the words and the terms."""
    gaps, words = F.split(body, TERM, -1), words_of(body)
    steps = let(F.transform(gaps, F.length), lambda g: let(F.transform(words, F.length), lambda w: running(F.zip_with(g, w, lambda a, b: a + F.coalesce(b, F.lit(0))))))
    name = lambda x: F.lower(x["word"])

    def marked(some: Column) -> Column:
        level = lambda x, f, p: F.when(F.array_contains(f, name(x)), 2).when(F.array_contains(p, name(x)), 1).otherwise(0)
        row = lambda x, f, p: F.struct(x["gap"].alias("gap"), x["word"].alias("word"), x["end"].alias("end"), level(x, f, p).alias("level"))
        met = lambda terms: let(F.transform(some, name), lambda w: F.array_intersect(w, terms))
        return let(met(full), lambda f: let(met(part), lambda p: F.transform(some, lambda x: row(x, f, p))))

    def every(z: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / LOOKUP).cast("int"))
        return F.flatten(F.transform(blocks, lambda b: let(F.slice(z, b * LOOKUP + 1, F.lit(LOOKUP)), marked)))

    return let(F.arrays_zip(gaps.alias("gap"), words.alias("word"), steps.alias("end")), every)


def placed_terms(docs: DataFrame, guilty: DataFrame) -> DataFrame:
    """key and pieces (pieces_of) of each distinct text with a guilty term; those of ratio 1 are full."""
    known = small(guilty)
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), masked(F.translate(F.coalesce("text", F.lit("")), "".join([*MARKS.values(), FILLER]), "�" * 5)).alias("body"))
    met = keyed.select("key", F.explode_outer(F.array_distinct(F.transform(words_of(F.col("body")), F.lower))).alias("term")).join(known, "term")
    whole = F.col("ratio") >= 1.0 - 1e-12
    hit = met.groupBy("key").agg(F.collect_set(F.when(whole, F.col("term"))).alias("full"), F.collect_set(F.when(~whole, F.col("term"))).alias("part"))
    texts = keyed.join(small(cut(hit)), "key").dropDuplicates(["key"])
    return cut(texts.select("key", pieces_of(F.col("body"), F.col("full"), F.col("part")).alias("pieces")))


def find(docs: DataFrame, min_contexts: int = 3, share: float = 0.9) -> DataFrame:
    """doc_id, base (spans) and extra (spans of disclosing terms) for every row of docs (doc_id, text).

    A null text is empty: no spans. Equal rows have equal spans; a null doc_id stays null. Extra columns are ignored; an
    empty table gives no rows."""
    parts = placed_terms(docs, guilty_terms(docs, min_contexts, share))
    span = lambda p: F.struct((p["end"] - F.length(p["word"])).alias("start"), F.lit(len(KINDS)).alias("rank"), p["end"].alias("end"), p["level"].alias("level"))
    extra = small(cut(parts.select("key", F.transform(F.filter("pieces", lambda p: p["level"] > 0), span).alias("extra"))))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,level:int>>")
    return with_spans(docs).drop("body").join(extra, "key", "left").select("doc_id", "base", F.coalesce("extra", none).alias("extra"))


def sanitise(docs: DataFrame, min_contexts: int = 3, share: float = 0.9) -> DataFrame:
    """docs, all columns, with text sanitised: base spans become [EMAIL], [IP], [CARD] or [PHONE]; terms that fully
    determine an entity (ratio 1) are removed, other disclosing terms become [TERM]. Texts without either, null ones
    included, stay as they are; n_chars, where it exists, follows the text. Repeated rows are treated alike; an empty
    table stays empty. The noncharacters U+FDD0 to U+FDD4, which mark spans meanwhile, become U+FFFD."""
    parts = placed_terms(docs, guilty_terms(docs, min_contexts, share))
    out = lambda p: F.concat(p["gap"], F.when(p["level"] == 0, F.coalesce(p["word"], F.lit(""))).when(p["level"] == 2, "").otherwise("[TERM]"))
    terms = cut(parts.select(F.col("key").alias(KEY), shown(F.array_join(F.transform("pieces", out), "")).alias(CLEAN)))
    plain = shown(masked(F.translate("text", "".join([*MARKS.values(), FILLER]), "�" * 5)))
    rows = docs.withColumn(KEY, F.xxhash64(F.coalesce("text", F.lit("")))).join(small(terms), KEY, "left").withColumn(CLEAN, F.coalesce(CLEAN, plain))
    changed = {"text": F.col(CLEAN)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(CLEAN) != F.col("text"), F.length(CLEAN).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
