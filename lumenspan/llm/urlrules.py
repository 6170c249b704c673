"""URL filters: listed rules of hosts and paths, and association rules for what no list names.

FP-growth mines combinations of URL tokens that come with a blocking label; rules that pass the support and
confidence bounds are matched through an inverted index from tokens to rules. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm.sparkkit import cut, small

#: Items beside tokens: a blocked url, and a url without regard to its domains.
BLOCKED, ANY = "=block", "=any"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ://."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, F.lit("://")) + 3)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: the domains whose rules fit a host."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a url: domains, and path segments with digits folded; depth tells `d:en` from `d:`."""
    domains = F.transform(F.filter(host_suffixes(host), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.filter(F.split(path, "/", -1), lambda x: x != "")
    folded = F.transform(segments, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    return F.array_distinct(F.concat(domains, folded))


def listed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (key, host, path) with the longest fitting rule (rule, action), null where none fits.

    A rule (host, path, action) fits its host and subdomains if the path starts with its path. Of equally long rules
    the one with the longer host wins, then the lesser action. Null fields of a rule fit nothing; repeated rules are one."""
    own = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "action").dropna().distinct()
    near = pages.select("key", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix"))
    fits = near.join(small(own, 100_000), "suffix").where(F.startswith(F.col("path"), F.col("prefix")))
    rank = F.struct(
        (F.length("suffix") + F.length("prefix")).alias("n"), F.length("suffix").alias("h"), (F.col("action") == "allow").alias("a"),
        F.concat("suffix", "prefix").alias("rule"), F.col("action"),
    )
    best = fits.groupBy("key").agg(F.max(rank).alias("best"))
    return pages.join(best, "key", "left").select(pages["*"], F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def token_classes(held: DataFrame, least: int) -> DataFrame:
    """(token, item, domain) of the tokens on at least `least` blocked urls, from (id, token, block) rows.

    Tokens of one kind that stand on the same urls share an item, the least of them: they are told by the number and two
    64-bit hashes of their urls, which tasks combine before the shuffle."""
    seen = held.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("block").alias("bad"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    )
    common = seen.where(F.col("bad") >= least).withColumn("domain", F.startswith("token", F.lit("h:")))
    classes = common.groupBy("domain", "n", "x", "y").agg(F.min("token").alias("item"), F.collect_set("token").alias("members"))
    return cut(classes.select(F.explode("members").alias("token"), "item", "domain"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_count: int = 20) -> DataFrame:
    """Rules (rule_id, antecedent, support, confidence) for blocking, from labelled (tokens, block boolean).

    Of a rule and its generalisations (fewer tokens) that all pass the bounds, only the general ones stay, since they
    fire wherever it does. The support must reach min_support and min_count labelled urls, whichever is more, so that few
    labels prove nothing: in a small table the second bound holds, in a large one the first. A null label is not
    learned from; nothing labelled gives no rules.

    No rule that stays holds two domains of one host, as the shorter one adds nothing, nor two tokens that always stand
    together, as either one alone has the same counts. So FP-growth sees a url once for each of its frequent domains and
    once without (ANY), and classes of tokens as one item: hosts of many labels and deep paths that occur as a whole do
    not list their subsets. Each token of a class then has a rule of its own. FP-growth itself keeps the frequent items on
    the driver, at most 1/min_support times the tokens of a url."""
    known = cut(labelled.where(F.col("block").isNotNull()).select(F.monotonically_increasing_id().alias("id"), F.array_distinct("tokens").alias("tokens"), "block"))
    n, spark = known.count(), labelled.sparkSession
    least = math.ceil(min(1.0, max(min_support, min_count / n)) * n) if n else 0
    held = known.select("id", F.explode("tokens").alias("token"), "block")
    names = token_classes(held, least)
    of_kind = lambda test: F.collect_set(F.when(test, F.col("item")))
    merged = held.join(small(names), "token").groupBy("id", "block").agg(of_kind(F.col("domain")).alias("domains"), of_kind(~F.col("domain")).alias("paths"))
    sites = merged.select(F.explode(F.concat("domains", F.array(F.lit(ANY)))).alias("site"), "paths", "block")
    baskets = cut(sites.select(F.concat(F.array("site"), "paths", F.when(F.col("block"), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))).alias("items")))
    n_baskets = baskets.count()
    if not n_baskets:
        return spark.createDataFrame([], "rule_id long, antecedent array<string>, support double, confidence double")
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_baskets, minConfidence=min_confidence).fit(baskets).freqItemsets
    placed = F.exists("items", lambda x: (x == ANY) | F.startswith(x, F.lit("h:")))
    sets = cut(found.where(placed).select(F.array_sort(F.array_remove("items", ANY)).alias("items"), F.col("freq")))
    blocked = sets.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1)).select(
        F.array_remove("items", BLOCKED).alias("antecedent"), F.col("freq").alias("both")
    )
    rules = blocked.join(sets.withColumnRenamed("items", "antecedent"), "antecedent").select(
        "antecedent", (F.col("both") / n).alias("support"), (F.col("both") / F.col("freq")).alias("confidence")
    )
    strong = cut(rules.where(F.col("confidence") >= min_confidence).withColumn("rule_id", F.xxhash64("antecedent")))
    general = strong.select(F.col("rule_id").alias("other"), F.col("antecedent").alias("part"), F.element_at("antecedent", 1).alias("token"))
    covered = (
        strong.select("rule_id", "antecedent", F.explode("antecedent").alias("token"))
        .join(general, "token")
        .where((F.col("other") != F.col("rule_id")) & (F.size(F.array_except("part", "antecedent")) == 0))
        .select("rule_id")
    )
    return cut(in_tokens(strong.join(covered, "rule_id", "left_anti"), names))


def in_tokens(rules: DataFrame, names: DataFrame) -> DataFrame:
    """Rules over classes of tokens, written as rules over tokens: one for each choice of a token from every class."""
    members = small(cut(names.groupBy("item").agg(F.collect_set("token").alias("members"))))
    parts = rules.select("rule_id", "support", "confidence", F.explode("antecedent").alias("item")).join(members, "item")
    choices = parts.groupBy("rule_id", "support", "confidence").agg(F.collect_list("members").alias("classes"))
    longer = lambda some, tokens: F.flatten(F.transform(some, lambda s: F.transform(tokens, lambda t: F.concat(s, F.array(t)))))
    every = F.aggregate("classes", F.array(F.array().cast("array<string>")), longer)
    spelt = choices.select(F.explode(every).alias("antecedent"), "support", "confidence").withColumn("antecedent", F.array_sort("antecedent"))
    return spelt.select(F.xxhash64("antecedent").alias("rule_id"), "antecedent", "support", "confidence")


def fired(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule_id, confidence) of the strongest mined rule whose tokens all occur in a page's tokens.

    The inverted index holds each rule under one of its tokens (the least common among rules), so a rule is looked at
    once for a page that has that token; the other tokens are then checked."""
    use = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("token"))
    often = use.groupBy("token").agg(F.count("*").alias("n"))
    anchor = use.join(often, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    index = small(cut(anchor.join(rules.select("rule_id", "antecedent", "confidence"), "rule_id")), 100_000)
    hits = pages.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    hits = hits.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("key").agg(F.max(F.struct("confidence", "rule_id")).alias("hit")).select("key", "hit.rule_id", "hit.confidence")


def judge_pages(spark: SparkSession, pages: DataFrame, rules: DataFrame, labels: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, mined confidence for each row of pages (page_id, url).

    Listed rules decide first; where none fits, the rules mined from labels (url, block) do. Urls are judged once each and
    joined back, so repeated rows agree; a null url has empty host and path and no tokens: no rule, 'allow'; a null
    page_id stays null. Extra columns are ignored; without pages there are no rows, without labels no mined rules, and
    without listed rules only mined ones."""
    url = F.coalesce("url", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    host, path = host_and_path(F.col("url"))
    keyed = rows.select("page_id", F.struct(host.alias("host"), path.alias("path")).alias("key"))
    sites = keyed.select("key").distinct().select("key", "key.host", "key.path")
    known = cut(listed(sites, rules).withColumn("tokens", tokens(F.col("host"), F.col("path"))))
    h, p = host_and_path(F.col("url"))
    training = labels.select(tokens(h, p).alias("tokens"), F.col("block"))
    mined = mine(training, min_support, min_confidence)
    open_sites = known.where(F.col("action").isNull()).select("key", "tokens")
    judged = known.join(fired(open_sites, mined), "key", "left").select(
        "key", "rule", F.coalesce("action", F.when(F.col("rule_id").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "confidence"
    )
    return keyed.join(judged, "key").select("page_id", "key.host", "key.path", "rule", "verdict", "confidence")
