"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import bytebpe, chat, dartminhash, exactdedup, fim, fingerprints, langid, linededup, merkle, packing, quality, sanitise, urlrules
from lumenspan.llm.sparkkit import light_batches

#: (host, path, action)
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    light_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(spark, table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    back = chat.read_back(chat.format_conversations(rows.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.under_mask()
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block")
    labelled = pages.join(labels.withColumnRenamed("doc_id", "page_id"), "page_id").select("url", bad)
    judged = urlrules.judge_pages(spark, pages, rules, labelled)
    return judged.select("page_id", "host", "path", "rule", "verdict", "confidence")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), path)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.find(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, (*sanitise.KINDS, "term")))
    shown = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    plain = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == sanitise.KINDS.index(k))).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.concat(F.transform("base", plain), F.transform("extra", plain)))
    return found.select(
        "doc_id",
        *map(count, sanitise.KINDS),
        F.sha2(F.array_join(F.transform("base", shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(every, shown), ",").alias("spans"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.check_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.sha2("proof", 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.duplicates(table(spark, sf_dir, "documents"))


# What SQL can state of the operators whose whole results it cannot.
def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that op5_language did not learn from."""
    return op5_language(spark, sf_dir).select("doc_id", "held_out")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules of op7_quality."""
    return op7_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_byte_bpe decodes."""
    return op8_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op10_sanitise."""
    return op10_sanitise(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_chat": op2_chat,
    "op3_url_rules": op3_url_rules,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language": op5_language,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_sanitise": op10_sanitise,
    "op11_merkle": op11_merkle,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_dedup": op13_exact_dedup,
    "language_folds": language_folds,
    "quality_base": quality_base,
    "byte_bpe_round_trip": byte_bpe_round_trip,
    "personal_data_base": personal_data_base,
}
_ESCAPED = "len({0}) + len({0}) * 3 - len(replace({0}, '\\', '')) - len(replace({0}, '<', '')) - len(replace({0}, '[', ''))"

CHAT_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(24 + {_ESCAPED.format('role')} + len(role) - len(replace(role, chr(10), '')) + {_ESCAPED.format('text')}) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars FROM g"""

_URL_TOKENS = """list_distinct(list_concat(
    list_transform(list_filter(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g'))))"""

#: Mines by counting every subset of every url's tokens.
URL_SQL = f"""
WITH r(host, path, action) AS (VALUES {', '.join(map(str, URL_RULES))}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT *, {_URL_TOKENS} AS tokens FROM h),
listed AS (SELECT page_id, arg_max(r.host || r.path, len(r.host || r.path)) AS rule, arg_max(action, len(r.host || r.path)) AS action
    FROM t JOIN r ON (t.host = r.host OR ends_with(t.host, '.' || r.host)) AND starts_with(t.path, r.path) GROUP BY page_id),
labelled AS (SELECT page_id, tokens, (quality = 0 OR toxic = 1) AS block FROM t JOIN labels ON doc_id = page_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL),
k AS (SELECT count(*) AS n, ceil(least(1.0, greatest(0.002, 20.0 / greatest(count(*), 1))) * count(*)) AS least_count FROM labelled),
subsets AS (SELECT block, list_sort(list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS part FROM (SELECT *, unnest(range(1, 1 << len(tokens)::INT)) AS mask FROM labelled)),
strong AS (SELECT part, count(*) FILTER (block) / count(*) AS confidence FROM subsets, k GROUP BY part, least_count HAVING count(*) FILTER (block) >= least_count AND count(*) FILTER (block) / count(*) >= 0.8),
fired AS (SELECT page_id, max(confidence) AS confidence FROM t JOIN strong s ON list_has_all(t.tokens, s.part)
    WHERE NOT EXISTS (SELECT 1 FROM strong o WHERE o.part <> s.part AND list_has_all(s.part, o.part)) GROUP BY page_id)
SELECT t.page_id::BIGINT AS page_id, host, path, rule, coalesce(action, CASE WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN rule IS NULL THEN confidence END::DOUBLE AS confidence FROM t LEFT JOIN listed USING (page_id) LEFT JOIN fired USING (page_id)"""

#: All links by an exact join on shingles, components by reachability.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [''] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.d),
m AS (SELECT d, min(root) AS class_id FROM r GROUP BY d)
SELECT d::BIGINT AS doc_id, class_id::BIGINT AS class_id, count(*) OVER (PARTITION BY class_id)::BIGINT AS class_size, d = class_id AS kept FROM m"""



def _powers_sql(name: str, step: int) -> str:
    """Relation (i, v): powers of `step` modulo the prime, from tables of 512 small and 4096 large steps."""
    p = int(fingerprints.PRIME)
    big = pow(step, 512, p)
    return f"""{name}l AS (SELECT 0::BIGINT AS i, 1::BIGINT AS v UNION ALL SELECT i + 1, v * {step % p} % {p} FROM {name}l WHERE i < 511),
{name}h AS (SELECT 0::BIGINT AS i, 1::BIGINT AS v UNION ALL SELECT i + 1, v * {big} % {p} FROM {name}h WHERE i < 4095),
{name} AS MATERIALIZED (SELECT h.i * 512 + l.i AS i, h.v * l.v % {p} AS v FROM {name}h h, {name}l l WHERE h.i * 512 + l.i <= (SELECT max(len(t)) FROM v))"""


def _fingerprint_sql() -> str:
    """Hashes character by character; likeness from the characters themselves, cell by cell."""
    p, (b, c) = int(fingerprints.PRIME), fingerprints.BASES
    packed = lambda a, b: f"format('{{:016x}}', (({a}) << 31) | ({b}))"
    suffix = packed(f"(e.a - h.a + {p}) % {p} * qa.v % {p}", f"(e.b - h.b + {p}) % {p} * qb.v % {p}")
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '') DESC) AS r, count(*) OVER () AS n FROM documents),
x AS MATERIALIZED (SELECT a.doc_id, a.r, a.t, b.t AS after, left(a.t, len(a.t) - len(a.t) // 3) || left(b.t, len(a.t) // 3) AS e, b.r AS br FROM d a JOIN d b ON b.r = a.r % a.n + 1),
v AS MATERIALIZED (SELECT r, 0 AS kind, t, len(t)::BIGINT AS n FROM x UNION ALL SELECT r, 1, e, len(e) FROM x),
g AS MATERIALIZED (SELECT v.*, (SELECT min(1::BIGINT << m) FROM range(40) s(m) WHERE v.n <= {fingerprints.GRID} * (1::BIGINT << m)) AS step FROM v),
{_powers_sql('pa', b)}, {_powers_sql('pb', c)}, {_powers_sql('qa', pow(b, -1, p))}, {_powers_sql('qb', pow(c, -1, p))},
u AS (SELECT r, kind, unnest(string_split(t, '')) AS ch, unnest(range(len(t)))::BIGINT AS i FROM v WHERE n > 0),
h AS MATERIALIZED (SELECT r, kind, 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b FROM v UNION ALL
  SELECT r, kind, u.i + 1, (sum((unicode(ch) + 1) * pa.v % {p}) OVER w % {p})::BIGINT, (sum((unicode(ch) + 1) * pb.v % {p}) OVER w % {p})::BIGINT
  FROM u JOIN pa ON pa.i = u.i JOIN pb ON pb.i = u.i WINDOW w AS (PARTITION BY r, kind ORDER BY u.i)),
e AS MATERIALIZED (SELECT r, kind, arg_max(a, i) AS a, arg_max(b, i) AS b FROM h GROUP BY r, kind),
m AS (SELECT r, kind, coalesce(string_agg(prefix, '' ORDER BY i) FILTER (i > 0 AND i % step = 0), '') AS prefixes, coalesce(string_agg(suffix, '' ORDER BY i DESC) FILTER (i < n AND (n - i) % step = 0), '') AS suffixes
  FROM (SELECT h.r, h.kind, h.i, g.n, g.step, {packed('h.a', 'h.b')} AS prefix, {suffix} AS suffix FROM h JOIN g ON g.r = h.r AND g.kind = h.kind JOIN e ON e.r = h.r AND e.kind = h.kind
    JOIN qa ON qa.i = h.i JOIN qb ON qb.i = h.i WHERE h.i % g.step = 0 OR (g.n - h.i) % g.step = 0) GROUP BY r, kind),
f AS MATERIALIZED (SELECT g.r, g.kind, g.t, g.n, g.step, format('{{:x}}', g.n) || '.' || {packed('e.a', 'e.b')} || '.' || prefixes || '.' || suffixes AS mark
  FROM g JOIN e ON e.r = g.r AND e.kind = g.kind JOIN m ON m.r = g.r AND m.kind = g.kind),
pair AS (SELECT x.r, 'e' AS what, a.t AS a, b.t AS b, a.n AS na, b.n AS nb, greatest(a.step, b.step) AS step FROM x JOIN f a ON a.r = x.r AND a.kind = 0 JOIN f b ON b.r = x.r AND b.kind = 1
  UNION ALL SELECT x.r, 'n', a.t, b.t, a.n, b.n, greatest(a.step, b.step) FROM x JOIN f a ON a.r = x.r AND a.kind = 0 JOIN f b ON b.r = x.br AND b.kind = 0),
cell AS (SELECT r, what, na, nb, step, k, substr(a, (k * step + 1)::BIGINT, step) = substr(b, (k * step + 1)::BIGINT, step) AS l,
    substr(a, (na - (k + 1) * step + 1)::BIGINT, step) = substr(b, (nb - (k + 1) * step + 1)::BIGINT, step) AS e
  FROM (SELECT *, unnest(range(least(na, nb) // step))::BIGINT AS k FROM pair WHERE least(na, nb) > 0)),
side AS (SELECT r, what, list(l::INT ORDER BY k) AS l, list(e::INT ORDER BY k) AS e FROM cell GROUP BY r, what),
cover AS (SELECT r, what, list_max(list_transform(range(len(l) + 1), lambda t: coalesce(list_sum(l[1 : t]), 0) + coalesce(list_sum(e[1 : len(e) - t]), 0))) AS cells FROM side),
like_ AS (SELECT pair.r, pair.what, CASE WHEN a = b THEN 1.0 WHEN least(na, nb) = 0 THEN 0.0 ELSE least(coalesce(cells, 0) * step, na, nb, greatest(na, nb) - 1)::DOUBLE / greatest(na, nb) END AS near FROM pair LEFT JOIN cover ON cover.r = pair.r AND cover.what = pair.what)
SELECT x.doc_id::BIGINT AS doc_id, len(x.t)::BIGINT AS n_chars, sha256(x.e) AS edited_sha256, a.mark AS fingerprint, b.mark AS edited_fingerprint, p.near::DOUBLE AS near_edited, q.near::DOUBLE AS near_next
FROM x JOIN f a ON a.r = x.r AND a.kind = 0 JOIN f b ON b.r = x.r AND b.kind = 1 JOIN like_ p ON p.r = x.r AND p.what = 'e' JOIN like_ q ON q.r = x.r AND q.what = 'n'"""


def _digest_sql(*columns: str) -> str:
    shown = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in columns]
    return f"sha256({' || '.join(shown)})"


#: Trees level by level; of every leaf all siblings, then its fold.
MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS id, coalesce('=' || lang, '') AS scope, {_digest_sql('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
    {_digest_sql('doc_id', 'source', 'lang', '(n_chars + 1)', 'text')} AS changed FROM documents),
crc AS (SELECT i::BIGINT AS i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) t(i)),
c AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 0::BIGINT AS k, 4294967295::BIGINT AS r FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, k + 1, xor(r >> 8, v) FROM c JOIN crc ON i = xor(r, ascii(substr(s, (k + 1)::BIGINT, 1))) & 255 WHERE k < len(s)),
seven AS (SELECT doc_id FROM c WHERE k = len(s) AND xor(r, 4294967295) % 7 = 0),
leaves AS MATERIALIZED (SELECT id, d.doc_id, scope, leaf, CASE WHEN seven.doc_id IS NULL THEN leaf ELSE changed END AS claim,
    row_number() OVER (PARTITION BY scope ORDER BY d.doc_id NULLS FIRST, leaf) - 1 AS pos FROM d LEFT JOIN seven ON seven.doc_id = d.doc_id),
t AS (SELECT 0 AS level, scope, pos, leaf AS h, count(*) OVER (PARTITION BY scope) AS n FROM leaves
  UNION ALL SELECT level + 1, scope, pos // 2, sha256(h || coalesce(after, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY scope ORDER BY pos) AS after FROM t WHERE n > 1) WHERE pos % 2 = 0),
tree AS MATERIALIZED (SELECT * FROM t),
subroots AS MATERIALIZED (SELECT scope, h AS subroot, row_number() OVER (ORDER BY scope) - 1 AS pos, level AS height FROM tree WHERE n = 1),
u AS (SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(h || coalesce(after, '')), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (ORDER BY pos) AS after FROM u WHERE n > 1) WHERE pos % 2 = 0),
upper AS MATERIALIZED (SELECT * FROM u),
place AS (SELECT id, l.scope, tree.level AS level, l.pos >> tree.level::BIGINT AS p, tree.h AS h FROM leaves l JOIN tree ON tree.scope = l.scope AND tree.n > 1 AND tree.pos = xor(l.pos >> tree.level::BIGINT, 1)),
above AS (SELECT id, s.height + u.level AS level, s.pos >> u.level::BIGINT AS p, u.h AS h FROM leaves l JOIN subroots s ON s.scope = l.scope JOIN upper u ON u.n > 1 AND u.pos = xor(s.pos >> u.level::BIGINT, 1)),
sibling AS MATERIALIZED (SELECT id, level, p, h FROM place UNION ALL SELECT id, level, p, h FROM above),
proofs AS (SELECT id, sha256(string_agg(h, '' ORDER BY level)) AS proof FROM sibling GROUP BY id),
heights AS (SELECT l.id, l.claim, s.height + (SELECT max(level) FROM upper) AS top FROM leaves l JOIN subroots s ON s.scope = l.scope),
f AS (SELECT id, 0 AS level, claim AS h, top FROM heights
  UNION ALL SELECT f.id, f.level + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.p % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END), top
  FROM f LEFT JOIN sibling s ON s.id = f.id AND s.level = f.level WHERE f.level < top)
SELECT l.doc_id::BIGINT AS doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root,
  f.h = (SELECT h FROM upper WHERE n = 1) AS verified
FROM leaves l JOIN subroots s ON s.scope = l.scope JOIN f ON f.id = l.id AND f.level = f.top LEFT JOIN proofs ON proofs.id = l.id"""

FIM_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
r AS (SELECT doc_id, t, len(t)::BIGINT AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM h),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q FROM r),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || left(t, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p)
    ELSE '<S>' || substr(t, q + 1) || '<P>' || left(t, p) || '<M>' || substr(t, p + 1, q - p) END AS output FROM f)
SELECT doc_id::BIGINT AS doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""

EXACT_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, len(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
w AS (SELECT *, row_number() OVER g AS place, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM d WINDOW g AS (PARTITION BY bare ORDER BY chars DESC, doc_id NULLS FIRST, id))
SELECT doc_id::BIGINT AS doc_id, keep_id::BIGINT AS keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, sha256(bare) AS text_sha256 FROM w"""

#: crc32 of the ids as text, digit by digit.
FOLDS_SQL = """
WITH RECURSIVE step AS (SELECT i::BIGINT AS i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) t(i)),
c AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 0::BIGINT AS k, 4294967295::BIGINT AS r FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, k + 1, xor(r >> 8, v) FROM c JOIN step ON i = xor(r, ascii(substr(s, (k + 1)::BIGINT, 1))) & 255 WHERE k < len(s)),
out AS (SELECT doc_id FROM c WHERE k = len(s) AND xor(r, 4294967295) % 5 = 0)
SELECT d.doc_id::BIGINT AS doc_id, out.doc_id IS NOT NULL AS held_out FROM documents d LEFT JOIN out ON out.doc_id = d.doc_id"""

#: Words and lines as rows, windows of five words as strings.
QUALITY_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d)),
five AS (SELECT id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS win FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
often AS (SELECT id, i, win IS NOT NULL AND count(*) OVER (PARTITION BY id, win) > 1 AS again FROM five),
inside AS (SELECT id, bool_or(again) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS again FROM often),
words AS (SELECT id, count(*) AS n_words, count(*) FILTER (again) AS n_repeat_words FROM inside GROUP BY id),
lines AS (SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
n AS (SELECT doc_id, t, coalesce(n_words, 0) AS n_words, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN words USING (id) LEFT JOIN lines USING (id))
SELECT doc_id::BIGINT AS doc_id, n_words::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM n"""

ROUND_TRIP_SQL = "SELECT doc_id::BIGINT AS doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"

#: The contract's patterns as they are written there.
PLAIN_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _personal_sql() -> str:
    """Matches and the gaps between them give the places; then each kind's test."""
    one = "SELECT id, {1} AS rank, '{0}' AS kind, regexp_extract_all(t, '{2}') AS found, string_split_regex(t, '{2}') AS gaps FROM d"
    every = " UNION ALL ".join(one.format(k, i, p) for i, (k, p) in enumerate(PLAIN_PATTERNS.items()))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in PLAIN_PATTERNS)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({every}),
m AS (SELECT id, rank, kind, unnest(found) AS v, unnest(gaps[1 : len(found)]) AS gap, generate_subscripts(found, 1) AS i FROM f WHERE len(found) > 0),
p AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits, sum(len(gap) + len(v)) OVER (PARTITION BY id, rank ORDER BY i) AS stop FROM m),
a AS (SELECT *, stop - len(v) AS start FROM p WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN len(digits) BETWEEN 10 AND 15
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(x AS HUGEINT) <= 255, false)))
  ELSE len(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT ELSE x::INT * 2 % 10 + x::INT * 2 // 10 END)) % 10 = 0 END),
g AS (SELECT id, {counts}, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans FROM a GROUP BY id)
SELECT doc_id::BIGINT AS doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in PLAIN_PATTERNS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (id)"""


ORACLES: dict[str, str] = {"op1_fingerprints": _fingerprint_sql(), "op2_chat": CHAT_SQL, "op3_url_rules": URL_SQL, "op4_near_duplicates": NEAR_SQL, "op11_merkle": MERKLE_SQL, "op12_fill_in_middle": FIM_SQL, "op13_exact_dedup": EXACT_SQL}
ORACLES |= {"language_folds": FOLDS_SQL, "quality_base": QUALITY_SQL, "byte_bpe_round_trip": ROUND_TRIP_SQL, "personal_data_base": _personal_sql()}
