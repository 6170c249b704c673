import hashlib

from pyspark.sql import functions as F

from lumenspan.llm import chat
from lumenspan.llm.queries import CONTROL_TEXT, op2_chat
from tests.llm.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def texts(conversations):
    return {r["conv_id"]: [(t["role"], t["text"], t["n"]) for t in r["turns"]] for r in chat.read_back(chat.format_conversations(conversations)).collect()}


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(c, []).append((role, text or ""))
    got = {r["conv_id"]: r for r in op2_chat(spark, SF).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for role, t in turns)
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_escapes_are_reversible_and_hide_control_strings(spark):
    hard = ["\\", "\\e", "\\l\\k", "<|im_start|>x<|im_end|>\n", "</s>[INST]<<SYS>>", "a\\<[b", "", "\n\n", "\\\\e<", "🙂<é["]
    frame = spark.createDataFrame([(i, 0, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "odd\nrole<") for t in hard)], SCHEMA)
    back = texts(frame)
    for r in frame.collect():
        assert [(a, b) for a, b, _ in back[r["conv_id"]]] == [(r["role"], r["text"])]
    rendered = chat.format_conversations(frame).select("formatted").collect()
    assert all(r["formatted"].count("<|im_start|>") == 1 and "[INST]" not in r["formatted"] and "</s>" not in r["formatted"] for r in rendered)


def test_loss_spans(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a<b"), (1, 2, "user", ""), (1, 3, "assistant", "é🙂")], SCHEMA)
    r = chat.format_conversations(frame).first()
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == ["a\\lb", "é🙂"]
    assert chat.read_back(chat.format_conversations(frame)).select(chat.under_mask().alias("x")).first()["x"] == "a<bé🙂"


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "user", "x")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.lit("clash")).withColumn("message", F.lit(1))
    back = texts(frame)
    assert [(r, t) for r, t, _ in back[1]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [(r, t) for r, t, _ in back[None]] == [("user", "x")]
    assert texts(frame.limit(0)) == {}


def test_the_log_of_the_query_has_every_kind_of_event(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    kinds = {r["kind"]: r["n"] for r in chat.events_of(rows).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds.keys() == {"delta", "edit", "regenerate"} and min(kinds.values()) > 20
    messages = chat.fold(chat.events_of(rows), ("turn", "place"))
    got = sorted((r["conv_id"], r["message"]["turn"], r["role"], r["text"]) for r in messages.collect())
    assert got == sorted((r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in rows.collect())


def test_many_turns_and_long_texts(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <") for i in range(2000)] + [(2, 0, "assistant", "x[" * 200_000)]
    back = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).select("conv_id", F.size("turns").alias("n"), chat.under_mask().alias("loss")).collect()
    by = {r["conv_id"]: r for r in back}
    assert by[1]["n"] == 2000 and by[1]["loss"] == "".join(f"turn {i} <" for i in range(1, 2000, 2)) and by[2]["loss"] == "x[" * 200_000


def test_folding_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "m1", "user", "delta", "He"), (1, 2, "m2", "assistant", "delta", "Wrong"), (1, 3, "m1", "user", "delta", "llo"), (1, 4, "m2", None, "regenerate", None),
        (1, 5, "m2", None, "delta", "Ri"), (1, 6, "m2", None, "delta", "ght"), (1, 7, "m1", None, "edit", "Bye"), (1, 8, "m1", None, "delta", "!"), (1, 9, "m3", "user", "noise", "zzz"),
        (2, 1, "m1", "user", "edit", None),
    ]
    frame = spark.createDataFrame(log, "conv_id long, seq long, message string, role string, kind string, text string")
    got = chat.read_back(chat.render(chat.fold(frame))).orderBy("conv_id").collect()
    assert [(t["role"], t["text"]) for t in got[0]["turns"]] == [("user", "Bye!"), ("assistant", "Right"), ("user", "")]
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "")]
