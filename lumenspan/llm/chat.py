"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events (conv_id, seq, message, role, kind, text): `delta` appends to a message, `edit` replaces what it
says so far, `regenerate` empties it. The log is dealt by conversation and folded in sequence order into final
messages, which are then rendered with turn markers. Control strings in texts are escaped reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.sparkkit import running

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Every control string of the usual templates (<s>, </s>, <<SYS>>, <|...|>, [INST]) begins with < or [.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\k"))
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """No escaped text has < or [; the backslash comes first, so its own escapes are told apart."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def events_of(conversations: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) as a log whose fold is those rows: conv_id, turn, place, seq, role,
    kind, text.

    As a chat service would have streamed them: a message comes in two deltas, or as a draft that is regenerated, or as
    a beginning that is edited, drawn by a hash of conversation and turn. (turn, place) names a message, place telling
    rows of one turn apart in the order of role and text; equal rows stay separate messages. Nulls: empty text or role,
    turn before all others. Rows are dealt by conversation and turn, so a long conversation is spread out."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).cast("long")
    half = F.floor(F.length("text") / 2).cast("int")
    begin, rest = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    event = lambda step, kind, said: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), said.alias("text"))
    ways = [
        (event(0, "delta", begin), event(1, "delta", rest)),
        (event(0, "delta", F.concat(F.lit("Draft: "), begin)), event(1, "regenerate", F.lit("")), event(2, "delta", F.col("text"))),
        (event(0, "delta", begin), event(1, "edit", F.col("text"))),
    ]
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    drawn = F.when(way == 0, F.array(*ways[0])).when(way == 1, F.array(*ways[1])).otherwise(F.array(*ways[2]))
    log = rows.withColumn("place", place).select("conv_id", "turn", "place", "role", F.explode(drawn).alias("e"))
    return log.select("conv_id", "turn", "place", F.struct("turn", "place", "e.step").alias("seq"), "role", "e.kind", "e.text")


def fold(events: DataFrame, message: tuple[str, ...] = ("message",)) -> DataFrame:
    """Final messages (conv_id, message, role, text), `message` being ordered as in its conversation; events: conv_id, seq
    (any type that has an order), role, kind, text, and the columns that name a message.

    A message stands where its first event does and takes the last role that is not null. A null seq comes before all
    others; ties are ordered by kind and text; unknown kinds and null texts add nothing. Equal events count each; extra
    columns are ignored; no events give no messages."""
    step = F.struct(
        F.col("seq").alias("seq"), F.col("kind").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role")
    )
    log = F.col("log")
    last_reset = F.greatest(
        F.lit(0), F.coalesce(F.array_max(F.transform(log, lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i))), F.lit(0))
    )
    said = F.transform(
        F.slice(log, last_reset + 1, F.size(log)), lambda e: F.when(e["kind"].isin("delta", "edit"), e["text"]).otherwise("")
    )
    roles = F.filter(F.transform(log, lambda e: e["role"]), lambda r: r.isNotNull())
    return (
        events.groupBy("conv_id", *message)
        .agg(F.array_sort(F.collect_list(step)).alias("log"))
        .select(
            "conv_id",
            F.struct(F.element_at(log, 1)["seq"].alias("seq"), *message).alias("message"),
            F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
            F.array_join(said, "").alias("text"),
        )
    )


def render(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row a conversation: `formatted`, and `loss_spans` (start, length in code points of `formatted`) over the
    escaped texts of `loss_role`, in order. messages: conv_id, message, role, text; nulls of the last two are empty
    here. Messages meet in the one row that is their conversation, and nowhere else; repeated ones are rendered each;
    extra columns are ignored; no messages give no rows."""
    head = F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    pieces = messages.select(
        "conv_id",
        F.struct(
            "message", F.concat(head, body, F.lit(CLOSE)).alias("piece"), F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"),
            F.length(head).alias("head_n"), F.length(body).alias("n"),
        ).alias("turn"),
    )
    turns = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    ends = running(F.transform("turns", lambda t: F.length(t["piece"])))
    span = lambda t, end: F.when(t["loss"], F.struct((end - F.length(t["piece"]) + t["head_n"]).cast("long").alias("start"), t["n"].cast("long").alias("length")))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.zip_with("turns", ends, span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Rendered rows with `turns`, the roles and unescaped texts that `formatted` says; an empty table stays empty."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    turns = F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1, F.length(p) - F.instr(p, F.lit("\n")) - len(CLOSE))).alias("text"),
            F.length(p).alias("n"),
        ),
    )
    return rendered.select("*", turns.alias("turns"))


def under_mask() -> Column:
    """The unescaped text under the loss spans of `formatted`, joined."""
    return F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> events -> final messages -> rendered rows: conv_id, formatted,
    loss_spans. Null text or role: empty; null turn: first; a null conv_id is a conversation of its own. Equal rows stay
    separate messages; extra columns are ignored; an empty table gives no rows."""
    return render(fold(events_of(conversations), ("turn", "place")))
