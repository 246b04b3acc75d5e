"""Chat formatting: conversation events are folded into final messages, then rendered with a loss mask; built-in functions only.

An event has conv_id, turn, message, seq, kind, role and text. Of one message,
`message` and `edit` set the text, `delta` appends to it, `regenerate` clears it.

Format: `<|role|>text<|end|>` for each turn. Inside roles and texts the
characters backslash, `<`, `|` and `[` are written as a backslash and a letter,
so no control string of this or of other templates can occur in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

END = "<|end|>"
# The letter that follows the backslash for each escaped character.
ESCAPES = {"<": "l", "|": "p", "[": "b"}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, letter in ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(f"\\{letter}"))
    return out


def unescape(text: Column) -> Column:
    def part(p: Column) -> Column:
        for char, letter in ESCAPES.items():
            p = F.replace(p, F.lit(f"\\{letter}"), F.lit(char))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def logged_events(messages: DataFrame) -> DataFrame:
    """The log of streamed answers that `fold_events` undoes: events (conv_id, turn, message, seq, kind, role, text) for each row (conv_id, turn, role, text).

    An assistant's text is begun, thrown away by a regeneration and streamed
    anew in deltas of a third; any other text is sent as a draft and edited.
    Each row is a message of its own, rows of equal turns too; null texts stay
    null in one event.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    third = F.ceil(F.length(text) / 3).cast("int")
    event = lambda seq, kind, said: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), said.alias("said"))
    part = lambda k: F.substring(text, third * k + 1, third)
    streamed = F.array(event(0, "message", F.col("text")), event(1, "delta", F.lit(" (unfinished")), event(2, "regenerate", F.lit(None).cast("string")), *[event(3 + k, "delta", part(k)) for k in range(3)])
    edited = F.array(event(0, "message", F.lit("draft")), event(1, "edit", F.col("text")))
    rows = messages.select("conv_id", "turn", F.monotonically_increasing_id().alias("message"), "role", F.when(F.col("role") == "assistant", streamed).otherwise(edited).alias("log"))
    return rows.select("conv_id", "turn", "message", "role", F.inline("log")).select("conv_id", "turn", "message", "seq", "kind", "role", F.col("said").alias("text"))


def fold_events(events: DataFrame) -> DataFrame:
    """One row (conv_id, turn, role, text) per turn and `message`: its events in the order of `seq` folded into the final text.

    Null seq comes first, and of equal ones the smaller (kind, role, text); a
    null text counts as empty; the role is the first that is not null (else
    empty). Unknown kinds count as message; repeated events count as often as
    they occur; an empty log gives an empty table. A group is one message, not a
    conversation, so that a long conversation is folded in many tasks.
    """
    logged = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))

    def step(acc: Column, e: Column) -> Column:
        text = F.coalesce(e["text"], F.lit(""))
        new = F.when(e["kind"] == "delta", F.concat(acc["text"], text)).when(e["kind"] == "regenerate", F.lit("")).otherwise(text)
        return F.struct(F.coalesce(acc["role"], e["role"]).alias("role"), new.alias("text"))

    start = F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("text"))
    folded = events.groupBy("conv_id", "turn", "message").agg(F.aggregate(logged, start, step).alias("m"))
    return folded.select("conv_id", "turn", F.coalesce(F.col("m.role"), F.lit("")).alias("role"), F.col("m.text").alias("text"))


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row (conv_id, formatted, loss_spans) per conversation.

    loss_spans: start and end, in code points of `formatted`, of each text
    under the loss mask. Rows go by (turn, role, text), null turns first; null
    roles and texts count as empty; repeated rows are turns of their own; an
    empty table gives an empty one. A row holds its whole conversation.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    pieces = messages.groupBy("conv_id").agg(turns.alias("turns"))
    shown = F.transform("turns", lambda t: F.struct(F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>")).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*learn).alias("learn")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + F.length(p["head"])
        e = s + F.length(p["body"])
        out = F.when(p["learn"], F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"))))).otherwise(acc["out"])
        return F.struct((e + len(END)).alias("at"), out.alias("out"))

    formatted = lambda ps: F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    both = let(shown, lambda ps: F.struct(formatted(ps).alias("formatted"), F.aggregate(ps, start, step, lambda acc: acc["out"]).alias("loss_spans")))
    return pieces.select("conv_id", both.alias("x")).select("conv_id", "x.formatted", "x.loss_spans")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, r"<\|end\|>")
    turn = lambda p: F.struct(unescape(F.substring_index(F.substring(p, F.lit(3), F.length(p)), "|>", 1)).alias("role"), unescape(F.substring(p, F.locate("|>", p) + 2, F.length(p))).alias("text"))
    return let(parts, lambda ps: F.transform(F.slice(ps, F.lit(1), F.size(ps) - 1), turn))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return let(formatted, lambda f: F.array_join(F.transform(spans, lambda s: unescape(F.substring(f, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""))
