"""Chat formatting from event logs, with DataFrame functions only.

A log holds events of a conversation in a sequence: `message` begins a message, `delta` appends to it, `edit` sets
its text anew, `regenerate` sets it anew and takes back every later message's events so far. Folding sorts each
conversation's events once (one shuffle, by conversation; all later steps keep that partitioning). A message is the
text of its last start and the deltas after it.

Rendering marks each turn and escapes control strings in roles and texts so that the output can be read back. A
conversation is one row of the output, so one conversation must fit a row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template. An escaped text holds no "<", so no mark can come from it.
TURN, END = "<|turn|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.regexp_replace(out, r"\[(/?INST)", "&lsqb;$1")


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&lsqb;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, kind, msg, role, text) -> (conv_id, msg, role, text), the final messages.

    Events of equal seq are taken by msg, kind, text. Null texts are empty; a null role is that of the message's last
    event with one, or empty. Messages without a start begin empty. Unknown kinds are an error.
    """
    known = F.col("kind").isin("message", "delta", "edit", "regenerate")
    kind = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null")))))
    rows = events.select("conv_id", "seq", kind.alias("kind"), "msg", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col(c) for c in ("seq", "msg", "kind", "text")]
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    again = F.when(F.col("kind") == "regenerate", F.col("at"))
    # The last regeneration of an earlier message takes this event back if it came later.
    earlier = Window.partitionBy("conv_id").orderBy("msg").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_reset", F.max(again).over(earlier)).where(F.col("_reset").isNull() | (F.col("at") >= F.col("_reset")))
    whole = Window.partitionBy("conv_id", "msg")
    start = F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(whole)
    role = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).over(whole)
    rows = rows.withColumn("_start", start).withColumn("_role", F.coalesce(role, F.lit(""))).where(F.col("_start").isNull() | (F.col("at") >= F.col("_start")))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return rows.groupBy("conv_id", "msg").agg(
        F.first("_role").alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """(conv_id, msg, role, text) -> conv_id, formatted, loss_spans (start, end exclusive in code points)."""
    role, text = escaped_role(F.col("role")), escaped(F.col("text"))
    turns = messages.select("conv_id", "msg", (F.col("role") == learn_from).alias("learn"), F.concat(F.lit(TURN), role, F.lit("\n")).alias("head"), text.alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    so_far = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(so_far), F.lit(0)) + F.length("head"))
    span = F.when(F.col("learn"), F.struct(F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("end")))
    rows = F.array_sort(F.collect_list(F.struct("msg", F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span"))))
    return turns.groupBy("conv_id").agg(rows.alias("_rows")).select(
        "conv_id",
        F.array_join(F.transform("_rows", lambda r: r["turn"]), "").alias("formatted"),
        F.filter(F.transform("_rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> from what `render` wrote."""
    turns = F.split(formatted, r"<\|turn\|>", -1)
    turns = F.filter(turns, lambda t, k: k > 0)
    bodies = F.transform(turns, lambda t: F.substring(t, F.lit(1), F.length(t) - len(END)))
    return F.transform(
        bodies,
        lambda t: F.struct(
            unescaped_role(F.substring_index(t, "\n", 1)).alias("role"), unescaped(F.substring(t, F.locate("\n", t) + 1, F.length(t))).alias("text")
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescaped(F.array_join(F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a log: every row begins a message; rows of equal turn are messages of their own, by role, text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).alias("msg"))
    return numbered.select("conv_id", F.col("msg").alias("seq"), F.lit("message").alias("kind"), "msg", "role", "text")


def report(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output, as digests."""
    turns = read_back(F.col("formatted"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumn("turns", turns).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(conversations: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """Rows by turn -> one formatted row for each conversation. Null roles and texts are empty, a null conv_id is a
    conversation of its own, equal turns are kept in the order of role and text, an empty table gives no rows."""
    return render(fold(turns_as_events(conversations)), learn_from)
