"""Chat formatting by event-sourced reconstruction, in built-in functions only.

A log has one row per event: ``open`` starts a message with a role and perhaps some text, ``delta`` appends to it, ``edit``
replaces its text, ``regenerate`` empties it for new deltas. Edits and regenerations rewind: messages that were opened
later than their target and before the event are dropped. Events are partitioned by conversation and sorted by
sequence; the fold is running aggregates over that order, so no conversation is rebuilt message by message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """No control string is left: ``\\`` doubles and ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text of each message that stands at the end of the log (conv_id, seq, kind, message, role, text).

    Events of a conversation are ordered by seq, ties by kind, role and text; null seq comes first. A message without an
    ``open`` event has the empty role; null roles and texts are empty. Events of other kinds raise an error. A null conv_id or
    message is a value like any other. Other columns are not read.
    """
    log = events.select("conv_id", "seq", "kind", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = F.col("kind").isin("open", "delta", "edit", "regenerate")
    log = log.withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.lit("event kinds are open, delta, edit and regenerate"))))
    conversation, message = Window.partitionBy("conv_id"), Window.partitionBy("conv_id", "message")
    log = log.withColumn("n", F.row_number().over(conversation.orderBy("seq", "kind", "role", "text")))
    reset = F.col("kind") != "delta"
    log = log.withColumn("opened", F.min(F.when(F.col("kind") == "open", F.col("n"))).over(message)).withColumn("opened", F.coalesce("opened", F.min("n").over(message)))
    log = log.withColumn("since", F.max(F.when(reset, F.col("n"))).over(message))
    rewinds = F.when(F.col("kind").isin("edit", "regenerate"), F.col("opened"))
    log = log.withColumn("rewound", F.min(rewinds).over(conversation.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)))
    dropped = F.max(F.when((F.col("n") == F.col("opened")) & (F.col("rewound") < F.col("opened")), 1)).over(message)
    log = log.withColumn("dropped", dropped).where(F.col("dropped").isNull())
    parts = F.when(F.col("n") >= F.coalesce("since", F.lit(0)), F.struct("n", "text"))
    out = log.groupBy("conv_id", "message").agg(F.min("opened").alias("at"), F.max(F.when(F.col("kind") == "open", F.struct("n", "role"))).alias("who"), F.array_sort(F.collect_list(parts)).alias("parts"))
    return out.select("conv_id", "message", "at", F.coalesce("who.role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_spans (start and end in code points of each text of role ``trained``) for each conversation."""
    piece = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END))
    pieces = messages.select("conv_id", "at", F.col("role").eqNullSafe(trained).alias("lossy"), piece.alias("piece"), F.length(escaped(F.col("text"))).alias("size"))
    order = Window.partitionBy("conv_id").orderBy("at")
    end = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END)
    placed = pieces.withColumn("end", end)
    turn = F.struct("at", "piece", F.when(F.col("lossy"), F.struct((F.col("end") - F.col("size")).alias("start"), F.col("end").alias("end"))).alias("span"))
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    head = F.transform(pieces, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    return F.transform(head, lambda p: F.struct(unescaped_role(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def rows_as_events(conversations: DataFrame, streamed: str = "assistant") -> DataFrame:
    """The log that leads to the rows of (conv_id, turn, role, text), rows of equal turn by role, then text, each kept.

    A message of role ``streamed`` begins as a draft, is regenerated and arrives in three deltas. Any other begins with half
    its text, is answered at once, and its edit to the whole text takes that answer back.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).alias("n"))
    third = F.ceil(F.length("text") / 3).cast("int")
    part = lambda i: F.substring(F.col("text"), third * i + 1, third)
    event = lambda step, kind, message, role, text: F.struct((F.col("n") * 8 + step).alias("seq"), F.lit(kind).alias("kind"), message.alias("message"), role.alias("role"), text.alias("text"))
    n, none = F.col("n"), F.lit(None).cast("string")
    arrives = [event(0, "open", n, F.col("role"), part(0)), event(1, "delta", n, none, part(2)), event(2, "regenerate", n, none, none), *(event(3 + i, "delta", n, none, part(i)) for i in range(3))]
    changes = [event(0, "open", n, F.col("role"), part(0)), event(1, "open", -n, F.lit(streamed), part(1)), event(2, "edit", n, none, F.col("text"))]
    log = F.when(F.col("role") == streamed, F.array(*arrives)).otherwise(F.array(*changes))
    return rows.select("conv_id", F.inline(log))


def formatted(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans for conversations given as rows by turn; see ``reconstruct`` and ``render``."""
    return render(reconstruct(rows_as_events(conversations, trained)), trained)
