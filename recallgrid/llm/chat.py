"""Chat formatting from an event log: fold each message's events into its final text, then render the conversation.

Everything is DataFrame expressions; messages are folded before conversations are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END = "###", "</turn>"

#: Kinds of events. ``message`` is a whole message by itself; the others share a message_id.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"


def escape(text: Column) -> Column:
    r"""Text in which neither control string can occur: ``\`` is doubled, ``</turn>`` and ``##`` are broken by a ``\``."""
    return F.replace(
        F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(END), F.lit("<\\/turn>")), F.lit("##"), F.lit("#\\#"))


def escape_role(role: Column) -> Column:
    """Also keeps ``: `` out, which ends the role in a turn's head."""
    return F.replace(escape(role), F.lit(": "), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of a log (conv_id, seq, message_id, kind, role, text).

    Events of a message count in the order of seq (ties: kind, role, text). ``edit`` and ``regenerate`` replace what came before, ``delta`` appends.
    The message stands at its first event's seq and has the first role that is not null. ``message`` rows, and rows with a null
    message_id, are messages of their own, so repeated rows stay. Null texts are empty; unknown kinds append.
    """
    whole = (F.coalesce(F.col("kind"), F.lit(MESSAGE)) == MESSAGE) | F.col("message_id").isNull()
    alone = events.filter(whole).select("conv_id", "seq", "role", F.coalesce("text", F.lit("")).alias("text"))
    parts = events.filter(~whole).groupBy("conv_id", "message_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("log"))
    at = F.transform("log", lambda e, i: F.when(e["kind"].isin(EDIT, REGENERATE), i).otherwise(0))
    kept = F.slice("log", F.array_max(at) + 1, F.size("log"))
    return alone.unionByName(parts.select(
        "conv_id", F.col("log")[0]["seq"].alias("seq"),
        F.try_element_at(F.filter(F.col("log")["role"], lambda r: r.isNotNull()), F.lit(1)).alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text")))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    r"""One row per conversation: conv_id, formatted, loss_spans array<struct<start, length, turn, inside>>.

    A turn is ``### role: text</turn>`` and a line break, role and text escaped. Spans are code points of ``formatted`` that hold
    the texts of role ``trained``; ``turn`` is the number of a span's turn and ``inside`` its start within that turn. Messages are
    ordered by seq (nulls first; ties: role, text). A null role is empty. A conversation's text is one value, so a single conversation
    must fit a task; the work grows in proportion to its length.
    """
    told = messages.select(
        "conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumns({
            "head": F.concat(F.lit(f"{HEAD} "), escape_role(F.coalesce("role", F.lit(""))), F.lit(": ")),
            "body": escape(F.coalesce("text", F.lit("")))})
    size = (F.length("head") + F.length("body") + len(END) + 1).cast("long")
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    placed = told.withColumn("turn", F.row_number().over(order) - 1).withColumn("start", F.sum(size).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size)
    span = F.struct(
        (F.col("start") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"), "turn",
        F.length("head").alias("inside"))
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.concat("head", "body", F.lit(END + "\n")).alias("piece")))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("role") == trained, span))).alias("loss_spans"))
    return grouped.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_spans")


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where the body reads it in a lambda."""
    return F.transform(F.array(value), body)[0]


def _chunks(formatted: Column) -> Column:
    return F.split(formatted, f"{END}\n")


def parse(formatted: Column) -> Column:
    """Turns array<struct<role, text>> back from a rendered conversation."""
    return _bind(_chunks(formatted), lambda all_: F.transform(
        F.slice(all_, 1, F.size(all_) - 1), lambda c: _turn(F.substr(c, F.lit(len(HEAD) + 2)))))


def _turn(chunk: Column) -> Column:
    return F.struct(
        unescape(F.substring_index(chunk, ": ", 1)).alias("role"),
        unescape(F.substr(chunk, F.length(F.substring_index(chunk, ": ", 1)) + 3)).alias("text"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. Spans are cut out of their turns, not counted from the start."""
    return _bind(_chunks(formatted), lambda all_: F.array_join(F.transform(
        spans, lambda s: unescape(F.substr(F.get(all_, s["turn"]), s["inside"] + 1, s["length"].cast("int")))), ""))


def format_chats(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """Fold a log and render it; see ``fold_messages`` and ``render``. No rows give no rows, other columns are ignored."""
    return render(fold_messages(events), trained)
