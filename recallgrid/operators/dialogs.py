"""Conversation tables: token totals, budget trimming, transcripts, summaries, idle sessions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from recallgrid.operators.hooks import MESSAGE_OVERHEAD, message_chars, tokens_of
from recallgrid.operators.ranking import top_k
from recallgrid.schema import CONTEXT_MIN_MESSAGES, CONTEXT_TOKENS, MAX_SESSIONS, MAX_TOOL_ROUNDS, SESSION_TTL_SECONDS
from recallgrid.session import write_out

_DAY_MICROS = 86_400_000_000

#: Turns that are put together in one step on the way to a transcript.
_SEGMENT = 256


def token_totals(messages: DataFrame, conv: str = "conv_id", chars: Column | None = None) -> DataFrame:
    size = message_chars(F.col("role"), F.col("text")) if chars is None else chars
    return messages.groupBy(conv).agg(
        F.count("*").alias("n_messages"), tokens_of(F.sum(size)).alias("tokens"))


def counted_tokens(messages: DataFrame, counter: Callable[[Column], Column], conv: str = "conv_id") -> DataFrame:
    """``token_totals`` by a tokenizer (see ``hooks.token_counter``): each message is counted as its JSON object.

    Messages are counted where they lie and only their counts move; the brackets and commas between them are not counted.
    """
    text = F.to_json(F.struct(F.col("role").alias("role"), F.col("text").alias("content")), {"ignoreNullFields": "false"})
    sized = messages.select(conv, counter(text).alias("_tokens"))
    return sized.groupBy(conv).agg(F.count("*").alias("n_messages"), F.sum("_tokens").alias("tokens"))


def _heads(messages: DataFrame, conv: str, turn: str) -> DataFrame:
    """First message of each conversation: its turn and size (one small row per conversation)."""
    return messages.groupBy(conv).agg(
        F.min(turn).alias("_head"),
        F.min_by(message_chars(F.col("role"), F.col("text")), turn).alias("_head_chars"),
        F.count("*").alias("_n"),
    )


def trim(
    messages: DataFrame, limit: int = CONTEXT_TOKENS, min_keep: int = CONTEXT_MIN_MESSAGES,
    conv: str = "conv_id", turn: str = "turn",
) -> DataFrame:
    """Messages that survive a token budget.

    The first message always stays. Of the others the newest stay while the total fits, and the last ``min_keep``
    even if it does not. Rows that repeat a turn stay or go together. Every message takes at least ``MESSAGE_OVERHEAD`` characters, which bounds how many of the newest messages of
    a conversation can matter: they are picked in slices first, and a conversation of any length is never sorted whole.
    """
    heads = _heads(messages, conv, turn)
    # Sizes only: texts take no part in the ranking and meet one row a conversation in the end.
    sized = messages.select(conv, turn, message_chars(F.col("role"), F.col("text")).alias("_chars"))
    reach = max(min_keep, 4 * limit // MESSAGE_OVERHEAD) + 2
    recent = top_k(sized, [conv], [F.col(turn).desc()], reach, "_new", spread=F.col(turn))
    rest = recent.join(heads.select(conv, "_head", "_head_chars"), conv).filter(F.col(turn) > F.col("_head"))
    newest_first = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    running = F.sum("_chars").over(newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = rest.withColumn("_sum", running).filter(
        (F.col("_new") <= min_keep) | (tokens_of(F.col("_head_chars") + F.col("_sum")) <= limit))
    since = kept.groupBy(conv).agg(F.min(turn).alias("_since"))
    bounds = heads.select(conv, "_head").join(since, conv, "left")
    return messages.join(bounds, conv).filter(
        (F.col(turn) == F.col("_head")) | (F.col(turn) >= F.col("_since"))).select(*messages.columns)


def trim_exact(
    messages: DataFrame, count: Callable[[list[tuple[str, str]]], int], limit: int = CONTEXT_TOKENS,
    min_keep: int = CONTEXT_MIN_MESSAGES, conv: str = "conv_id", turn: str = "turn", min_tokens: int = 2,
) -> DataFrame:
    """Budget trimming with a real tokenizer, whose counts of a whole history do not add up message by message.

    ``count`` gets the (role, text) list of a history. ``min_tokens`` is what the caller's tokenizer takes for a message at least:
    then the newest ``limit / min_tokens`` messages and the first one are enough to decide, and no group is larger than that.
    Where it proves too high, because messages are left out although all that were looked at fit, the job fails rather than cut.
    """
    reach = max(min_keep, limit // min_tokens) + 2
    heads = messages.groupBy(conv).agg(F.min(turn).alias("_head"), F.count("*").alias("_all"))
    recent = top_k(messages.select(conv, turn), [conv], [F.col(turn).desc()], reach, "_new", spread=F.col(turn))
    bounds = heads.join(recent.groupBy(conv).agg(F.min(turn).alias("_since")), conv)
    group = messages.join(bounds, conv).filter((F.col(turn) == F.col("_head")) | (F.col(turn) >= F.col("_since"))).drop("_head", "_since")

    names = messages.columns

    def cut(pdf):
        rows = pdf.sort_values(turn)
        pairs = list(zip(rows["role"], rows["text"]))
        start, fits = 1, count(pairs) <= limit
        if not fits:  # least number of dropped messages, found by bisection: dropping more never costs tokens
            low, high = 1, max(1, len(pairs) - min_keep)
            while low < high:
                mid = (low + high) // 2
                if count(pairs[:1] + pairs[mid:]) <= limit:
                    high = mid
                else:
                    low = mid + 1
            start = low
        if len(rows) < rows["_all"].iloc[0] and start == 1 and len(rows) - 1 > min_keep:
            raise ValueError(f"a message takes fewer than min_tokens={min_tokens} tokens; pass a smaller bound")
        return rows.iloc[[0, *range(start, len(rows))]][names]

    return group.groupBy(conv).applyInPandas(cut, messages.schema)


def transcript(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", width: int = 300, segment: int | None = None,
) -> DataFrame:
    """``ROLE: text`` lines of non-empty messages in order, cut at ``width`` characters: one text per conversation.

    With ``segment``, one row per conversation and that many turns (column ``segment``); a conversation's segments in order,
    joined by line breaks, are its transcript, and no row gathers more lines if turns are unique.
    """
    line = F.concat(F.upper(F.coalesce("role", F.lit(""))), F.lit(": "), F.substring("text", 1, width))
    lines = messages.filter(F.coalesce("text", F.lit("")) != "").select(
        conv, F.floor(F.col(turn) / (segment or _SEGMENT)).cast("long").alias("segment"), F.struct(turn, line.alias("line")).alias("m"))
    grouped = lines.groupBy(conv, "segment").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    parts = grouped.select(
        conv, "segment", F.size("ms").cast("long").alias("n_lines"),
        F.array_join(F.transform("ms", lambda m: m["line"]), "\n").alias("transcript"))
    if segment:
        return parts
    whole = parts.groupBy(conv).agg(
        F.sum("n_lines").alias("n_lines"), F.array_sort(F.collect_list(F.struct("segment", "transcript"))).alias("ps"))
    return whole.select(conv, "n_lines", F.array_join(F.transform("ps", lambda p: p["transcript"]), "\n").alias("transcript"))


def head_tail(
    messages: DataFrame, min_keep: int = CONTEXT_MIN_MESSAGES, conv: str = "conv_id", turn: str = "turn",
) -> tuple[DataFrame, DataFrame]:
    """(older, kept): all but the first and the last ``min_keep`` messages, and the rest.

    The turn at which the kept tail starts comes from a top-k of turn numbers only; texts are not sorted.
    """
    if min_keep <= 0:  # as a slice from -0 does: everything is the tail
        return messages.limit(0), messages
    heads = messages.groupBy(conv).agg(F.min(turn).alias("_head"))
    tail = top_k(messages.select(conv, turn), [conv], [F.col(turn).desc()], min_keep, "_r", spread=F.col(turn))
    bounds = heads.join(tail.groupBy(conv).agg(F.min(turn).alias("_tail")), conv)
    marked = messages.join(bounds, conv)
    is_old = (F.col(turn) > F.col("_head")) & (F.col(turn) < F.col("_tail"))
    return marked.filter(is_old).select(*messages.columns), marked.filter(~is_old).select(*messages.columns)


def summaries(older: DataFrame, summary: Callable[[Column], Column], conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, turn, n, answer: the summary of each conversation that has older text; a null answer is a failure.

    ``summary`` maps a transcript to its summary and gets each conversation's whole transcript. A summary with a ``merge`` (from
    an array of the summaries of consecutive parts to the summary of all) gets bounded parts instead.
    """
    merge = getattr(summary, "merge", None)
    if merge is None:
        text = transcript(older, conv, turn).filter(F.trim("transcript") != "").select(conv, summary(F.col("transcript")).alias("answer"))
    else:
        parts = transcript(older, conv, turn, segment=_SEGMENT).select(
            conv, F.trim("transcript").alias("_t"), F.struct("segment", summary(F.col("transcript")).alias("s")).alias("_s"))
        text = parts.groupBy(conv).agg(F.max(F.col("_t") != "").alias("_any"), F.array_sort(F.collect_list("_s")).alias("_p")).filter(
            "_any").select(conv, merge(F.transform("_p", lambda p: p["s"])).alias("answer"))
    counts = older.groupBy(conv).agg(F.count("*").alias("n"), F.min(turn).alias(turn))
    return counts.join(text, conv)


def summarize(
    messages: DataFrame, summary: Callable[[Column], Column], min_keep: int = CONTEXT_MIN_MESSAGES,
    conv: str = "conv_id", turn: str = "turn",
) -> DataFrame:
    """Replace the older part of each conversation by one system message right after its first message.

    Conversations without older text, or without an answer of ``summary`` (see ``summaries``), stay as they are. The count in the
    message takes in empty messages, the transcript does not.
    """
    older, kept = head_tail(messages, min_keep, conv, turn)
    # Written: the message and the rows it stands for need the same answer, and the hook is asked once.
    made = write_out(summaries(older, summary, conv, turn), "summaries")
    return _replaced(older, kept, made.filter(F.col("answer").isNotNull()), conv, turn)


def _replaced(older: DataFrame, kept: DataFrame, made: DataFrame, conv: str, turn: str) -> DataFrame:
    message = made.select(
        conv, turn, F.lit("system").alias("role"),
        F.concat(F.lit("[Earlier conversation ("), F.col("n"), F.lit(" messages): "), "answer", F.lit("]")).alias("text"))
    untouched = older.join(made.select(conv), conv, "left_anti")
    return kept.unionByName(message, allowMissingColumns=True).unionByName(untouched)


def first_characters(n: int = 200) -> Callable[[Column], Column]:
    """Default summary: the start of the transcript."""
    def summary(text: Column) -> Column:
        return F.substring(text, 1, n)

    # Exact: a part that is cut is at least as long as what may follow.
    summary.merge = lambda parts: F.substring(F.array_join(parts, "\n"), 1, n)
    return summary


def over_budget(messages: DataFrame, limit: int = CONTEXT_TOKENS, conv: str = "conv_id") -> DataFrame:
    """Conversations whose history exceeds the budget."""
    return token_totals(messages, conv).filter(F.col("tokens") > limit).select(conv)


def fit_context(
    messages: DataFrame, summary: Callable[[Column], Column] | None = None, limit: int = CONTEXT_TOKENS,
    min_keep: int = CONTEXT_MIN_MESSAGES, conv: str = "conv_id", turn: str = "turn",
) -> DataFrame:
    """Conversations over the budget are summarised, or trimmed without a summary hook or its answer; the others stay whole.

    The hook is asked once for each of them, and its answers written out, so that no two answers can disagree.
    """
    if summary is None:
        return trim(messages, limit, min_keep, conv, turn)
    long = over_budget(messages, limit, conv)
    over = messages.join(long, conv, "left_semi")
    older, kept = head_tail(over, min_keep, conv, turn)
    made = write_out(summaries(older, summary, conv, turn), "summaries")
    failed = made.filter(F.col("answer").isNull()).select(conv)
    good = made.filter(F.col("answer").isNotNull())
    changed = _replaced(older.join(failed, conv, "left_anti"), kept.join(failed, conv, "left_anti"), good, conv, turn)
    trimmed = trim(over.join(failed, conv, "left_semi"), limit, min_keep, conv, turn)
    return messages.join(long, conv, "left_anti").unionByName(changed).unionByName(trimmed)


def cap_hits(turns: DataFrame, rounds: Column, has_answer: Column, cap: int = MAX_TOOL_ROUNDS) -> DataFrame:
    """Number of turns that used up their tool rounds without a text answer."""
    return turns.agg(F.count_if((rounds >= cap) & ~has_answer).cast("long").alias("tool_cap_hits"))


def first_seen(rows: DataFrame, session: str, item: str, order: str) -> DataFrame:
    """Distinct items of each session with the position of their first appearance."""
    return rows.filter(F.col(item).isNotNull()).groupBy(session, item).agg(F.min(order).alias("first_seen"))


def micros(ts: Column) -> Column:
    """Clock reading as microseconds since 1970, independent of the session time zone."""
    of_day = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000
    second = (F.date_part(F.lit("second"), ts) * 1_000_000).cast("long")
    return F.unix_date(ts.cast("date")).cast("long") * _DAY_MICROS + of_day + second


def idle_sessions(
    events: DataFrame, user: str, ts: str, ttl_seconds: int = SESSION_TTL_SECONDS,
) -> DataFrame:
    """Sessions of each user, a new one starting after more than ``ttl_seconds`` without an event.

    Inside a time slot of that width no gap can end a session, so events are first combined per user and slot, map-side.
    The window then sees one row per slot, which bounds it by the time span and not by the number of events.
    """
    width = ttl_seconds * 1_000_000
    at = events.select(F.col(user), F.col(ts), micros(F.col(ts)).alias("_us"))
    slots = at.groupBy(user, F.floor(F.col("_us") / width).alias("_slot")).agg(
        F.min("_us").alias("_from"), F.max("_us").alias("_to"), F.min(ts).alias("_start"), F.max(ts).alias("_end"),
        F.count("*").alias("_n"))
    w = Window.partitionBy(user).orderBy("_slot")
    starts = F.coalesce((F.col("_from") - F.lag("_to").over(w) > width).cast("int"), F.lit(1))
    numbered = slots.withColumn("_new", starts).withColumn("session_no", F.sum("_new").over(w))
    return numbered.groupBy(user, "session_no").agg(
        F.min("_start").alias("session_start"), F.max("_end").alias("session_end"), F.sum("_n").alias("n_events"))


def live_sessions(
    events: DataFrame, session: str, ts: str, ttl_seconds: int = SESSION_TTL_SECONDS, cap: int = MAX_SESSIONS,
) -> DataFrame:
    """Sessions still held after the newest save: idle ones are evicted, then all but the ``cap`` most recent."""
    last = events.groupBy(session).agg(F.max(ts).alias("last_ts"))
    newest = last.agg(F.max("last_ts").alias("_now")).select(F.col("_now")).scalar()
    alive = last.filter(micros(newest) - micros(F.col("last_ts")) <= ttl_seconds * 1_000_000)
    return alive.orderBy(F.col("last_ts").desc(), session).limit(cap)


def tool_rounds(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", calls: Sequence[str] = ("assistant",)):
    """Per conversation: messages of the calling roles, and whether the last message is an answer."""
    return messages.groupBy(conv).agg(
        F.count_if(F.col("role").isin(*calls)).alias("rounds"),
        (F.max_by("role", turn) == "assistant").alias("answered"))
