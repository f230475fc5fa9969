"""Conversation tables and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.operators import dialogs
from recallgrid.operators.hooks import token_counter
from recallgrid.plans.registry import query, table

_SIZED = "sized AS (SELECT *, CAST(length(role) + length(text) + 32 AS BIGINT) AS chars FROM conversations)"
_HEAD = "heads AS (SELECT conv_id, min(turn) AS head, arg_min(chars, turn) AS head_chars FROM sized GROUP BY conv_id)"


@query("token_totals", f"""
WITH {_SIZED} SELECT conv_id, count(*) AS n_messages, CAST(ceil(sum(chars) / 4.0) AS BIGINT) AS tokens FROM sized GROUP BY conv_id""")
def token_totals(spark, d):
    return dialogs.token_totals(table(spark, d, "conversations"))


@query("token_totals_tokenizer", """
SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text) - length(replace(text, ' ', '')) + 1) AS BIGINT) AS tokens
FROM conversations GROUP BY conv_id""")
def token_totals_tokenizer(spark, d):
    """Tokens by a tokenizer hook, here one that cuts at blanks."""
    counter = token_counter(lambda: lambda text: text.split(" "))
    return dialogs.counted_tokens(table(spark, d, "conversations"), counter)


_TRIM_SQL = f"""
WITH {_SIZED}, {_HEAD},
rest AS (SELECT s.*, h.head_chars, row_number() OVER w AS rn, sum(chars) OVER (w ROWS UNBOUNDED PRECEDING) AS run
  FROM sized s JOIN heads h USING (conv_id) WHERE turn > head WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, role, text FROM sized JOIN heads USING (conv_id) WHERE turn = head
UNION ALL SELECT conv_id, turn, role, text FROM rest WHERE rn <= 2 OR ceil((head_chars + run) / 4.0) <= 300"""


@query("trim_history", _TRIM_SQL)
def trim_history(spark, d):
    return dialogs.trim(table(spark, d, "conversations"), limit=300, min_keep=2)


@query("trim_history_tokenizer", _TRIM_SQL)
def trim_history_tokenizer(spark, d):
    """The tokenizer path, with a counter that agrees with the default estimate."""

    def count(pairs):
        return -(-sum(len(role) + len(text) + 32 for role, text in pairs) // 4)

    return dialogs.trim_exact(table(spark, d, "conversations"), count, limit=300, min_keep=2)


_LINES = """upper(role) || ': ' || substr(text, 1, 300)"""


@query("transcript", f"""
SELECT conv_id, count(*) AS n_lines, string_agg({_LINES}, chr(10) ORDER BY turn) AS transcript
FROM conversations WHERE text <> '' GROUP BY conv_id""")
def transcript(spark, d):
    return dialogs.transcript(table(spark, d, "conversations"))


def long_talks(spark, d):
    """Conversations run together into three long ones, turns numbered anew."""
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") % 3).alias("conv_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"), "role", "text")


_LONG_SQL = "talks AS (SELECT conv_id % 3 AS conv_id, conv_id * 1000 + turn AS turn, role, text FROM conversations)"


@query("transcript_long", f"""
WITH {_LONG_SQL} SELECT conv_id, count(*) AS n_lines, string_agg({_LINES}, chr(10) ORDER BY turn) AS transcript
FROM talks WHERE text <> '' GROUP BY conv_id""")
def transcript_long(spark, d):
    return dialogs.transcript(long_talks(spark, d))


@query("summarize_long", f"""
WITH {_LONG_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM talks),
older AS (SELECT * FROM numbered WHERE pos > 1 AND back > 3),
s AS (SELECT conv_id, min(turn) AS turn, 'system' AS role, concat('[Earlier conversation (', count(*), ' messages): ',
    substr(string_agg({_LINES}, chr(10) ORDER BY turn) FILTER (WHERE text <> ''), 1, 200), ']') AS text FROM older GROUP BY conv_id)
SELECT conv_id, turn, role, text FROM s
UNION ALL SELECT conv_id, turn, role, text FROM numbered WHERE NOT (pos > 1 AND back > 3)""")
def summarize_long(spark, d):
    return dialogs.summarize(long_talks(spark, d), dialogs.first_characters(200), min_keep=3)


_SPLIT = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
older AS (SELECT * FROM numbered WHERE pos > 1 AND back > 3)"""


@query("head_tail_split", f"""
WITH {_SPLIT} SELECT conv_id, turn, pos > 1 AND back > 3 AS older FROM numbered""")
def head_tail_split(spark, d):
    older, kept = dialogs.head_tail(table(spark, d, "conversations"), min_keep=3)
    return older.select("conv_id", "turn", F.lit(True).alias("older")).unionByName(
        kept.select("conv_id", "turn", F.lit(False).alias("older")))


@query("summarize_history", f"""
WITH {_SPLIT},
s AS (SELECT conv_id, min(turn) AS turn, 'system' AS role, concat('[Earlier conversation (', count(*), ' messages): ',
    substr(string_agg({_LINES}, chr(10) ORDER BY turn) FILTER (WHERE text <> ''), 1, 200), ']') AS text FROM older GROUP BY conv_id)
SELECT conv_id, turn, role, text FROM s
UNION ALL SELECT conv_id, turn, role, text FROM numbered WHERE NOT (pos > 1 AND back > 3)""")
def summarize_history(spark, d):
    return dialogs.summarize(table(spark, d, "conversations"), dialogs.first_characters(200), min_keep=3)


@query("fit_context", f"""
WITH {_SPLIT}, {_SIZED},
long AS (SELECT conv_id FROM sized GROUP BY conv_id HAVING ceil(sum(chars) / 4.0) > 500),
s AS (SELECT conv_id, min(turn) AS turn, 'system' AS role, concat('[Earlier conversation (', count(*), ' messages): ',
    substr(string_agg({_LINES}, chr(10) ORDER BY turn) FILTER (WHERE text <> ''), 1, 200), ']') AS text
  FROM older WHERE conv_id IN (FROM long) GROUP BY conv_id)
SELECT conv_id, turn, role, text FROM s
UNION ALL SELECT conv_id, turn, role, text FROM numbered WHERE conv_id NOT IN (FROM long) OR NOT (pos > 1 AND back > 3)""")
def fit_context(spark, d):
    return dialogs.fit_context(
        table(spark, d, "conversations"), dialogs.first_characters(200), limit=500, min_keep=3)


@query("tool_cap_hits", """
SELECT count(*) AS tool_cap_hits FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS rounds,
  arg_max(role, turn) = 'assistant' AS answered FROM conversations GROUP BY conv_id) WHERE rounds >= 2 AND NOT answered""")
def tool_cap_hits(spark, d):
    turns = dialogs.tool_rounds(table(spark, d, "conversations"))
    return dialogs.cap_hits(turns, F.col("rounds"), F.col("answered"), cap=2)


@query("session_expiry", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, CAST(no AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events
FROM n GROUP BY user_id, no""")
def session_expiry(spark, d):
    return dialogs.idle_sessions(table(spark, d, "events"), "user_id", "ts")


@query("lru_sessions", """
WITH l AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id)
SELECT user_id, last_ts FROM l WHERE (SELECT max(last_ts) FROM l) - last_ts <= INTERVAL 2 DAY
ORDER BY last_ts DESC, user_id LIMIT 100""")
def lru_sessions(spark, d):
    return dialogs.live_sessions(table(spark, d, "events"), "user_id", "ts", ttl_seconds=2 * 86_400, cap=100)


@query("first_seen", """
SELECT user_id, json_extract_string(props, '$.k') AS booking, min(event_id) AS first_seen FROM events
WHERE event_type = 'purchase' GROUP BY ALL""")
def first_seen(spark, d):
    e = table(spark, d, "events").withColumn(
        "booking", F.when(F.col("event_type") == "purchase", F.get_json_object("props", "$.k")))
    return dialogs.first_seen(e, "user_id", "booking", "event_id")
