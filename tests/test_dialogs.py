import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import dialogs
from recallgrid.operators.hooks import token_counter

random.seed(3)
SCHEMA = "conv_id long, turn long, role string, text string"


def conversation(conv, n):
    rows = [(conv, 0, "system", "sys")]
    for i in range(n):
        rows += [(conv, 2 * i + 1, "user", f"u{i}" * 10), (conv, 2 * i + 2, "assistant", f"a{i}" * 10)]
    return rows


def tokens(rows):
    return -(-sum(len(r[2]) + len(r[3] or "") + 32 for r in rows) // 4)


def trimmed(rows, limit, keep):
    head, rest = rows[:1], rows[1:]
    while tokens(head + rest) > limit and len(rest) > keep:
        rest = rest[1:]
    return head + rest


@pytest.fixture(scope="module")
def talks(spark):
    rows = conversation(1, 1) + conversation(2, 200) + [(3, 5, "user", "only")]
    for c in range(4, 24):
        rows += [(c, t, random.choice(["user", "assistant", "tool"]), "x" * random.choice([0, 5, 400, 4000]))
                 for t in range(random.randint(1, 40))]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_conv(rows):
    out = {}
    for r in sorted(tuple(r) for r in rows):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("limit, keep", [(500, 10), (100, 3), (20_000, 10), (10, 1)])
def test_trim_equals_the_loop(talks, limit, keep):
    rows, df = talks
    want = {c: trimmed(r, limit, keep) for c, r in by_conv(rows).items()}
    assert by_conv(dialogs.trim(df, limit, keep).collect()) == want
    exact = dialogs.trim_exact(df, lambda ps: -(-sum(len(r) + len(t) + 32 for r, t in ps) // 4), limit, keep)
    assert by_conv(exact.collect()) == want


def test_token_totals(talks):
    rows, df = talks
    assert {r.conv_id: r.tokens for r in dialogs.token_totals(df).collect()} == {c: tokens(r) for c, r in by_conv(rows).items()}


def test_tokenizer_counts(talks):
    rows, df = talks
    got = {r.conv_id: r.tokens for r in dialogs.counted_tokens(df, token_counter(lambda: list)).collect()}
    assert got == {c: sum(len(json.dumps({"role": r[2], "content": r[3]}, separators=(",", ":"))) for r in rs) for c, rs in by_conv(rows).items()}


def test_transcript_segments_join_up(talks):
    rows, df = talks
    got = {}
    for r in dialogs.transcript(df, segment=16).orderBy("conv_id", "segment").collect():
        got.setdefault(r.conv_id, []).append(r.transcript)
    want = {c: "\n".join(f"{r[2].upper()}: {r[3][:300]}" for r in rs if r[3]) for c, rs in by_conv(rows).items()}
    assert {c: "\n".join(parts) for c, parts in got.items()} == {c: t for c, t in want.items() if t}


def test_summary_counts_empty_messages(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hello"), (1, 2, "assistant", ""), (1, 3, "user", "b"), (1, 4, "user", "c"),
            (2, 0, "system", "s"), (2, 1, "user", "short"),
            (3, 0, "user", "a"), (3, 1, "user", ""), (3, 2, "user", "b"), (3, 3, "user", "c")]
    got = by_conv(dialogs.summarize(spark.createDataFrame(rows, SCHEMA), dialogs.first_characters(20), 2).collect())
    assert got[1] == [rows[0], (1, 1, "system", "[Earlier conversation (2 messages): USER: hello]"), rows[3], rows[4]]
    assert got[2] == rows[5:7] and got[3] == rows[7:]  # nothing old, and nothing old worth telling


def test_fit_context_changes_long_conversations_only(talks):
    rows, df = talks
    got = by_conv(dialogs.fit_context(df, dialogs.first_characters(50), 500, 10).collect())
    for c, rs in by_conv(rows).items():
        if tokens(rs) <= 500:
            assert got[c] == rs
        else:
            assert got[c][-10:] == rs[-10:] and got[c][0] == rs[0]
    assert by_conv(dialogs.fit_context(df, None, 500, 10).collect())[2] == trimmed(by_conv(rows)[2], 500, 10)


def events(spark, *pairs):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(u, t0 + timedelta(seconds=s)) for u, s in pairs], "user_id int, ts timestamp_ntz")


def test_sessions_end_strictly_after_the_gap(spark):
    df = events(spark, (1, 0), (1, 3600), (1, 7200.5), (1, 7201), (2, 10_000), (2, 20_000))
    got = sorted((r.user_id, r.session_no, r.n_events) for r in dialogs.idle_sessions(df, "user_id", "ts").collect())
    assert got == [(1, 1, 2), (1, 2, 2), (2, 1, 1), (2, 2, 1)]


def test_sessions_equal_sorted_scan(spark):
    pairs = [(random.randint(1, 4), random.randint(0, 400_000)) for _ in range(400)]
    want = {}
    for u in range(1, 5):
        times, n, last = sorted(s for v, s in pairs if v == u), 0, None
        for s in times:
            n += last is None or s - last > 3600
            last = s
            want[(u, n)] = want.get((u, n), 0) + 1
    got = dialogs.idle_sessions(events(spark, *pairs), "user_id", "ts").collect()
    assert {(r.user_id, r.session_no): r.n_events for r in got} == want


def test_eviction(spark):
    df = events(spark, (1, 0), (2, 5000), (3, 6000), (4, 8600), (2, 5100))
    assert [r.user_id for r in dialogs.live_sessions(df, "user_id", "ts", 3600, 2).collect()] == [4, 3]
    assert [r.user_id for r in dialogs.live_sessions(df, "user_id", "ts", 3600, 9).collect()] == [4, 3, 2]


def test_cap_hits_and_first_seen(spark):
    df = spark.createDataFrame([(10, False), (10, True), (9, False), (11, False)], "rounds int, answered boolean")
    assert dialogs.cap_hits(df, F.col("rounds"), F.col("answered")).first()[0] == 2
    seen = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "b", 9), (2, None, 1)], "s int, bid string, turn int")
    got = dialogs.first_seen(seen, "s", "bid", "turn").orderBy("first_seen").collect()
    assert [(r.s, r.bid, r.first_seen) for r in got] == [(1, "b", 2), (1, "a", 3)]


def test_results_do_not_depend_on_length(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"message {t}") for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    lines = [f"{r[2].upper()}: {r[3]}" for r in rows]
    assert [tuple(r) for r in dialogs.transcript(df).collect()] == [(1, 700, "\n".join(lines))]
    got = by_conv(dialogs.summarize(df, dialogs.first_characters(200), 3).collect())[1]
    told = "\n".join(lines[1:-3])[:200]
    assert got == [rows[0], (1, 1, "system", f"[Earlier conversation (696 messages): {told}]"), *rows[-3:]]
    assert by_conv(dialogs.summarize(df, dialogs.first_characters(200), 0).collect())[1] == rows


def test_failed_summary_falls_back_to_trimming(spark):
    rows = [(1, t, "user", "x" * 100) for t in range(60)] + [(2, t, "user", "ok" * 50) for t in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    summary = lambda text: F.when(text.contains("ok"), F.lit("fine"))
    got = by_conv(dialogs.fit_context(df, summary, 500, 10).collect())
    assert got[1] == trimmed(rows[:60], 500, 10)
    assert len(got[2]) == 12 and got[2][1][3] == "[Earlier conversation (49 messages): fine]"


def test_summary_hook_is_asked_once(spark):
    """A model that would answer once and then fail: its first answer counts everywhere."""
    rows = [(c, t, "user", "x" * 100) for c in (1, 2) for t in range(60)]
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(text):
        calls.add(1)
        return "told"

    got = by_conv(dialogs.fit_context(spark.createDataFrame(rows, SCHEMA), model.asNondeterministic(), 500, 10).collect())
    assert calls.value == 2 and all(len(got[c]) == 12 and got[c][1][3].endswith("told]") for c in (1, 2))


def test_trim_ranks_without_texts(talks):
    _, df = talks
    def windows(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        return [w for b in below for w in windows(b)] + ([node.output().toString()] if node.nodeName().startswith("Window") else [])

    for out in (dialogs.trim(df, 500, 10), dialogs.trim_exact(df, lambda ps: 1, 500, 10, min_tokens=1)):
        found = windows(out._jdf.queryExecution().optimizedPlan())
        assert found and not any("text#" in columns for columns in found)


def test_tokenizer_bound_too_high_fails(spark):
    df = spark.createDataFrame([(1, t, "user", "") for t in range(200)], SCHEMA)
    with pytest.raises(Exception, match="min_tokens"):
        dialogs.trim_exact(df, lambda ps: len(ps) // 10, limit=60, min_keep=2, min_tokens=2).collect()


def test_null_role_counts_as_empty(spark):
    df = spark.createDataFrame([(1, t, None, "abc") for t in range(4)], SCHEMA)
    assert dialogs.trim(df, 100, 1).count() == 4
