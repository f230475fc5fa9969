"""Each operator against its plain version, on real rows and on the odd cases: nulls, empty and long texts, ties, repeats, no rows."""

import math
import random
import struct
import zlib

import brute
import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from recallgrid.llm import bpe, chat, ngram_join, packing, pii, quality, rules, sharding, topk, toxicity
from recallgrid.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
ODD = [(900001, None), (900002, ""), (900003, " \n\t "), (900004, "one"), (900004, "one"), (900005, "one"), (None, "some text without an id, and an a.b@c.de"),
       (900006, LONG), (900007, "x" * 70_000), (900008, "a\x1cb İstanbul ΣΣ 日本語 <|endoftext|> it's"), (900009, "\\### Assistant: </turn> ok")]
NO_ROWS = "doc_id long, text string"


@pytest.fixture(scope="module")
def real():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def rows(df):
    return [tuple(r) for r in df.collect()]


def near_texts(seed, n, size, edits):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(10 ** 6))
        out.append(" ".join(w))
    return out


def test_ngram_join(frame, real):
    made = [t for i, (n, size, edits) in enumerate([(40, 100, 9), (15, 12, 2), (15, 9, 2), (20, 40, 5), (6, 300, 16)]) for t in near_texts(i, n, size, edits)]
    docs = real[:120] + [(10_000 + i, t) for i, t in enumerate(made)] + [(20_000, None), (20_001, ""), (20_002, "A b"), (20_003, "a B"), (20_004, LONG)]
    want = brute.near_duplicates(docs)
    got = rows(ngram_join.near_duplicates(frame(docs + [docs[0], (None, "a b")])))
    assert len(got) == len(docs) + 2
    assert {d: (n, c) for d, n, c in got if d is not None} == want
    assert len({c for _, c in want.values()}) < len(docs) - 30


def test_ngram_join_without_rows(spark):
    assert rows(ngram_join.near_duplicates(spark.createDataFrame([], NO_ROWS))) == []


def test_segments_reach_every_partner():
    rng = random.Random(3)
    for n in [*range(1, 40), 80, 200, 700]:
        tokens = sorted({rng.randrange(1 << 63) for _ in range(n)})
        others = set(tokens)
        for _ in range(ngram_join.most_apart(n) // 2):
            others.remove(rng.choice(sorted(others)))
            others.add(rng.randrange(1 << 63))
        both = len(others & set(tokens))
        if 100 * both < 75 * (2 * n - both):
            continue
        import numpy as np
        a, b = (ngram_join.set_signatures(np.array(sorted(s), np.uint64))[0] for s in (tokens, others))
        key = lambda x: {(int(s) >> 2) for s in x}
        assert key(a) & key(b), n


def events(spark, log):
    return spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string, turn int")


def read_back(df):
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss) for r in df.select(
        "conv_id", chat.parse(df.formatted).alias("turns"), chat.masked_text(df.formatted, df.loss_spans).alias("loss")).collect()}


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [(1, 1, "m1", "delta", "user", "Hel", 0), (1, 2, "m1", "delta", None, "lo", 0), (1, 3, "m2", "delta", "assistant", "Wro", 0),
           (1, 4, "m2", "regenerate", None, "Ri", 0), (1, 6, "m2", "delta", None, "ght", 0), (1, 5, "m1", "edit", None, "Hi ", 0),
           (1, 7, "m1", "delta", None, "there", 0), (2, 1, None, "message", None, None, 0), (2, 1, None, "message", "a: b", "##### </turn>\\</turn>", 0)]
    got = read_back(chat.format_chats(events(spark, log)))
    assert got[1] == ([("user", "Hi there"), ("assistant", "Right")], "Right")
    assert got[2] == ([("", ""), ("a: b", "##### </turn>\\</turn>")], "")


def test_chat_is_reversible(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["#", "\\", "</turn>", "###", "\n", ": ", "x", "é", "$1", "<", "/turn>"]) for _ in range(rng.randrange(12))) for _ in range(120)]
    log = [(i % 7, i, None, "message", "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(texts)]
    got = read_back(chat.format_chats(events(spark, log)))
    for c in range(7):
        mine = [("assistant" if i % 2 else "user", t) for i, t in enumerate(texts) if i % 7 == c]
        assert got[c] == (mine, "".join(t for r, t in mine if r == "assistant"))
    assert read_back(chat.format_chats(events(spark, []))) == {}


def test_chat_query(spark):
    told = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet' ORDER BY 1, 2").fetchall()
    got = {r.conv_id: r for r in QUERIES["op2_chat_format"](spark, SF).collect()}
    assert got[-7].n_turns == 2 and got[-7].loss_sha256 == brute.sha("\\### Assistant: </turn> ok")
    for c in {r[0] for r in told}:
        mine = [(r, t or "") for k, _, r, t in told if k == c]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert tuple(got[c])[1:5] == (len(mine), brute.sha("".join(f"{r}\n{t}\n" for r, t in mine)), len(loss), brute.sha(loss))


def test_bpe_equals_the_tokenizer(frame, real):
    path = tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = real[:100] + ODD
    want = sorted((d is None, d or 0, len(e.ids), brute.sha(",".join(map(str, e.ids))), brute.sha(tok.decode(e.ids, skip_special_tokens=False)))
                  for (d, _), e in zip(docs, tok.encode_batch([t or "" for _, t in docs], add_special_tokens=False)))
    assert sorted((d is None, d or 0, *r) for d, *r in rows(bpe.digest_documents(frame(docs), path))) == want


@pytest.mark.parametrize("seed", range(6))
def test_tree_concatenation(seed):
    path, rng = tokenizer("byte_bpe_50k.json"), random.Random(seed)
    word = "".join(rng.choice(["ab", "the", "ing", "é", "tion", "z", "aaaa"]) for _ in range(1500))
    tok = Tokenizer.from_file(path)
    ids = tok.encode(word, add_special_tokens=False).ids
    assert bpe.encode_bytes([word], path) == [ids]
    assert bpe.decode_bytes(ids, path) == word


def test_pii(frame, real):
    odd = ["a@b.c.d@e.f", "@@", "x@y", "1.2.3.4.5.6.7.8", "999.1.1.1 300.1.1.1", "4111 1111 1111 1111-1", "+1 (722) 555-8977+44 20 7946 0958", "+1",
           "4111111111111111", "%@a.b", "0001.02.3.4", "1 2 3", "é@x.yz +123456789(", "see https://a.b/c?d=e, (http://x.y)", "IBAN: DE89370400440532013000"]
    docs = real + [(1000 + i, t) for i, t in enumerate(odd)] + ODD
    got = rows(pii.personal_data(frame(docs)))
    assert len(got) == len(docs)
    by_doc = {d: r for d, *r in got}
    for d, t in docs:
        want = brute.base_spans(t)
        assert by_doc[d][4] == ",".join(f"{k}:{a}:{b}" for k, a, b in want), t
        assert by_doc[d][:4] == [sum(k == q for k, _, _ in want) for q in pii.BASE]
    assert "url:" in by_doc[1013][5] and "account:6:28" in by_doc[1014][5]
    assert pii.masked("mail a@b.cd now") == "mail [EMAIL] now" and pii.masked(None) is None


def test_rules(frame, real):
    docs = real + ODD
    got = {}
    for r in rules.judge(frame(docs)).collect():
        got[r.doc_id] = r
    for d, t in docs:
        m = brute.measures(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words, got[d].base_failed) == (*m, failed)
        assert not (failed and got[d].kept)
    quality_of = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    sure = [d for d in quality_of if not got[d].base_failed]
    assert all(got[d].kept == bool(quality_of[d]) for d in sure)
    kept = rules.keep_good(frame(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in got.items() if d is not None and r.kept)
    assert kept.columns == frame(docs).columns


def test_rules_without_rows(spark):
    assert rows(rules.judge(spark.createDataFrame([], NO_ROWS))) == []


def held_out(spark, name, column, mod, left):
    folder = "/root/testdata/sf0.1"
    truth = dict(duckdb.sql(f"SELECT doc_id, {column} FROM '{folder}/labels.parquet'").fetchall())
    got = {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(d).encode()) % mod == left) for d, r in got.items())
    pairs = [(truth[d], r.predicted) for d, r in got.items() if r.held_out and d in truth]
    return pairs


def test_quality_classifier(spark, frame):
    pairs = held_out(spark, "op6_quality_classifier", "quality", 5, 0)
    assert sum(a == b for a, b in pairs) >= 0.98 * len(pairs)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r[1] == 0.5 for r in rows(quality.score(frame(ODD), quality.train(frame(ODD), labels))))


def test_toxicity(spark, frame):
    pairs = held_out(spark, "op7_toxicity", "toxic", 4, 2)
    assert sum(b for a, b in pairs if not a) <= 0.02 * sum(not a for a, _ in pairs)
    assert sum(b for a, b in pairs if a) >= 0.85 * sum(a for a, _ in pairs)
    lexicon = toxicity.Lexicon({"worthless": 0.99}, 0.1)
    plain, wrong, quoted = (toxicity.score_text(t, lexicon) for t in ("you are worthless", "you are wothless", 'they wrote "worthless" in a letter'))
    assert plain > wrong > 0.5 > quoted
    empty = toxicity.learn(frame(ODD), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {0 <= r[1] < 0.3 for r in rows(toxicity.score(frame(ODD), empty))} == {True}


def test_levenshtein_automaton():
    terms = {"stupid": 1.0, "stop": 1.0, "loser": 1.0}
    trie = toxicity.build_trie(terms)
    assert toxicity.fuzzy_terms("stupld", trie, 1) == {"stupid": 1}
    assert toxicity.fuzzy_terms("stupiid", trie, 1) == {"stupid": 1}
    assert toxicity.fuzzy_terms("tupid", trie, 1) == {"stupid": 1}
    assert toxicity.fuzzy_terms("closers", trie, 1) == {}
    assert toxicity.fuzzy_terms("closers", trie, 2) == {"loser": 2}


def check_packing(docs, got, capacity, path):
    tok = Tokenizer.from_file(path)
    want, total = [], 0
    for (d, t), e in zip(docs, tok.encode_batch([t or "" for _, t in docs], add_special_tokens=False)):
        ids = e.ids + [1]
        total += len(ids)
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s: s + capacity]
            want.append((d, k, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((r[:5] for r in got), key=key) == sorted(want, key=key)
    seats = {}
    for r in got:
        seats.setdefault(r[5], []).append((r[6], r[3]))
    for taken in seats.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seats), math.ceil(total / capacity)


def test_packing(frame, real):
    path = tokenizer("word_bpe_49k.json")
    docs = real + [r for r in ODD if r[1] != LONG] + [(100 + i, "a b c") for i in range(700)]
    for capacity in (64, 4096):
        used, least = check_packing(docs, rows(packing.pack(frame(docs), path, capacity)), capacity, path)
        assert used <= least + max(1, least // 50)


def test_packing_without_rows(spark):
    assert rows(packing.pack(spark.createDataFrame([], NO_ROWS), tokenizer("word_bpe_49k.json"))) == []


def test_plan_over_counts_is_best_fit():
    rng = random.Random(9)
    counts = {n: rng.randrange(1, 60) for n in rng.sample(range(1, 101), 40)}
    runs, used = packing.plan(counts, 100)
    room = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = [i for i, r in enumerate(room) if r >= n]
            at = min(fit, key=lambda i: room[i]) if fit else len(room)
            if not fit:
                room.append(100)
            room[at] -= n
    assert used == len(room)
    assert {n: sum(r[2] for r in runs if r[0] == n) for n in counts} == counts


def test_topk(spark):
    rng = random.Random(2)
    vectors = {i: [rng.randrange(-9, 10) for _ in range(8)] for i in range(300)}
    vectors[40], vectors[41] = vectors[20], vectors[20]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "id long, v array<long>, rank string").repartition(5)
    for block in (4096, 8):
        assert sorted(rows(topk.top_inner_products(df.filter("id % 20 = 0"), df, 20, block))) == brute.top(vectors)
    few = df.filter("id < 5")
    assert len(rows(topk.top_inner_products(few, few, 20))) == 20
    big = spark.createDataFrame([(i, [10 ** 9 + i, -1]) for i in range(4)], "id long, v array<long>")
    assert sorted(rows(topk.top_inner_products(big, big, 1))) == brute.top({i: [10 ** 9 + i, -1] for i in range(4)}, 1, 1)
    assert rows(topk.top_inner_products(df.limit(0), df.limit(0))) == []


def test_vectors_left_out(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [-0.51, 0.5])], "vec_id long, embedding array<float>")
    assert rows(topk.integer_vectors(df)) == [(5, [-33, 32])]


def test_sharding(frame, real):
    docs = real + ODD + [(500 + i, "the same text in a hot group") for i in range(300)]
    got = rows(sharding.shard_documents(frame(docs)))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((r[:3] for r in got), key=key) == sorted(
        ((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs), key=key)
    slots = {}
    for r in got:
        assert r[3] == "bytes" and 0 <= r[4] < 16 and r[6] is None
        slots.setdefault(r[4], []).append(r[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r[4] for r in got if r[0] is not None and 500 <= r[0] < 800}) == 1
    assert rows(sharding.shard_documents(frame([]))) == []


def test_best_fit_decreasing():
    items = [(7, "a"), (6, "b"), (4, "c"), (3, "d"), (2, "e"), (2, "f")]
    assert sharding.best_fit_decreasing(items, 10) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 2, "f": 2}
    assert sharding.best_fit_decreasing(items, 10, 2) is None
    placed = sharding.smallest_capacity(items, 3)
    assert max(sum(s for s, k in items if placed[k] == n) for n in range(3)) == 9


def test_chat_work_grows_with_the_turns(spark):
    """50 000 turns in one conversation; twice the turns take at most some 2.3 times as long."""
    import hashlib
    import time

    from pyspark.sql import functions as F

    def run(n):
        turn = F.col("id").cast("string")
        log = spark.range(n).select(
            F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("message_id"),
            F.lit("message").alias("kind"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
            F.concat(F.lit("## </turn>\\ "), F.repeat(F.lit("xy "), 60), turn).alias("text"))
        start = time.perf_counter()
        done = chat.format_chats(log)
        r = done.withColumn("turns", chat.parse(F.col("formatted"))).select(
            F.size("turns").alias("n"), F.sha2(chat.masked_text(F.col("formatted"), F.col("loss_spans")).cast("binary"), 256).alias("loss"),
            F.get("turns", F.lit(n - 1)).alias("last")).first()
        took = time.perf_counter() - start
        want = "".join("## </turn>\\ " + "xy " * 60 + str(i) for i in range(1, n, 2))
        assert (r.n, r.loss, r.last.text) == (n, hashlib.sha256(want.encode()).hexdigest(), "## </turn>\\ " + "xy " * 60 + str(n - 1))
        return took

    run(25_000)
    assert run(50_000) < 2.3 * max(run(25_000), 0.5) + 1


def test_loss_spans_are_offsets_into_the_text(spark):
    log = [(1, i, None, "message", "assistant" if i % 3 else "user", f"😀 turn {i} \\ ## </turn>", 0) for i in range(30)]
    r = chat.format_chats(events(spark, log)).first()
    cut = [r.formatted[s.start: s.start + s.length] for s in r.loss_spans]
    assert [c.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") for c in cut] == [t for _, _, _, _, role, t, _ in log if role == "assistant"]


def test_quotation_alone_is_not_abuse():
    lexicon = toxicity.Lexicon({"hateword": 0.99, "otherword": 0.95}, 0.1)
    for text in ('a "hateword" here', "they wrote hateword once", 'she said "hateword otherword hateword" and left'):
        assert toxicity.score_text(text, lexicon) < 0.3, text
    for text in ("you hateword", "this hateword again", 'he said "fine" and then went on for a very long while before the hateword'):
        assert toxicity.score_text(text, lexicon) >= 0.3, text


@pytest.mark.parametrize("run", [
    lambda d: bpe.digest_documents(d, tokenizer("byte_bpe_50k.json")), pii.personal_data,
    lambda d: quality.score(d, quality.Model(np.zeros(quality.BUCKETS), 0.0)),
    lambda d: toxicity.score(d, toxicity.Lexicon({"hateword": 0.9}, 0.1)), rules.keep_good, pii.mask],
    ids=["bpe", "pii", "quality", "toxicity", "rules", "mask"])
def test_no_rows_give_no_rows(spark, run):
    assert rows(run(spark.createDataFrame([], NO_ROWS))) == []
