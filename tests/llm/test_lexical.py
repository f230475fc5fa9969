"""Ranked lexical search against a plain version, on odd rows and in many blocks."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.llm import lexical

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    found = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in found if c)
    n_terms = sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in wanted.items():
        scored = []
        for doc, uses in found:
            if not uses:
                continue
            m = 50 + 50 * sum(uses.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[w] + 1))) * (10 ** 9 * uses[w] // (1000 * uses[w] + 20 * m))
                        for w in words if w in uses)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def told(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes, step", [(4_000_000, 2_000_000), (600, 50)])
def test_search(frame, spark, monkeypatch, block_bytes, step):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block_bytes)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()[:12]
    docs += [(900001, None), (900002, ""), (900003, " .,- "), (900004, items[0][1]), (900004, items[0][1]), (None, items[0][1]), (900005, items[0][1].upper()),
             (900006, items[1][1].replace(" ", "\x00 _")), (900007, "word " * 30_000), (900008, "日本語 é x İ  y")]
    items += [(100, None), (101, ""), (102, "the the THE"), (103, "日本語 É x zz"), (103, "word"), (None, "one the"), (104, "nowhereatall")]
    clash = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("x"))
    assert told(lexical.ranked_search(frame(docs).repartition(4), clash, 7)) == brute(docs, items, 7)


def test_search_without_rows(spark, frame):
    items, docs = spark.createDataFrame([(1, "a b")], ITEMS), frame([(1, "a"), (2, "b b")])
    nothing = frame([])
    assert told(lexical.ranked_search(nothing, items)) == []
    assert told(lexical.ranked_search(docs, items.limit(0))) == []
    assert told(lexical.ranked_search(docs, spark.createDataFrame([(1, None)], ITEMS))) == []
    assert len(told(lexical.ranked_search(docs, items))) == 2


def test_terms_match_as_a_whole():
    block = lexical.Block([(1, "he her hers"), (2, "a")])
    n, uses = block.count("He he,HER hershey a-a aa")
    assert n == 7 and {block.terms[i].decode(): c for i, c in uses.items()} == {"he": 2, "her": 1, "a": 2}


def test_scores_are_exact_beyond_small_steps(monkeypatch):
    """Adding up in steps of any size, and in integers, gives the same."""
    items = [(i, f"w{i} w{i + 1} common") for i in range(20)]
    block = lexical.Block(items)
    texts = [(d, f"w{d % 21} w{d % 7} common " * (d % 5 + 1)) for d in range(60)]
    weights = lexical.term_weights(np.arange(len(block.terms)), 60)
    results = []
    for whole in (True, False):
        best = lexical.Best(len(block.items), 5)
        for start in range(0, 60, 60 if whole else 7):
            own = texts[start: start + (60 if whole else 7)]
            counts = [block.count(t) for _, t in own]
            lexical._score(
                block, weights, best, np.array([d for d, _ in own]), np.zeros(len(own), bool), list(range(len(own))),
                [np.fromiter(c, np.int64, len(c)) for _, c in counts], [np.fromiter(c.values(), np.int64, len(c)) for _, c in counts],
                [50 + n for n, _ in counts])
        results.append([r.tolist() for r in best.rows])
    assert results[0] == results[1]
