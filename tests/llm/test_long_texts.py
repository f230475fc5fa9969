"""Votes of the quality rules do not change with the length of a text."""

import random

import brute
import duckdb
import numpy as np
from test_operators import SF

from recallgrid.llm import rules


def prose(n, seed, vocabulary=20_000):
    """Words as in prose: a few are frequent, most are rare, a stop ends each sentence."""
    rng = np.random.default_rng(seed)
    rank = np.minimum((vocabulary ** rng.random(n)).astype(int), vocabulary - 1)
    letters = np.array(["".join(random.Random(i).choices("aeioulmnrst", k=3 + i % 7)) for i in range(vocabulary)])
    return " ".join(w + "." if i % 12 == 11 else w for i, w in enumerate(letters[rank]))


def test_long_clean_texts_are_kept(frame):
    real = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    lengths = {-1 - i: n for i, n in enumerate([300, 5_000, 50_000, 60_000, 120_000])}
    long = [(d, prose(n, d + 9)) for d, n in lengths.items()]
    got = {r.doc_id: r for r in rules.judge(frame(real + long)).collect()}
    for d, text in long:
        assert len(set(text.split())) < 0.25 * got[d].n_words or lengths[d] < 50_000
        assert tuple(got[d])[1:6] == brute.measures(text)
        assert got[d].kept, (lengths[d], got[d])
    assert {r.doc_id for r in rules.keep_good(frame(real + long)).collect()} >= set(lengths)


def test_votes_follow_every_part_of_the_text():
    name = [r[0] for r in rules.RULES]
    votes = lambda text: dict(zip(name, rules.measure(text)[5]))
    clean, poor = prose(20_000, 1), "buy this now and that again then " * 6_000
    assert votes(clean)["varied"] == votes(clean)["prose"] == str(rules.GOOD)
    assert votes(poor)["few_words"] == votes(poor)["repeats"] == str(rules.BAD)
    assert votes(clean + " " + poor)["few_words"] == votes(poor + clean)["few_words"] == str(rules.BAD)
    assert votes(" ".join([prose(5_000, 2)] * 4))["repeats"] == str(rules.BAD)  # repeats beyond any window


def test_windows_hold_every_word():
    for n in (500, 501, 999, 1000, 1250):
        rows = rules.windows(np.arange(n), 500)
        assert rows.shape[1] == 500 and set(rows.ravel()) == set(range(n))
