"""Every link of the n-gram join, also inside groups, against brute force."""

import brute
from test_operators import LONG, NO_ROWS, near_texts, rows

from recallgrid.llm import ngram_join


def all_links(docs):
    """{(a, b)}, a < b, over documents; an id that repeats has the links of each of its sets."""
    sets = [(d, s) for d, t in docs if d is not None and (s := brute.shingle_set(t))]
    return {tuple(sorted((a, b))) for i, (a, s) in enumerate(sets) for b, o in sets[:i] if a != b
            and 100 * len(s & o) >= 75 * len(s | o)}


def check(frame, docs):
    want = all_links(docs)
    n_links = {d: 0 for d, _ in docs}
    for pair in want:
        for d in pair:
            n_links[d] += 1
    got = ngram_join.link_counts(frame(docs)).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.n_links for r in got} == n_links
    between, members = ngram_join.links(frame(docs))
    stands = {d: (rep, copies) for d, rep, copies in rows(members)}
    by_rep = {}
    for d, (rep, _) in stands.items():
        by_rep.setdefault(rep, []).append(d)
    assert all(copies == len(by_rep[rep]) for rep, copies in stands.values())
    told = [(x, y) for a, b in rows(between) for x in by_rep[a] for y in by_rep[b]]
    told += [(x, y) for own in by_rep.values() for x in own for y in own if x < y]
    assert sorted(tuple(sorted(p)) for p in told) == sorted(want)
    return want, got


def test_all_links(frame):
    made = [t for i, (n, size, edits) in enumerate([(60, 100, 9), (30, 12, 2), (15, 9, 2), (20, 40, 5), (6, 300, 16)]) for t in near_texts(i, n, size, edits)]
    docs = [(10_000 + i, t) for i, t in enumerate(made)] + [(30_000 + i, made[0]) for i in range(5)]
    docs += [(20_000, None), (20_001, ""), (20_002, "A b"), (20_003, "a B"), (20_004, LONG), (None, made[0]), (10_002, made[2])]
    want, got = check(frame, docs)
    components = {r.component_id for r in got if r.doc_id is not None}
    assert len(want) > 2 * (len(docs) - len(components))  # far more links than join the components


def test_links_over_blocks(frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_SETS", 7)
    texts = near_texts(11, 50, 60, 6)
    docs = list(enumerate(texts)) + [(100, texts[3]), (101, texts[3])]
    docs += [(5, texts[3]), (200, "one two three four five six"), (5, "one two three four five six"), (201, "one two three four five six")]
    check(frame, docs)


def test_links_without_rows(spark):
    docs = spark.createDataFrame([], NO_ROWS)
    assert rows(ngram_join.link_counts(docs)) == [] and [rows(x) for x in ngram_join.links(docs)] == [[], []]
