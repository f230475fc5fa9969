"""Toxicity: a lexicon learned from labels, matched with spelling errors, weighed by context.

The lexicon is a trie. A Levenshtein automaton of a word walks it and finds all terms within the allowed distance. Each
hit counts less inside quotation or after a reporting verb, and more when someone is addressed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import arrow_pass, write_out
from recallgrid.llm.quality import sample_rows

TERM = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
REPORTING = frozenset("said says wrote writes quoted quote quotes called term word slur reported dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your youre u ur du dich dir tu te toi vous usted ustedes".split())
OPEN_QUOTES, CLOSE_QUOTES = "\"“«„‹", "\"”»“›"

#: Terms shorter than this must match exactly; longer ones may be one edit away.
MISSPELT_FROM = 5
#: Words on each side that make up a hit's context.
WINDOW = 6
#: What a hit keeps of its weight when misspelt, quoted, or both.
MISSPELT, QUOTED = 0.9, 0.3


def build_trie(terms: dict[str, float]) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = term
    return root


def fuzzy_terms(word: str, trie: dict, most: int) -> dict[str, int]:
    """Terms within ``most`` edits of ``word``, with their distance.

    The word's Levenshtein automaton has states (letters read, edits made); it runs along the trie's edges, and a branch ends where
    it has no state left.
    """
    found: dict[str, int] = {}
    end = len(word)
    stack = [(trie, 0, 0)]
    while stack:
        node, at, edits = stack.pop()
        if "" in node and (total := edits + end - at) <= most:
            found[node[""]] = min(total, found.get(node[""], total))
        if at < end and (child := node.get(word[at])) is not None:
            stack.append((child, at + 1, edits))
        if edits < most:
            if at < end:
                stack.append((node, at + 1, edits + 1))
            for c, child in node.items():
                if c:
                    stack.append((child, at, edits + 1))
                    if at < end and c != word[at]:
                        stack.append((child, at + 1, edits + 1))
    return found


@dataclass
class Lexicon:
    """Terms with the share of their uses in toxic documents, the share of toxic rows, words that look like a term but are not, and
    how many uses of those each term has."""

    terms: dict[str, float]
    prior: float
    harmless: frozenset = frozenset()
    blurred: tuple = ()
    trie: dict = field(default_factory=dict)
    heads: frozenset = frozenset()
    tails: frozenset = frozenset()
    cuts: tuple = ()
    known: dict = field(default_factory=dict)
    clean_alike: dict = field(default_factory=dict)

    def __post_init__(self):
        self.clean_alike = dict(self.blurred)
        self.trie = build_trie(self.terms)
        long_terms = [t for t in self.terms if len(t) >= MISSPELT_FROM]
        # With one edit, a word still starts with a term's first half or ends with its second, and is as long, give or take one.
        self.heads = frozenset((t[: len(t) // 2], len(t) + d) for t in long_terms for d in (-1, 0, 1))
        self.tails = frozenset((t[len(t) // 2:], len(t) + d) for t in long_terms for d in (-1, 0, 1))
        self.cuts = tuple(sorted({len(h) for h, _ in self.heads | self.tails}))

    def match(self, word: str) -> float:
        """Weight of a word: its own as a term, or the best of the terms one edit away; 0 if none."""
        if word in self.terms:
            return self.terms[word]
        if word in self.harmless or not self._may_match(word):
            return 0.0
        near = [self.terms[t] * 2 / (2 + self.clean_alike.get(t, 0)) for t in fuzzy_terms(word, self.trie, 1) if len(t) >= MISSPELT_FROM]
        return MISSPELT * max(near, default=0.0)

    def _may_match(self, word: str) -> bool:
        size, heads, tails = len(word), self.heads, self.tails
        return any((word[:n], size) in heads or (word[-n:], size) in tails for n in self.cuts)

    def weigh(self, word: str) -> float:
        weight = self.known.get(word)
        if weight is None:
            if len(self.known) > 300_000:
                self.known.clear()
            weight = self.known[word] = self.match(word)
        return weight


def _quoted(text: str, start: int, end: int) -> bool:
    before = text[max(0, start - 80): start]
    after = text[end: end + 80]
    opened = max(before.rfind(q) for q in OPEN_QUOTES)
    closed = min((i for i in map(after.find, CLOSE_QUOTES) if i >= 0), default=-1)
    return opened >= 0 and closed >= 0 and "\n" not in before[opened:] and "\n" not in after[:closed] and (
        before[opened] != '"' or before.count('"') % 2 == 1)


def score_text(text: str | None, lexicon: Lexicon) -> float:
    """1 - the chance that no hit is abuse, in the context window where that is least; without hits, well below the prior.

    Quoted or reported hits close together are one quotation and count once, so that quoting alone stays below 0.3.
    """
    floor = min(lexicon.prior, 0.25) / 2
    if not text:
        return floor
    lower = text.lower()
    known, weigh = lexicon.known, lexicon.weigh
    hits = {w for w in set(TERM.findall(lower)) if (known[w] if w in known else weigh(w)) > 0}
    if not hits:
        return floor
    words = [(m.start(), m.end(), m[0]) for m in TERM.finditer(lower)]
    marked, told = [], -8 * WINDOW
    for i, (start, end, word) in enumerate(words):
        if word not in hits:
            continue
        weight = weigh(word)
        near = {w for _, _, w in words[max(0, i - WINDOW): i + WINDOW + 1]}
        if _quoted(lower, start, end) or not near.isdisjoint(REPORTING):
            weight *= QUOTED
            if i - told <= 4 * WINDOW:
                told = i
                continue
            told = i
        elif not near.isdisjoint(ADDRESS):
            weight = 1 - (1 - weight) * 0.7
        marked.append((i, weight))
    best, first, miss = 0.0, 0, 0.0
    for j, (i, weight) in enumerate(marked):
        miss += math.log(max(1e-12, 1 - min(weight, 0.999)))
        while marked[first][0] < i - 4 * WINDOW:
            miss -= math.log(max(1e-12, 1 - min(marked[first][1], 0.999)))
            first += 1
        best = max(best, 1 - math.exp(min(0.0, miss)))
    return max(floor, best)


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = 4000, least_share: float = 0.9,
          least_ratio: float = 22.0) -> Lexicon:
    """Terms of at least 4 letters that mark toxic documents, from at most ``most`` toxic and three times as many other labelled documents.

    A document uses a word once, with the first in order of the words before it; equal uses count once, so that neither repeats in a
    text nor copies of it vote again. A term is kept if toxic documents hold at least ``least_share`` of its uses in the
    sample, and its log-likelihood ratio against an equal spread is ``least_ratio`` or more, so that chance picks nothing. Words of other documents one edit away from a term are kept as harmless, and the more a term has
    of them, the less its misspellings count.
    Counting runs on the executors; only terms and harmless words reach the driver, all of them. They are words of the sample, so their number
    does not grow with the corpus.
    """
    chosen = sample_rows(labels, column, most, 3 * most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def words(texts, found):
        for text, label in zip(texts, found):
            said = TERM.findall((text or "").lower())
            first: dict[str, str] = {}
            for before, w in zip(["", *said], said):
                if len(w) >= 4 and before <= first.get(w, before):
                    first[w] = before
            for w, before in first.items():
                yield w, before, label

    totals = {r.label: r.n for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    prior = (bad + 1) / (bad + good + 2)
    if not bad:
        return Lexicon({}, prior)
    uses = arrow_pass(rows, ["text", "label"], "word string, before string, label int", words).distinct()
    counts = write_out(uses.groupBy("word").agg(F.sum("label").alias("b"), F.sum(1 - F.col("label")).alias("g")), "lexicon-uses")
    share = F.col("b") / (F.col("b") + F.col("g") + 0.5)
    both, expected = F.col("b") + F.col("g"), bad / (bad + good)
    ratio = 2 * (F.col("b") * F.log(F.col("b") / both / expected)
                 + F.when(F.col("g") > 0, F.col("g") * F.log(F.col("g") / both / max(1 - expected, 1e-9))).otherwise(0.0))
    top = (counts.filter("b > 0").withColumn("share", share).withColumn("ratio", ratio)
           .filter((F.col("share") >= least_share) & (F.col("ratio") >= least_ratio))
           .orderBy(F.desc("ratio"), "word").collect())
    terms = {r.word: float(r.share) for r in top}

    def alike(found, uses) -> Iterator[tuple]:
        own = _own(tuple(terms.items()), prior, frozenset(), ())
        for w, g in zip(found, uses):
            if w not in terms and own.match(w) > 0:
                for t in fuzzy_terms(w, own.trie, 1):
                    yield w, t, g

    near = write_out(arrow_pass(counts.filter("g > 0"), ["word", "g"], "word string, term string, g long", alike), "lexicon-alike")
    blurred = near.groupBy("term").agg(F.sum("g").alias("g")).collect()  # no more rows than terms
    harmless = near.select("word").distinct().collect()
    return Lexicon(terms, prior, frozenset(r.word for r in harmless), tuple(sorted((r.term, r.g) for r in blurred)))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score of every document; null and empty texts get the floor. One pass, no shuffle."""
    given = tuple(lexicon.terms.items()), lexicon.prior, lexicon.harmless, lexicon.blurred

    def rows(ids, texts) -> Iterator[tuple]:
        own = _own(*given)
        for i, text in zip(ids, texts):
            yield i, score_text(text, own)

    return arrow_pass(docs, ["doc_id", "text"], "doc_id long, score double", rows)


_cached: list = []


def _own(items: tuple, *rest) -> Lexicon:
    """The worker's lexicon, kept between batches with the words it has met."""
    if not _cached or _cached[0] != (items, *rest):
        _cached[:] = [(items, *rest), Lexicon(dict(items), *rest)]
    return _cached[1]
