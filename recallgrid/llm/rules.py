"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs the votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import WORD, arrow_pass, write_out

SYMBOLS = "#*$%&|<>"
PLAIN_MARKS = b".,;:'\"-()?"

#: Words of a window in which shares are taken, so that they do not change with the length of a text; words of a long passage.
WINDOW, PASSAGE = 500, 16

BAD, NONE, GOOD = 0, 1, 2

#: (name, votes bad when, votes good when), over the measures of one text; no vote where neither holds.
RULES = (
    ("symbols", lambda m: m["symbols"] > 0.2, lambda m: False),
    ("other_marks", lambda m: m["marks"] > 0.4, lambda m: False),
    ("capitals", lambda m: m["upper"] > 0.5, lambda m: False),
    ("repeats", lambda m: m["repeat"] > 0.4, lambda m: False),
    ("few_words", lambda m: m["distinct"] < 0.25, lambda m: False),
    ("dup_lines", lambda m: m["dup_lines"] > 0.5, lambda m: False),
    ("word_length", lambda m: not 2 <= m["word_chars"] <= 20, lambda m: False),
    ("prose", lambda m: False, lambda m: m["symbols"] < 0.05 and m["marks"] < 0.2 and m["upper"] < 0.3 and m["repeat"] < 0.2),
    ("varied", lambda m: False, lambda m: m["distinct"] > 0.4 and m["marks"] < 0.2 and m["dup_lines"] < 0.4),
)

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string"


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Every item in rows of ``size``, one after the other; the last row ends with the last item. At least ``size`` items."""
    whole = codes[: len(codes) // size * size].reshape(-1, size)
    return np.concatenate([whole, codes[None, -size:]]) if len(codes) % size else whole


def covered(twice: np.ndarray, words: int) -> np.ndarray:
    """For rows of flags of n-grams of so many words, the share of words in a flagged one."""
    hit = np.zeros((len(twice), twice.shape[1] + words - 1), bool)
    for shift in range(words):
        hit[:, shift: shift + twice.shape[1]] |= twice
    return hit.mean(axis=1)


def shares(order: np.ndarray) -> tuple[float, float]:
    """Shares of distinct and of repeated words of a text longer than a window, given as codes of its words.

    Both are means over all windows. Windows do not see what repeats at a distance: words in passages that occur again
    anywhere in the text count too, and as chance does not repeat whole passages, they do not grow with the length.
    """
    rows = np.sort(windows(order, WINDOW), axis=1)
    distinct = float((1 + (rows[:, 1:] != rows[:, :-1]).sum(axis=1)).mean() / WINDOW)
    many = int(order.max()) + 1
    pairs = np.unique(order[:-1] * many + order[1:], return_inverse=True)[1]
    threes = np.unique(pairs[:-1] * many + order[2:], return_inverse=True)[1]
    starts = windows(np.arange(len(order)), WINDOW)[:, : WINDOW - 2]
    rows = threes[starts]
    by = np.argsort(rows, axis=1)
    rows = np.take_along_axis(rows, by, axis=1)
    same = rows[:, 1:] == rows[:, :-1]
    edge = np.zeros((len(rows), 1), bool)
    twice = np.empty(rows.shape, bool)
    np.put_along_axis(twice, by, np.hstack([same, edge]) | np.hstack([edge, same]), axis=1)
    near = float(covered(twice, 3).mean())
    passages, words = order, 1
    while words < PASSAGE:
        passages = np.unique(passages[:-words] * (int(passages.max()) + 1) + passages[words:], return_inverse=True)[1]
        words *= 2
    again = np.bincount(passages)[passages] > 1
    return distinct, max(near, float(covered(again[None], PASSAGE)[0]))


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, votes of one text."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    dup, seen, lines = 0, set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
                lines += 1
            elif WORD.search(line):
                seen.add(line)
                lines += 1
    codes: dict[str, int] = {}
    order = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    repeat = 0
    if n >= 4 and len(codes) <= n - 1:
        _, pairs = np.unique(order[:-1] * len(codes) + order[1:], return_inverse=True)
        _, which, counts = np.unique(pairs[:-1] * len(codes) + order[2:], return_inverse=True, return_counts=True)
        twice = counts[which] > 1
        hit = np.zeros(n, bool)
        for shift in range(3):
            hit[shift: n - 2 + shift] |= twice
        repeat = int(hit.sum())
    distinct, repeated = shares(order) if n > WINDOW else (len(codes) / max(n, 1), repeat / max(n, 1))
    by_byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=128)
    upper, lower = int(by_byte[65:91].sum()), int(by_byte[97:123].sum())
    marks = int(by_byte[33:48].sum() + by_byte[58:65].sum() + by_byte[91:97].sum() + by_byte[123:127].sum())
    marks -= int(by_byte[list(PLAIN_MARKS)].sum())
    m = {"symbols": symbols / max(n, 1), "marks": marks / max(n, 1), "upper": upper / max(upper + lower, 1),
         "repeat": repeated, "distinct": distinct, "dup_lines": dup / max(lines, 1),
         "word_chars": chars / max(n, 1)}
    votes = "".join(str(BAD if bad(m) else GOOD if good(m) else NONE) for _, bad, good in RULES)
    return n, chars, symbols, dup, repeat, votes


def fit(patterns: dict[str, int], start_bad: float = 0.15, rounds: int = 200) -> dict[str, float]:
    """Probability of good quality for each pattern of votes, from the counts of patterns alone (no labels).

    Every rule has, for good and for bad documents, a rate of voting and of abstaining. The rates start from rules that vote
    wrongly one time in fifty, and a small prior of that kind (one part in a thousand of all rows) keeps the two classes from trading places.
    """
    keys = sorted(patterns)
    if not keys:
        return {}
    votes = np.array([[int(c) for c in k] for k in keys])
    weight = np.array([patterns[k] for k in keys], float)
    one_hot = np.stack([votes == v for v in (BAD, NONE, GOOD)], axis=2).astype(float)
    prior = np.array([[[0.30, 0.68, 0.02]], [[0.02, 0.48, 0.50]]])  # bad, good documents x votes
    rates = np.repeat(prior, len(RULES), axis=1)
    strength = 1 + weight.sum() / 1000
    share = start_bad
    good = None
    for _ in range(rounds):
        log = np.einsum("prv,crv->pc", one_hot, np.log(rates)) + np.log([share, 1 - share])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        if good is not None and np.abs(new - good).max() < 1e-9:
            break
        good = new
        by_class = np.stack([1 - good, good]) * weight
        counts = np.einsum("cp,prv->crv", by_class, one_hot) + strength * prior
        rates = counts / counts.sum(axis=2, keepdims=True)
        share = min(max((by_class[0].sum() + strength * start_bad) / (weight.sum() + strength), 1e-6), 0.999)
    return {k: float(g) for k, g in zip(keys, good)}


def _rows(*columns) -> Iterator[tuple]:
    *keep, texts = columns
    for *own, text in zip(*keep, texts):
        yield (*own, *measure(text))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures and votes of each text; see ``COLUMNS``."""
    return arrow_pass(docs, ["doc_id", "text"], "doc_id long, " + COLUMNS, _rows)


def posteriors(measured: DataFrame) -> dict[str, float]:
    """Fit over all rows. Only the counts of vote patterns reach the driver: at most 2 ** len(RULES)."""
    return fit({r.votes: r.n for r in measured.groupBy("votes").agg(F.count("*").alias("n")).collect()})


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Each document's measures, p_good, base_failed and kept (p_good >= ``least`` and not base_failed).

    Null texts count as empty, so they fail the base rules; null doc_ids and repeated rows are judged like any row. No rows give
    no rows; other columns are ignored.
    """
    measured = write_out(measures(docs), "rule-measures")
    good = posteriors(measured)
    p_good = docs.sparkSession.createDataFrame(list(good.items()), "p_votes string, p_good double")
    return (measured.join(F.broadcast(p_good), F.col("votes") == F.col("p_votes")).drop("p_votes")
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least)))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Texts are measured twice rather than shuffled: once to fit, once to filter.
    """
    good = posteriors(measures(docs))
    passing = {k for k, g in good.items() if g >= least}

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            mask = []
            for text in texts:
                n, _, _, _, repeat, votes = measure(text)
                mask.append(n >= 50 and 100 * repeat <= 50 * n and votes in passing)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
