"""Ranked lexical search of many items over all documents, by scanning the documents with one automaton of all items' terms.

Texts are folded so that every separator is a blank, and each term stands in the automaton between two blanks, so that it only
matches as a whole. The scan counts each term's uses straight from the text; no index of the documents is made. A first scan
counts documents and terms, a second scores: what a term adds to a document goes to all items that hold the term.
"""

from __future__ import annotations

from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm.common import BATCH_BYTES, write_out

#: Bytes of item text whose terms go into one automaton; more items are taken in several blocks.
BLOCK_BYTES = 4_000_000
#: What one step of the scoring adds up at most: (document, term, item) triples.
STEP = 2_000_000

_LETTERS = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
#: For each byte of UTF-8 text: A-Z in lower case, other letters, digits and all beyond ASCII as they are, the rest a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTERS else 32 for b in range(256))

SCORE_ARROW = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
COUNT_ARROW = pa.schema([("term", pa.int64()), ("n", pa.int64())])

#: Rows of the first scan that hold no term: documents with a term, and all their terms.
DOCUMENTS, TERMS = -1, -2


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_FOLD)


class Block:
    """Some items: their terms as an automaton, and the items of each term."""

    def __init__(self, items: list[tuple[int | None, str]]):
        import ahocorasick

        by_item: dict[int | None, set[bytes]] = {}
        for item, text in items:
            by_item.setdefault(item, set()).update(folded(text).split())
        self.items = list(by_item)
        self.terms = sorted(set().union(*by_item.values()))
        at = {t: i for i, t in enumerate(self.terms)}
        term, item = [], []
        for i, words in enumerate(by_item.values()):
            term += [at[w] for w in words]
            item += [i] * len(words)
        order = np.argsort(np.array(term, np.int64), kind="stable")
        self.holders = np.array(item, np.int64)[order]
        self.held = np.bincount(np.array(term, np.int64), minlength=len(self.terms))
        self.first = np.cumsum(self.held) - self.held
        self.automaton = ahocorasick.Automaton()
        for t, i in at.items():
            self.automaton.add_word(f" {t.decode()} ", i)
        if self.terms:
            self.automaton.make_automaton()

    def count(self, text: str | None) -> tuple[int, dict[int, int]]:
        """Number of terms of a text, and the uses of those that items hold."""
        flat = folded(text)
        n = len(flat.split())
        if not n or not self.terms:
            return n, {}
        return n, Counter(map(itemgetter(1), self.automaton.iter(f" {flat.decode()} ")))


_block: list = []


def _own(items: tuple) -> Block:
    """The worker's block, kept between tasks."""
    if not _block or _block[0] != items:
        _block[:] = [items, Block(list(items))]
    return _block[1]


def _statistics(items: tuple):
    def run(batches):
        block = _own(items)
        df, total = np.zeros(len(block.terms), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, uses = block.count(text)
                if n:
                    total += (1, n)
                    df[list(uses)] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[DOCUMENTS, TERMS], held]), pa.int64()), pa.array(np.concatenate([total, df[held]]), pa.int64())],
            schema=COUNT_ARROW)

    return run


class Best:
    """The highest ``k`` documents of each item so far: parallel arrays in the order of item, falling score, rising doc_id, nulls last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, np.int64)
        self.rows = [np.empty(0, np.int64) for _ in range(3)] + [np.empty(0, bool)]

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score, doc, null = (np.concatenate(c) for c in zip(self.rows, (item, score, doc, null)))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, place, item = order[place < self.k], place[place < self.k], item[place < self.k]
        self.rows = [item, score[order], doc[order], null[order]]
        full = place == self.k - 1
        self.least[item[full]] = self.rows[1][full]


def _scores(items: tuple, weights: np.ndarray, documents: int, terms: int, k: int):
    def run(batches):
        block = _own(items)
        best = Best(len(block.items), k)
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy()
            rows, found, tf, m = [], [], [], []
            size = 0

            def flush():
                _score(block, weights, best, doc, null, rows, found, tf, m)
                for c in (rows, found, tf, m):
                    c.clear()

            for row, text in enumerate(batch.column(1).to_pylist()):
                n, uses = block.count(text)
                if not uses:
                    continue
                own = np.fromiter(uses, np.int64, len(uses))
                rows.append(row)
                found.append(own)
                tf.append(np.fromiter(uses.values(), np.int64, len(uses)))
                m.append(50 + 50 * n * documents // terms)
                size += int(block.held[own].sum()) + len(block.items)
                if size > STEP:
                    flush()
                    size = 0
            if rows:
                flush()
        item, score, doc, null = best.rows
        ids = pa.array(block.items, pa.int64()).take(pa.array(item))
        for i in range(0, len(item), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [ids[part], pa.array(doc[part], mask=null[part]), pa.array(score[part])], schema=SCORE_ARROW)

    return run


def _score(block: Block, weights, best: Best, doc, null, rows, found, tf, m) -> None:
    """Add up what each document's terms give to the items that hold them; hand on those that can be among the best."""
    lengths = [len(f) for f in found]
    at, term, uses = np.repeat(np.arange(len(rows)), lengths), np.concatenate(found), np.concatenate(tf)
    gain = weights[term] * (1_000_000_000 * uses // (1000 * uses + 20 * np.array(m, np.int64)[at]))
    held = block.held[term]
    inside = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
    item = block.holders[np.repeat(block.first[term], held) + inside]
    n = len(block.items)
    key, gain = np.repeat(at, held) * n + item, np.repeat(gain, held)
    # Doubles add up integers exactly below 2^53; gains are far below 2^36, so that takes an item of over 100 000 terms.
    if len(gain) and int(gain.max()) * max(lengths) < 1 << 53:
        total = np.bincount(key, weights=gain, minlength=len(rows) * n).astype(np.int64)
    else:
        total = np.zeros(len(rows) * n, np.int64)
        np.add.at(total, key, gain)
    total = total.reshape(len(rows), n)
    row, item = np.nonzero((total > 0) & (total >= best.least))
    if len(row):
        origin = np.array(rows)[row]
        best.add(item, total[row, item], doc[origin], null[origin])


def term_weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score. Scores are above 0; ties go to the smaller doc_id.

    ``docs``: doc_id, text; ``items``: item_id, text. Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case;
    an item counts each of its terms once. With N documents that have terms, L terms in all of them, n in one and a term in df of them
    tf times in this one: weight w = floor(1000 ln((2N+2) / (2df+1))), m = 50 + 50 n N div L, score = sum of
    w * (10^9 tf div (1000 tf + 20 m)).

    Null texts have no terms; documents without terms count for nothing and items without any get no rows. Rows that repeat an
    item_id are one item with the terms of all (nulls too); rows that repeat a doc_id are documents of their own, a null doc_id
    comes last among ties. Empty tables give no rows; other columns are ignored.

    Items are taken in blocks of bounded text, the only thing that tasks are sent. Documents are scanned twice a block and never
    shuffled: a task hands on a count for each term, then at most ``k`` rows for each item.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    docs = docs.select("doc_id", "text")
    own = write_out(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "search-items")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // BLOCK_BYTES))
    parts = None
    for number in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        block = tuple(sorted(((r.item_id, r.text) for r in rows), key=repr))
        terms = len(Block(list(block)).terms)
        counts = {r.term: r.n for r in docs.select("text").mapInArrow(_statistics(block), "term long, n long").groupBy("term").agg(
            F.sum("n").alias("n")).collect()}
        df = np.array([counts.get(t, 0) for t in range(terms)], np.int64)
        n = counts.get(DOCUMENTS, 0)
        found = docs.mapInArrow(
            _scores(block, term_weights(df, n), n, counts.get(TERMS, 0), k), "item_id long, doc_id long, score long")
        parts = found if parts is None else parts.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return (parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
