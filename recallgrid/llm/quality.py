"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax, trained by numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import arrow_pass

#: Buckets for character n-grams, for words and word pairs, and marks of how often a word triple came before.
CHAR_BUCKETS, WORD_BUCKETS, MARKS = 1 << 14, 1 << 14, 2
BUCKETS = CHAR_BUCKETS + WORD_BUCKETS + MARKS

_MIX = np.uint32(0x9E3779B1)
_POWERS = np.array([pow(0x01000193, i, 2 ** 32) for i in range(64)], np.uint32)


def subwords(text: str | None) -> list[np.ndarray]:
    """Bucket numbers of a text's n-grams by family: character trigrams, words and word pairs, marks of word triples."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    empty = np.empty(0, np.int64)
    if not len(b):
        return [empty, empty, empty]
    wide = b.astype(np.uint32)
    chars = empty
    if len(b) >= 3:
        h = (wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * _MIX
        chars = (h >> np.uint32(18)).astype(np.int64)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[1], blank.view(np.int8), [1]])))
    starts, ends = edge[::2], edge[1::2]
    words = marks = empty
    if len(starts):
        place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))), axis=0) if starts[0] == 0 else (
            np.arange(len(b)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(b))))]))
        value = np.where(blank, np.uint32(0), (wide + np.uint32(1)) * _POWERS[place & 63])
        one = np.add.reduceat(value, starts, dtype=np.uint32) * _MIX
        pair = (one[:-1] * np.uint32(31) + one[1:]) * _MIX
        words = CHAR_BUCKETS + (np.concatenate([one, pair]) >> np.uint32(18)).astype(np.int64)
        if len(one) >= 3:
            triple = pair[:-1].astype(np.uint64) << np.uint64(32) | one[2:]
            new = len(np.unique(triple))
            marks = np.array([CHAR_BUCKETS + WORD_BUCKETS] * new + [CHAR_BUCKETS + WORD_BUCKETS + 1] * (len(triple) - new))
    return [chars, words, marks]


def average(text: str | None) -> tuple[list[int], list[float]]:
    """Sparse mean over n-grams, each family weighing one: bucket numbers and weights."""
    ids, weights = [], []
    for family in subwords(text):
        if len(family):
            found, counts = np.unique(family, return_counts=True)
            ids.append(found)
            weights.append(counts / len(family))
    if not ids:
        return [], []
    return np.concatenate(ids).tolist(), np.concatenate(weights).tolist()


@dataclass
class Model:
    """``gain``: log-odds that each bucket adds; a document's score is the logistic of its averaged gain plus ``bias``."""

    gain: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total = self.bias + sum(float(self.gain[f].mean()) for f in subwords(text) if len(f))
        return float(1 / (1 + np.exp(-np.clip(total, -700, 700))))


def fit(rows: list[tuple[list[int], list[float], int]], dim: int = 8, epochs: int = 6, rate: float = 0.05, seed: int = 7) -> Model:
    """Vectors and softmax weights by stochastic gradient descent over (buckets, weights, label) rows.

    Classes weigh the same in total. Without rows of both classes every score is the smoothed share of label 1.
    """
    labels = np.array([y for _, _, y in rows])
    ones = int(labels.sum()) if len(labels) else 0
    if not 0 < ones < len(labels):
        share = (ones + 1) / (len(labels) + 2)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, dim))
    output, offset = rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
    weight = np.where(labels == 1, len(labels) / (2 * ones), len(labels) / (2 * (len(labels) - ones)))
    data = [(np.array(i, np.int64), np.array(w)[:, None]) for i, w, _ in rows]
    # Steps shrink with each bucket's own past gradients, so rare n-grams learn as fast as common ones.
    seen, seen_out = np.full((BUCKETS, dim), 1e-8), np.full((dim + 1, 2), 1e-8)
    for _ in range(epochs):
        for r in rng.permutation(len(data)):
            ids, w = data[r]
            mean = (vectors[ids] * w).sum(axis=0)
            z = mean @ output + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[r]] -= 1
            p *= min(weight[r], 4.0)
            step = w * (output @ p)
            top = np.vstack([np.outer(mean, p), p])
            seen[ids] += step ** 2
            seen_out += top ** 2
            vectors[ids] -= rate * step / np.sqrt(seen[ids])
            moved = rate * top / np.sqrt(seen_out)
            output -= moved[:-1]
            offset -= moved[-1]
    gain = vectors @ (output[:, 1] - output[:, 0])
    return Model(gain, float(offset[1] - offset[0]))


def sample_rows(labels: DataFrame, column: str, most: int, most_zeros: int | None = None) -> DataFrame:
    """At most ``most`` rows of label 1 and ``most_zeros`` (default: as many) of label 0, first by hash of doc_id: doc_id, label."""
    kept = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(column).cast("int").alias("label"))
    each = [kept.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
            for v, n in ((0, most_zeros or most), (1, most))]
    return each[0].unionByName(each[1])


def _features(ids, texts, labels) -> Iterator[tuple]:
    for i, text, label in zip(ids, texts, labels):
        yield (i, *average(text), label)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = 1500) -> Model:
    """Fit on at most ``most`` labelled documents of each class (the bound of the sample), taken by hash of doc_id.

    Texts become averaged n-grams on the executors; a row's size is bounded by the number of buckets. Only ``doc_id`` and
    ``column`` of ``labels``, and ``doc_id`` and ``text`` of ``docs``, are read.
    """
    chosen = sample_rows(labels, column, most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = arrow_pass(rows, ["doc_id", "text", "label"], "doc_id long, ids array<int>, weights array<float>, label int", _features)
    return fit([(r.ids, r.weights, r.label) for r in sorted(got.collect(), key=lambda r: (r.doc_id, r.label))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document (null and empty texts too: the bias alone). One pass, no shuffle."""
    model = Model(model.gain.astype(np.float32), model.bias)

    def rows(ids, texts):
        for i, text in zip(ids, texts):
            yield i, model.score(text)

    return arrow_pass(docs, ["doc_id", "text"], "doc_id long, score double", rows)


def keep_scored(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``."""
    model = Model(model.gain.astype(np.float32), model.bias)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(t) >= least for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
