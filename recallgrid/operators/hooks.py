"""Model hooks. Each turns a plain Python function over a batch into a Column function, and has a default.

Models are loaded once per Python worker: pass a ``load`` function that returns the model call. It runs on the
executor, in an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from recallgrid.functions.vectors import WORD_BREAK, word_overlap


class HookError(RuntimeError):
    """A model gave no usable answer for an input."""


def embed_batch(call: Callable[[list[str]], list], texts: list[str]) -> list:
    """Vectors of a batch in order; one text at a time when the batch call fails or comes back short."""
    try:
        vectors = call(texts)
        if vectors is not None and len(vectors) == len(texts):
            return list(vectors)
    except Exception:  # noqa: BLE001 - any model failure leads to the single-text path
        pass
    out = []
    for text in texts:
        try:
            vector = call([text])
        except Exception as e:  # noqa: BLE001
            raise HookError(f"embedding failed for {text[:60]!r}") from e
        if vector is None or len(vector) != 1:
            raise HookError(f"embedding failed for {text[:60]!r}")
        out.append(vector[0])
    return out


def embedder(load: Callable[[], Callable[[list[str]], list]], batch: int = 64) -> Callable[[Column], Column]:
    """Text -> vector through a batch model."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = load()
        for texts in parts:
            rows = texts.tolist()
            done = [embed_batch(call, rows[i : i + batch]) for i in range(0, len(rows), batch)]
            yield pd.Series([np.asarray(v, dtype="float64") for vs in done for v in vs], dtype=object)

    return run


#: Bytes of text whose words are held at once, besides those of one text.
_SLICE_BYTES = 2_097_152


def slices(texts: pa.Array, most: int = _SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts in runs, each of less than ``most`` bytes besides its first text; one empty run of none."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="int64")
    ends = [*(np.flatnonzero(np.diff(size // most)) + 1), len(texts)]
    for start, end in zip([0, *ends], ends):
        yield texts.slice(start, end - start)


def hash_embedding(dim: int = 64) -> Callable[[Column], Column]:
    """Default embedder: signed word counts hashed into ``dim`` slots (up to 256) by MD5; no words, zero vector.

    Works on slices of Arrow batches: words are split, lower-cased and encoded in bulk, and each distinct word of a slice is
    hashed once. The words of a slice take some 20 times its bytes, so slices and not batches are bounded. Unnesting words into
    Spark rows would shuffle them.
    """

    def embed(texts: pa.Array) -> pa.Array:
        lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), WORD_BREAK)
        coded = pc.list_flatten(lists).dictionary_encode()
        hashes = [hashlib.md5(w.encode()).hexdigest() if w else "" for w in coded.dictionary.to_pylist()]
        slot = np.array([int(h[:2], 16) % dim if h else 0 for h in hashes], dtype="int64")
        sign = np.array([(1.0 if h[2] < "8" else -1.0) if h else 0.0 for h in hashes])
        word = coded.indices.to_numpy()
        row = pc.list_parent_indices(lists).to_numpy()
        flat = np.bincount(row * dim + slot[word], weights=sign[word], minlength=len(texts) * dim) if len(word) else \
            np.zeros(len(texts) * dim)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype="int32") * dim, flat)

    @F.arrow_udf("array<double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.concat_arrays([embed(s) for s in slices(texts)])

    return run


def generator(load: Callable[[], Callable[[list[str]], list]]) -> Callable[[Column], Column]:
    """Prompt -> text through a batch model; a failed or missing answer is null, so callers can fall back."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = load()
        for prompts in parts:
            rows = prompts.tolist()
            try:
                out = list(call(rows))
            except Exception:  # noqa: BLE001
                out = [None] * len(rows)
            yield pd.Series(out if len(out) == len(rows) else [None] * len(rows), dtype=object)

    return run


def pair_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """(query, document) -> score through a batch model."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        call = load()
        for left, right in parts:
            yield pd.Series(np.asarray(call(left.tolist(), right.tolist()), dtype="float64"))

    return run


def overlap_scorer(query: Column, doc: Column) -> Column:
    """Default pair score: share of common words."""
    return word_overlap(query, doc)


def token_counter(load: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """Text -> number of tokens of a tokenizer."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in parts:
            yield texts.map(lambda t: len(encode(t or ""))).astype("int64")

    return run


#: Characters that a message's JSON punctuation takes.
MESSAGE_OVERHEAD = 32


def message_chars(role: Column, text: Column, overhead: int = MESSAGE_OVERHEAD) -> Column:
    """Characters a message takes in the serialised history; ``overhead`` stands for its JSON punctuation."""
    return (F.length(F.coalesce(role, F.lit(""))) + F.length(F.coalesce(text, F.lit(""))) + F.lit(overhead)).cast("long")


def tokens_of(chars: Column) -> Column:
    """Default token estimate: four characters to a token, rounded up."""
    return F.ceil(chars / 4).cast("long")
