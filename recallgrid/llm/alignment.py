"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, counted over the corpus by external spill counting.

Texts fall into chunks before each single blank between non-blanks, where both tokenizers always cut; each distinct chunk is
aligned once per worker. A task turns its documents' linked id pairs into runs: records (pair, document) sorted by pair, the
A id first, split by radix of the A id and compressed with zstd. The runs of a radix part are merged by a k-way heap that counts each
pair; as pairs of one A id come together, its highest count is known when its last pair has passed. Counts then stream back along
the runs, whose order is the same, to the documents.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from recallgrid.llm import bpe
from recallgrid.llm.common import BATCH_BYTES, write_out

#: Ids of either tokenizer, and documents of a run, are below these powers of two: a record's code is A id, B id, document.
ID_BITS, SLOT_BITS = 22, 20
#: Records of a run, before equal ones of a document are joined.
RUN_RECORDS = 1 << 19
#: Characters of text for each radix part, and runs that one merge takes.
PART_CHARS, FAN_IN = 32_000_000, 512
#: Records of a part for each task in which counts go back.
SLICE_RECORDS = 8_000_000
#: Distinct chunks that a worker remembers; links of a group above which its ids are joined before they are paired.
CACHE, WIDE = 200_000, 1 << 20
#: Plain chunks that are encoded in one call.
JOINED = 4096

#: An entry of a run: a pair of ids, and the documents that hold it linked. A total: a pair, its count, whether it is its A id's highest.
ENTRY = np.dtype([("pair", "<u8"), ("n", "<u8")])
TOTAL = np.dtype([("pair", "<u8"), ("n", "<u8"), ("best", "<u8")])
#: A record of a run, in the order of the entries: the document, and how often it links the pair.
RECORD = np.dtype([("slot", "<u4"), ("times", "<u4")])
_ONE = np.uint32(1).tobytes()
#: Entries that are packed, and unpacked, at once.
PACK = 1 << 18

ALIGNED = ("run string, part int, records long, entries binary, held binary, slot int, doc_id long, n_a long, n_b long, "
           "n_groups long, n_links long, groups_sha256 string")
PARTED = "part int, run string, seq int, entries binary"
GIVEN = "run string, slots array<int>, sums array<long>, bests array<long>"

_SAFE = re.compile(r"(?<=[^ ])(?= \S)")
_ODD = re.compile(r" \s|\A\s|\s\Z")
#: Chunks of Latin letters, marks that follow them, and the same once more after a line break; and the words a tokenizer sees in them.
_EASY = re.compile(r" [A-Za-zÀ-ÖØ-öø-įı-ɏ]+[.,!?;:*$%&|#<>()]*(\n[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[.,!?;:*$%&|#<>()]*)?")
_EASY_WORDS = r" ?\p{L}+|[^\s\p{L}\p{N}]+|\n"


class _Plain(bpe.Pieces):
    """Byte-level encoder for which the strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.specials = ()


def chunks_of(text: str) -> list[str]:
    """Chunks of blank + text, each beginning with a blank; neither tokenizer has tokens across their borders."""
    if not _ODD.search(text):
        return [" " + p for p in text.split(" ")]
    return [p for p in _SAFE.split(" " + text) if p]


class Aligner:
    """Aligned chunks for a pair of tokenizer files: A byte-level, B of pieces that add a blank before the text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = _Plain(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size_a, size_b = max(self.a.bytes_of) + 1, self.b.get_piece_size()
        if max(size_a, size_b) > 1 << ID_BITS:
            raise ValueError(f"ids must be below {1 << ID_BITS}")
        names = [self.b.id_to_piece(i) for i in range(size_b)]
        self.bytes_a = [self.a.bytes_of.get(i, b"") for i in range(size_a)]
        self.bytes_b = [
            bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        # A piece with a blank inside it could cover a chunk's border.
        self.whole = any("▁" in n.lstrip("▁") for n in names)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        digits = [str(i) for i in range(max(size_a, size_b))]
        self.told = np.array([[d + mark for d in digits] for mark in ("", ",", "|", ";")], object)
        self.fast = self._ranked(path_a)
        self.known: dict[str, tuple | None] = {}

    def _ranked(self, path: str):
        """A faster encoder for plain words, if the file's ids stand in the order of its merges, as its ranks must."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        made = [self.a.vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if self.whole or made != sorted(made):
            return None
        special = set(self.a.tok.get_added_tokens_decoder())
        ranks = {self.bytes_a[i]: i for i in self.a.names if i not in special}
        return tiktoken.Encoding("plain", pat_str=_EASY_WORDS, mergeable_ranks=ranks, special_tokens={})

    def look_up(self, chunks: list[str]) -> dict:
        """What is known of the chunks, them among it: (n_a, groups, pairs, times), or None if tokens differ from the text.

        Up to ``CACHE`` chunks stay known to the worker. When they are full, those go that the chunks at hand do not use.
        """
        apart = set(chunks)
        new = [c for c in apart if c not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known = {c: self.known[c] for c in apart if c in self.known}
            if len(self.known) + len(new) > CACHE:
                return self.known | dict(zip(new, self.align(new)))
        self.known.update(zip(new, self.align(new)))
        return self.known

    def align(self, chunks: list[str]) -> list[tuple | None]:
        out: list = [None] * len(chunks)
        easy = [i for i, c in enumerate(chunks) if _EASY.fullmatch(c)] if self.fast else []
        hard = sorted(set(range(len(chunks))).difference(easy))
        for start in range(0, len(easy), JOINED):
            own = easy[start: start + JOINED]
            text = "".join([chunks[i] for i in own])
            a, b, raw = self.fast.encode_ordinary(text), self.b.encode(text[1:]), text.encode()
            if self._gives_back(raw, a, b):
                sizes = [len(chunks[i].encode()) for i in own]
                for i, found in zip(own, self._aligned(np.array(a, np.int64), np.array(b, np.int64), np.cumsum(sizes))):
                    out[i] = found
            else:
                hard += own
        right, of_a, of_b, sizes = [], [], [], []
        for i in hard:
            a, b, raw = self.a.ids(chunks[i]), self.b.encode(chunks[i][1:]), chunks[i].encode()
            if self._gives_back(raw, a, b):
                right.append(i)
                of_a += a
                of_b += b
                sizes.append(len(raw))
        if right:
            for i, found in zip(right, self._aligned(np.array(of_a, np.int64), np.array(of_b, np.int64), np.cumsum(sizes))):
                out[i] = found
        return out

    def _gives_back(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        return raw == b"".join([self.bytes_b[t] for t in b]) and raw == b"".join([self.bytes_a[t] for t in a])

    def _aligned(self, a: np.ndarray, b: np.ndarray, borders: np.ndarray) -> Iterator[tuple]:
        """All chunks side by side; their borders are byte offsets where both have ends."""
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        stop_a, stop_b = np.searchsorted(ends_a, borders) + 1, np.searchsorted(ends_b, borders) + 1
        mark = np.zeros((2, ends_a[-1] + 1), bool)
        mark[0, ends_a] = True
        mark[1, ends_b] = True
        last_a, last_b = mark[1, ends_a], mark[0, ends_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        # Decimal ids with the mark that follows each: comma inside a side, bar after the A side, semicolon after a group.
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        token = np.concatenate([a, b])[order]
        follows = np.concatenate([np.where(last_a, 2, 1), np.where(last_b, 3, 1)])[order]
        cut = stop_a + stop_b
        follows[cut - 1] = 0
        words = self.told[follows, token].tolist()
        pairs, times, where = self._pairs(a, b, group_a, in_a, in_b, in_a * in_b)
        ends = np.searchsorted(where, group_a[stop_a - 1], "right").tolist()  # pairs stand in the order of groups
        pairs, often = pairs.tobytes(), times.tobytes() if (times > 1).any() else None
        start = low = 0
        for n_a, stop, high in zip(np.diff(stop_a, prepend=0).tolist(), cut.tolist(), ends):
            yield n_a, "".join(words[start:stop]), pairs[8 * low: 8 * high], often[4 * low: 4 * high] if often else b""
            start, low = stop, high

    def _pairs(self, a, b, group_a, in_a, in_b, links):
        """Linked id pairs in the order of groups, how often each stands, and its group. Wide groups count their ids first."""
        first_b = np.cumsum(in_b) - in_b
        narrow = (links <= WIDE)[group_a]
        own, group = a[narrow], group_a[narrow]
        reach = in_b[group]
        inside = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
        pairs = np.repeat(own.astype(np.uint64) << np.uint64(ID_BITS), reach) | b[np.repeat(first_b[group], reach) + inside].astype(np.uint64)
        times, where = np.ones(len(pairs), np.uint32), np.repeat(group, reach)
        wide = np.flatnonzero(links > WIDE)
        if not len(wide):
            return pairs, times, where
        first_a = np.cumsum(in_a) - in_a
        found = [(pairs, times, where)]
        for g in wide:
            x, nx = np.unique(a[first_a[g]: first_a[g] + in_a[g]], return_counts=True)
            y, ny = np.unique(b[first_b[g]: first_b[g] + in_b[g]], return_counts=True)
            both = (x.astype(np.uint64)[:, None] << np.uint64(ID_BITS) | y.astype(np.uint64)).ravel()
            found.append((both, (nx[:, None] * ny).ravel().astype(np.uint32), np.full(len(both), g)))
        pairs, times, where = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(where, kind="stable")
        return pairs[order], times[order], where[order]


@functools.lru_cache(2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def pack(rows: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(rows.tobytes())


def unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _batch(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _spill(paths: tuple[str, str], parts: int, run_records: int):
    """Rows of the documents (with a slot in a run), and of their runs' parts."""
    schema = to_arrow_schema(_parse_datatype_string(ALIGNED))

    def flush(run, docs, pairs, times):
        slots = np.repeat(np.arange(len(docs), dtype=np.uint64), [len(p) // 8 for p in pairs])
        code = np.frombuffer(b"".join(pairs), np.uint64) << np.uint64(SLOT_BITS) | slots
        count = np.concatenate([np.frombuffer(t, np.uint32) if t else np.ones(len(p) // 8, np.uint32) for p, t in zip(pairs, times)])
        ids, doc, n_a, n_b, n_groups, n_links, digest = zip(*docs)
        yield _batch(schema, len(docs), run=[run] * len(docs), slot=ids, doc_id=doc, n_a=n_a, n_b=n_b, n_groups=n_groups,
                     n_links=n_links, groups_sha256=digest)
        if not len(code):
            return
        order = np.argsort(code, kind="stable")
        code, count = code[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, count = code[first], np.add.reduceat(count.astype(np.uint64), first)
        part = ((code >> np.uint64(SLOT_BITS + ID_BITS)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")  # pairs stay in order inside each part
        code, count, part = code[order], count[order], part[order]
        met, starts = np.unique(part, return_index=True)
        for p, low, high in zip(met.tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)]):
            mine = code[low:high]
            records = np.empty(high - low, RECORD)
            records["slot"], records["times"] = mine & np.uint64((1 << SLOT_BITS) - 1), count[low:high]
            pair = mine >> np.uint64(SLOT_BITS)
            new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            entries = np.empty(len(new), ENTRY)
            entries["pair"], entries["n"] = pair[new], np.diff(np.append(new, len(pair)))
            yield _batch(schema, 1, run=[run], part=[p], records=[high - low], entries=[pack(entries)], held=[pack(records)])

    def run(batches):
        aligner = _aligner(*paths)
        cut = (lambda t: [" " + t]) if aligner.whole else chunks_of
        task, number, held = TaskContext.get().partitionId(), 0, 0
        docs, pairs, times = [], [], []
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cuts = [cut(t) if t else [] for t in texts]
            known = aligner.look_up([c for cs in cuts for c in cs])
            for doc, chunks in zip(batch.column(0).to_pylist(), cuts):
                found = [known[c] for c in chunks]
                if not found or None in found:
                    docs.append((len(docs), doc, 0, 0, 0, 0, ""))
                    pairs.append(b"")
                    times.append(b"")
                else:
                    counts, groups, own, often = zip(*found)
                    text, n_a = ";".join(groups), sum(counts)
                    n_groups = text.count(";") + 1
                    own, links = b"".join(own), 0
                    if any(often):
                        often = b"".join([o or _ONE * (len(p) // 8) for o, p in zip(often, (f[2] for f in found))])
                        links = int(np.frombuffer(often, np.uint32).sum(dtype=np.int64))
                    else:
                        often, links = b"", len(own) // 8
                    docs.append((len(docs), doc, n_a, text.count(",") + text.count("|") + n_groups - n_a, n_groups, links,
                                 hashlib.sha256(text.encode()).hexdigest()))
                    pairs.append(own)
                    times.append(often)
                    held += len(own) // 8
                if held >= run_records or len(docs) == 1 << SLOT_BITS:
                    yield from flush(f"{task}-{number}", docs, pairs, times)
                    number, held = number + 1, 0
                    docs, pairs, times = [], [], []
        if docs:
            yield from flush(f"{task}-{number}", docs, pairs, times)

    return run


def _stream(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    """The entries of a run, unpacked piece by piece."""
    for blob in blobs:
        with zstandard.ZstdDecompressor().stream_reader(blob) as reader:
            left = b""
            while data := reader.read(ENTRY.itemsize << 10):
                data = left + data
                whole = len(data) // ENTRY.itemsize * ENTRY.itemsize
                rows, left = np.frombuffer(data[:whole], ENTRY), data[whole:]
                yield from zip(rows["pair"].tolist(), rows["n"].tolist())


def merged(runs: list[Iterator[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    """Sorted runs of (pair, n) as one, equal pairs added up, through a heap of the runs' heads."""
    for pair, same in groupby(heapq.merge(*runs), key=itemgetter(0)):
        yield pair, sum(map(itemgetter(1), same))


def with_maxima(entries: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(pair, n, 1 if n is the highest of the pair's A id, else 0): an A id's pairs come together."""
    for _, same in groupby(entries, key=lambda e: e[0] >> ID_BITS):
        own = list(same)  # no more than there are B ids
        most = max(map(itemgetter(1), own))
        for pair, n in own:
            yield pair, n, int(n == most)


def _packed(rows: Iterator[tuple], kind: np.dtype) -> Iterator[bytes]:
    chunk = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == PACK:
            yield pack(np.array(chunk, kind))
            chunk = []
    if chunk:
        yield pack(np.array(chunk, kind))


def _merge(final: bool):
    """Merge the runs of each key (part, heap), which come together, their chunks in order: rows of ``PARTED``."""
    schema = to_arrow_schema(_parse_datatype_string(PARTED))

    def told(key, runs):
        rows = merged([_stream(r) for r in runs.values()])
        part, heap = key
        for seq, blob in enumerate(_packed(with_maxima(rows), TOTAL) if final else _packed(rows, ENTRY)):
            yield _batch(schema, 1, part=[part], run=[str(heap)], seq=[seq], entries=[blob])

    def run(batches):
        now, runs = None, {}
        for batch in batches:
            for part, heap, name, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, heap) != now:
                    if runs:
                        yield from told(now, runs)
                    now, runs = (part, heap), {}
                runs.setdefault(name, []).append(blob)
        if runs:
            yield from told(now, runs)

    return run


def pair_totals(runs: DataFrame, tasks: int) -> DataFrame:
    """part, run, seq, entries: packed ``TOTAL`` rows of all pairs, from runs (part, run, seq, entries; written).

    No merge takes more than some ``FAN_IN`` runs: while a part has more, groups of them are merged into longer ones first.
    """
    while True:
        most = runs.groupBy("part").agg(F.count_distinct("run").alias("c")).agg(F.max("c")).first()[0] or 0
        heaps = -(-most // FAN_IN)
        dealt = runs.withColumn("heap", F.pmod(F.xxhash64("run"), F.lit(max(1, heaps))).cast("int")).select("part", "heap", "run", "seq", "entries")
        ordered = dealt.repartition(max(1, tasks), "part", "heap").sortWithinPartitions("part", "heap", "run", "seq").select("part", "heap", "run", "entries")
        runs = write_out(ordered.mapInArrow(_merge(heaps <= 1), PARTED), "align-merged")
        if heaps <= 1:
            return runs


def _return():
    """Counts back along the runs: totals come before the runs of their (part, slice); rows of ``GIVEN``, one a run."""
    schema = to_arrow_schema(_parse_datatype_string(GIVEN))

    def told(run, table, entries, held):
        at = np.repeat(np.searchsorted(table["pair"], entries["pair"]), entries["n"].astype(np.int64))
        times = held["times"].astype(np.int64)
        slots, back = np.unique(held["slot"], return_inverse=True)
        sums, bests = np.zeros((2, len(slots)), np.int64)
        np.add.at(sums, back, table["n"][at].astype(np.int64) * times)
        np.add.at(bests, back, table["best"][at].astype(np.int64) * times)
        return _batch(schema, 1, run=[run], slots=[slots.astype(np.int32)], sums=[sums], bests=[bests])

    def run(batches):
        now, totals, table = None, [], None
        for batch in batches:
            for key, name, entries, held in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    now, totals, table = key, [], None
                if held is None:
                    totals.append(unpack(entries, TOTAL))
                    continue
                if table is None:
                    table = np.concatenate(totals)
                yield told(name, table, unpack(entries, ENTRY), unpack(held, RECORD))

    return run


def _gather(docs: pa.Table, given: pa.Table) -> pa.Table:
    """A run's documents with what its parts give them."""
    slot = docs.column("slot").to_numpy()
    sums, bests = np.zeros((2, int(slot.max()) + 1 if len(slot) else 0), np.int64)
    for slots, s, b in zip(*(given.column(c) for c in ("slots", "sums", "bests"))):
        at = slots.values.to_numpy()
        sums[at] += s.values.to_numpy()
        bests[at] += b.values.to_numpy()
    out = docs.drop_columns(["run", "slot"])
    for name, column in (("n_best", bests), ("count_sum", sums)):
        out = out.append_column(name, pa.array(column[slot]))
    return out


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, run_records: int = RUN_RECORDS) -> DataFrame:
    """Each document's tokens in both tokenizers, aligned, with what its links weigh over all documents.

    Columns: doc_id, n_a, n_b (tokens), n_groups (cut where both have ends), n_links (A-B occurrence pairs of a group), groups_sha256
    (of decimal ids, ``a1,a2|b1;a3|b2``), n_best (links whose count is the highest of their A id) and count_sum (over links). A pair's
    count is the number of documents that hold it linked.

    Null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have no tokens: zeros and ''. Every
    row is a document of its own, so null doc_ids and repeated rows stay, and copies count. No rows give no rows; other columns are
    ignored.

    Runs are written to the shared folder. Merges see each run's pairs with their counts, not its documents, so a frequent A id is
    small by then; where counts go back, the runs of a large part are dealt over several tasks.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(8, -(-chars // PART_CHARS))
    spilled = write_out(docs.select("doc_id", "text").mapInArrow(_spill((path_a, path_b), parts, run_records), ALIGNED), "align-runs")
    runs = spilled.filter("part IS NOT NULL")
    totals = pair_totals(runs.select("part", "run", F.lit(0).alias("seq"), "entries"), parts)

    slices = write_out(runs.groupBy("part").agg(F.ceil(F.sum("records") / SLICE_RECORDS).cast("int").alias("slices")), "align-slices")
    # One row for each part, and no more parts than A ids.
    told = totals.join(F.broadcast(slices), "part").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "part", "slice", F.lit(None).cast("string").alias("run"), "seq", "entries", F.lit(None).cast("binary").alias("held"))
    asked = runs.join(F.broadcast(slices), "part").select(
        "part", F.pmod(F.xxhash64("run"), F.col("slices")).cast("int").alias("slice"), "run", F.lit(0).alias("seq"), "entries", "held")
    back = told.unionByName(asked).repartition(parts, "part", "slice").sortWithinPartitions(
        "part", "slice", F.col("run").asc_nulls_first(), "seq").select(F.struct("part", "slice").alias("key"), "run", "entries", "held")
    given = back.mapInArrow(_return(), GIVEN)
    rows = spilled.filter("part IS NULL").select("run", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return rows.groupBy("run").cogroup(given.groupBy("run")).applyInArrow(
        _gather, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
