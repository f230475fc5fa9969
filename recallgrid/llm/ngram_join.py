"""Exact self-join of documents on the Jaccard similarity of word n-grams, by universe partitioning.

The universe of n-grams is hashed into segments, their number set by the size band of the sets. Two sets of similarity 0.75 or
more differ in at most (|r| + |s|) / 7 n-grams, so of any floor(2 |r| / 7) + 1 of r's segments at least one holds the same
n-grams in a smaller partner s. Each set is indexed by its segments' subsets, in its own band and in the next one, where larger
partners look for it; sets of small bands also by every subset less one n-gram (a segment that may differ by one counts
twice). The cost of a subset is the number of sets that share it. Every set looks itself up by the cheapest subsets that reach the
bound; most of a text's subsets are its own, so most texts have nothing to compare. Where many sets share a subset, pairs whose
parity bitmaps already differ in more bits than linked sets may differ in n-grams are left out: each n-gram that only one of two
sets holds flips one bit, so bitmaps never differ in more. What is left is verified on the sets.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import BATCH_BYTES, arrow_pass, bounded, write_out
from recallgrid.llm.components import components

WORDS = 5
#: Similarity as num / den.
NUM, DEN = 75, 100
#: Segments for each n-gram of the largest set in a band; small bands have more, and one-deletion neighbourhoods.
SEGMENTS, SMALL_SEGMENTS, SMALL = 0.42, 2.0, 75
#: Characters of text for each task of the segment index.
TASK_CHARS = 16_000_000
#: Ids that may be broadcast to pick out documents; beyond, the documents are joined by a shuffle.
MOST_IDS = 1 << 21

#: Rounds of comparing each set with hubs before the look-ups.
HUB_ROUNDS = 1

#: Sets that share a subset, from which on their bitmaps go along with the index; bits of a bitmap.
CROWD, BITS = 32, 2048

#: Sets and n-grams of a block, two of which are compared in a cell, and n-grams compared at once.
CELL_SETS, CELL_TOKENS, CELL_CODES = 512, 500_000, 4096

OWN, NEXT, OWN_LESS, NEXT_LESS = 0, 1, 2, 3

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_FULL = (1 << 64) - 1
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text over which one running sum goes, unless a single word is longer.
STRETCH = 1 << 18
_TAPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(r))]), dtype=np.uint64) for r in (_BASE, _INVERSE))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, A-Z in lower case.

    A word's hash is a polynomial of its bytes: the difference of two running sums, shifted back to the word's own start. The sums
    begin anew after every ``STRETCH`` bytes or at the next blank.
    """
    b = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[1], blank.view(np.int8), [1]])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        first = int(starts[done])
        stop = max(done + 1, int(np.searchsorted(ends, first + STRETCH, "right")))
        low, high = starts[done:stop] - first, ends[done:stop] - first
        size = int(high[-1])
        powers, inverse = _powers(1 << max(12, (size - 1).bit_length()))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((b[first: first + size].astype(np.uint64) + _U(1)) * powers[:size], out=sums[1:])
        out[done:stop] = (sums[high] - sums[low]) * inverse[low]
        done = stop
    return mix(out + (ends - starts).astype(np.uint64) * _A)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; fewer words than n: the whole sequence is one; none: empty."""
    w = word_hashes(text or "")
    n = len(w)
    if not n:
        return w
    if n < words:
        return mix((w * _TAPS[:n]).sum(dtype=np.uint64, keepdims=True) + _U(n * int(_C) & _FULL))
    total = w[: n - words + 1] * _TAPS[0]
    for i in range(1, words):
        total += w[i: n - words + 1 + i] * _TAPS[i]
    total = mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


@functools.lru_cache(1)
def band_tops() -> np.ndarray:
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, tops[-1] * DEN // NUM))
    return np.array(tops)


def most_apart(n: int) -> int:
    """n-grams in which a set of n and any partner no larger may differ: floor(2 n (den - num) / (den + num))."""
    return 2 * n * (DEN - NUM) // (DEN + NUM)


def segment_subsets(tokens: np.ndarray, spread: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of the non-empty segments of a set in a band, of these less one n-gram (small bands only),
    and the number of segments of two n-grams or more. ``spread``: the tokens' hashes that a segment adds up.

    The two low bits are free for the kind; in small bands the bits above them hold the segment (8) and whether the subset has
    two n-grams or more (1).
    """
    top = int(band_tops()[band])
    small = top <= SMALL
    m = _U(max(2, int(top * (SMALL_SEGMENTS if small else SEGMENTS))))
    segment = ((tokens >> _U(32)) * m) >> _U(32)  # grows with the token, so segments are runs
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sums = np.add.reduceat(spread, first)
    number = segment[first]
    salt = mix(number * _A + _U(band * int(_B) & _FULL))

    def finish(sums, salt, number, many):
        h = mix(sums + salt)
        return (h & ~_U(0xFFF)) | number << _U(2) | many.astype(np.uint64) << _U(10) if small else h & ~_U(3)

    less, lengths = np.empty(0, np.uint64), np.diff(np.append(first, len(tokens)))
    if small:
        each = np.repeat(lengths, lengths)
        at = each >= 2
        less = finish(np.repeat(sums, lengths)[at] - spread[at], np.repeat(salt, lengths)[at], segment[at], each[at] >= 3)
    return finish(sums, salt, number, lengths >= 2), less, int((lengths >= 2).sum())


def set_signatures(tokens: np.ndarray) -> tuple[np.ndarray, int, int]:
    """All signatures of a set with their kind in the low bits; its own non-empty segments; those of two n-grams or more."""
    band = int(np.searchsorted(band_tops(), len(tokens)))
    out, own, many, spread = [], 0, 0, mix(tokens ^ _C)
    for at, kinds in ((band, (OWN, OWN_LESS)), (band + 1, (NEXT, NEXT_LESS))):
        whole, less, several = segment_subsets(tokens, spread, at)
        if at == band:
            own, many = len(whole), several
        out += [whole | _U(kinds[0]), less | _U(kinds[1])]
    return np.concatenate(out), own, many


SIGNATURES = ["part", "docs", "sigs", "i_doc", "i_n", "i_own", "i_many", "i_f1", "i_f2"]
SIGNATURE_TYPES = ("part int, docs array<long>, sigs array<long>, i_doc array<long>, i_n array<int>, i_own array<int>, "
                   "i_many array<int>, i_f1 array<long>, i_f2 array<long>")
SHARED = ("what string, part int, doc long, other long, sigs array<long>, costs array<long>, n int, own int, many int, "
          "f1 long, f2 long")
SHARED_ARROW = pa.schema([
    ("what", pa.string()), ("part", pa.int32()), ("doc", pa.int64()), ("other", pa.int64()), ("sigs", pa.list_(pa.int64())),
    ("costs", pa.list_(pa.int64())), ("n", pa.int32()), ("own", pa.int32()), ("many", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64())])


def _signature_batches(parts: int):
    def run(batches):
        for batch in batches:
            docs, sigs, info = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = shingles(text)
                if doc is None or not len(tokens):
                    continue
                signs, own, many = set_signatures(tokens)
                docs.append((doc, len(signs)))
                sigs.append(signs)
                with np.errstate(over="ignore"):
                    f1, f2 = tokens.sum(dtype=np.uint64), mix(tokens * _A).sum(dtype=np.uint64)
                info.append((doc, len(tokens), own, many, int(f1.view(np.int64)), int(f2.view(np.int64))))
            if not docs:
                continue
            ids = np.repeat(np.array([d for d, _ in docs], np.int64), [n for _, n in docs])
            signs = np.concatenate(sigs)
            part = ((signs >> _U(12)) % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            by_part = np.array([d[0] for d in info], np.int64) % parts
            met = np.unique(np.concatenate([part, by_part]))  # only parts that this batch has rows for
            cuts = np.append(np.searchsorted(part[order], met), len(part))
            ids, signs = ids[order], signs[order].view(np.int64)
            rows = {k: [] for k in met.tolist()}
            for k, row in zip(by_part.tolist(), info):
                rows[k].append(row)
            lists = lambda i, kind: pa.array([[r[i] for r in own] for own in rows.values()], pa.list_(kind))
            offsets = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(met, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(ids)),
                 pa.ListArray.from_arrays(offsets, pa.array(signs)), lists(0, pa.int64()), lists(1, pa.int32()),
                 lists(2, pa.int32()), lists(3, pa.int32()), lists(4, pa.int64()), lists(5, pa.int64())], SIGNATURES)

    return run


def _flat(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _lengths(column) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _shared_subsets(batches, number):
    """Of one part's signatures: those that two or more sets share, with their costs (``s`` rows), and each set's size, own
    segments and fingerprint (``i`` rows).
    """
    parts, ids, sigs, info = [], [], [], []
    for batch in batches:
        parts += batch.column("part").to_pylist()
        ids += [np.asarray(x.values) for x in batch.column("docs")]
        sigs += [np.asarray(x.values) for x in batch.column("sigs")]
        info.append([_flat(batch.column(c)) for c in SIGNATURES[3:]])
    if not parts:
        return
    schema = SHARED_ARROW

    def table(what, size, **columns):
        given = {"what": pa.array([what] * size)} | columns
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

    doc, n, own, many, f1, f2 = (np.concatenate(c) for c in zip(*info))
    yield table("i", len(doc), doc=pa.array(doc, pa.int64()), n=pa.array(n, pa.int32()), own=pa.array(own, pa.int32()),
                many=pa.array(many, pa.int32()), f1=pa.array(f1, pa.int64()), f2=pa.array(f2, pa.int64()))
    ids, sigs = np.concatenate(ids), np.concatenate(sigs).view(np.uint64)
    base = sigs >> _U(2)
    order = np.argsort(base, kind="stable")
    base = base[order]
    new = np.concatenate([[True], base[1:] != base[:-1]]) if len(base) else np.empty(0, bool)
    twice = ~new | np.concatenate([~new[1:], [False]]) if len(base) else new
    order = order[twice]
    ids, sigs, new = ids[order], sigs[order], new[twice]
    if not len(ids):
        return
    kind = (sigs & _U(3)).astype(np.int64)
    group = np.cumsum(new) - 1
    groups = int(group[-1]) + 1
    exact = kind <= NEXT
    whole = np.bincount(group, weights=exact, minlength=groups).astype(np.int64)
    less = np.bincount(group, minlength=groups) - whole
    # Sets met by a subset looked up whole (with those that have it by a deletion added above bit 32), and by one less an n-gram.
    cost = np.where(exact, whole[group] - 1 + (less[group] << 32), whole[group])
    useful = np.where(exact, whole[group] + less[group] > 1, whole[group] > 0)
    ids, sigs, cost = ids[useful], sigs[useful], cost[useful]
    if len(ids):
        part = ((sigs >> _U(12)) % _U(number)).astype(np.int64)
        by = np.lexsort((part, ids))
        ids, sigs, cost, part = ids[by], sigs[by], cost[by], part[by]
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (part[1:] != part[:-1])]))
        offsets = pa.array(np.append(first, len(ids)), pa.int32())
        yield table("s", len(first), part=pa.array(part[first].astype(np.int32)), doc=pa.array(ids[first]), sigs=pa.ListArray.from_arrays(offsets, pa.array(sigs.view(np.int64))),
                    costs=pa.ListArray.from_arrays(offsets, pa.array(cost)))


def allocate(n: int, own: int, many: int, sigs: np.ndarray, costs: np.ndarray) -> tuple[list[tuple[int, int]], bool]:
    """The cheapest look-ups of a set, and whether they reach its bound.

    ``sigs``, ``costs``: its own shared subsets. Those not among them meet nobody: they count, at no cost. A look-up is (subset,
    mode): 0 meets whole subsets, 1 also subsets that others have less one n-gram. In small bands a segment of two n-grams or more
    may count twice: then its subset is looked up in mode 1, and all its one-deletions in mode 0.
    """
    need = most_apart(n) + 1
    kind = (sigs & _U(3)).astype(np.int64)
    base, met, less = sigs >> _U(2), costs & 0xFFFFFFFF, costs >> 32
    whole = kind == OWN
    shared = whole & (met > 0)
    need -= own - int(shared.sum())
    if need <= 0:
        return [], True
    if int(band_tops()[int(np.searchsorted(band_tops(), n))]) > SMALL:
        picks = base[shared][np.argsort(met[shared], kind="stable")]
        return [(int(s), 0) for s in picks[:need]], len(picks) >= need
    segments: dict[int, list] = {}  # segment: [subset, cost whole, cost of widening, several n-grams, one-deletions]
    for s, k, c, extra in zip(base.tolist(), kind.tolist(), met.tolist(), less.tolist()):
        at = segments.setdefault(s & 0xFF, [None, 0, 0, False, []])
        if k == OWN:
            at[0], at[1], at[3] = s, c, bool(s >> 8 & 1)
            at[2] += extra
        else:
            at[2] += c
            at[3] = True
            at[4].append(s)
    need -= max(0, many - sum(a[3] for a in segments.values()))
    units = []
    for number, (_, cost, wider, several, _) in segments.items():
        if cost:
            units.append((cost, 0, number))
        if several:
            units.append((cost + wider if cost else wider, 1, number))
    picked, wide = set(), set()
    for _, widen, number in sorted(units):
        if need <= 0:
            break
        (wide if widen else picked).add(number)
        need -= 1
    out = []
    for number in picked | wide:
        subset, cost, _, _, fewer = segments[number]
        if subset is not None and (cost or number in wide):
            out.append((subset, int(number in wide)))
        if number in wide:
            out += [(s, 0) for s in fewer]
    return out, need <= 0


def _look_ups(number):
    """A task's sets, each with all its shared subsets: rows (part, doc, sigs, modes), or (null, doc) if its bound is not reached."""
    schema = pa.schema([("part", pa.int32()), ("doc", pa.int64()), ("sigs", pa.list_(pa.int64())), ("modes", pa.list_(pa.int32()))])

    def run(batches):
        rows: dict[int, list] = {}
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), batch.column(5)):
                mine = rows.setdefault(r[0], [r[1], r[2], r[3], [], []])
                mine[3].append(np.asarray(r[4].values))
                mine[4].append(np.asarray(r[5].values))
        out = []
        for doc, (n, own, many, sigs, costs) in rows.items():
            sigs, costs = np.concatenate(sigs).view(np.uint64), np.concatenate(costs)
            mine = (sigs & _U(1)) == 0  # own band
            picks, reached = allocate(n, own, many, sigs[mine], costs[mine])
            if not reached:
                out.append((None, doc, [], []))
                continue
            by_part: dict[int, tuple[list, list]] = {}
            for s, mode in picks:
                at = by_part.setdefault((s >> 10) % number, ([], []))
                at[0].append(s)
                at[1].append(mode)
            out += [(p, doc, s, m) for p, (s, m) in by_part.items()]
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i: i + 10_000]), schema)], schema=schema)

    return run


def _hub_pairs(seed):
    """Pairs (doc, other, shared): each set with the set that stands first among those sharing a subset, if of another component.

    First is the set whose subsets are shared most (seed 0: the middle of a group of near copies), or by a hash (other seeds).
    """
    def run(batches):
        rows = [(*(batch.column(k).to_numpy() for k in ("doc", "comp", "weight")), _flat(batch.column("sigs")), _lengths(batch.column("sigs")))
                for batch in batches if batch.num_rows]
        if not rows:
            return
        doc, comp, weight, sig, lengths = (np.concatenate(c) for c in zip(*rows))
        sig, at = sig.view(np.uint64), np.repeat(np.arange(len(doc)), lengths)
        whole = (sig & _U(3)) <= NEXT
        sig, at = sig[whole], at[whole]
        first = (mix(doc.view(np.uint64) + _U(seed * int(_A) & _FULL)) >> _U(1)).view(np.int64) if seed else -weight
        place = np.empty(len(doc), np.int64)
        place[np.lexsort((doc, first))] = np.arange(len(doc))
        order = np.lexsort((place[at], sig >> _U(2)))
        sig, at = sig[order], at[order]
        base = sig >> _U(2)
        new = np.concatenate([[True], base[1:] != base[:-1]])
        hub = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        keep = ((sig & _U(3)) == OWN) & (comp[hub] != comp[at])
        docs, at = np.unique(doc, return_inverse=True)[1], at[keep]
        pairs, counts = np.unique(docs[at] * len(doc) + docs[hub[keep]], return_counts=True)
        ids = np.unique(doc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[pairs // len(doc)]), pa.array(ids[pairs % len(doc)]), pa.array(counts.astype(np.int32))],
            ["doc", "other", "shared"])

    return run


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set as 64-bit words: each n-gram flips one bit."""
    odd = np.bincount((mix(tokens ^ _A) % _U(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _meet(batches):
    """Pairs (doc, other, shared) that meet in a task's parts: the doc looks up, the other is no larger and of another component.

    Of pairs with bitmaps only those that may be linked by these.
    """
    index, asks, maps, q_maps, held = [], [], [], {}, 0
    for batch in batches:
        asking = pc.equal(batch.column("what"), "a")
        for part, asked in ((batch.filter(asking), True), (batch.filter(pc.invert(asking)), False)):
            if not part.num_rows:
                continue
            lengths = _lengths(part.column("sigs"))
            doc, comp, n = (part.column(c).to_numpy() for c in ("doc", "comp", "n"))
            own = *(np.repeat(c, lengths) for c in (doc, comp, n)), _flat(part.column("sigs"))
            mapped = part.column("bits").is_valid().to_numpy(zero_copy_only=False)
            bits = _flat(part.column("bits")).reshape(-1, BITS // 64)
            if asked:
                asks.append((*own, _flat(part.column("modes"))))
                q_maps |= zip(doc[mapped].tolist(), bits)
            else:
                index.append((*own, np.repeat(np.where(mapped, held + np.cumsum(mapped) - 1, -1), lengths)))
                maps.append(bits)
                held += len(bits)
    if not asks or not index:
        return
    maps = np.concatenate(maps)
    doc, comp, n, sig, place = (np.concatenate(c) for c in zip(*index))
    kind, sig = sig.view(np.uint64) & _U(3), (sig.view(np.uint64) >> _U(2)).view(np.int64)
    q_doc, q_comp, q_n, q_sig, q_mode = (np.concatenate(c) for c in zip(*asks))
    order = np.argsort(sig, kind="stable")
    doc, comp, n, sig, kind, place = doc[order], comp[order], n[order], sig[order], kind[order], place[order]
    low, high = np.searchsorted(sig, q_sig), np.searchsorted(sig, q_sig, "right")
    # Subsets held by one component only meet nothing new.
    change = np.concatenate([[0], np.cumsum((comp[1:] != comp[:-1]) & (sig[1:] == sig[:-1]))])
    several = (high - low >= 2) & (change[np.maximum(high - 1, 0)] != change[np.minimum(low, len(sig) - 1)])
    schema = pa.schema([("doc", pa.int64()), ("other", pa.int64()), ("shared", pa.int32())])
    by = np.argsort(q_doc[several], kind="stable")
    look = np.flatnonzero(several)[by]
    cuts = np.flatnonzero(np.diff(q_doc[look], prepend=-1 << 62))
    for a, b in zip(cuts, np.append(cuts[1:], len(look))):
        met = []
        for i in look[a:b]:
            span = slice(low[i], high[i])
            fit = (comp[span] != q_comp[i]) & (n[span] * DEN >= q_n[i] * NUM) & (
                (n[span] < q_n[i]) | ((n[span] == q_n[i]) & (doc[span] < q_doc[i])))
            if not q_mode[i]:
                fit &= kind[span] <= NEXT
            met.append(low[i] + np.flatnonzero(fit))
        met = np.concatenate(met)
        own_map = q_maps.get(int(q_doc[look[a]]))
        if own_map is not None and len(maps) and len(met):
            _, one, back = np.unique(doc[met], return_index=True, return_inverse=True)
            one = met[one]
            mapped = np.flatnonzero(place[one] >= 0)
            apart = np.bitwise_count(maps[place[one[mapped]]] ^ own_map).sum(axis=1, dtype=np.int64)
            near = np.ones(len(one), bool)
            near[mapped] = apart * (DEN + NUM) <= (n[one[mapped]].astype(np.int64) + int(q_n[look[a]])) * (DEN - NUM)
            met = met[near[back]]
        others, counts = np.unique(doc[met], return_counts=True)
        if len(others):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(others), q_doc[look[a]])), pa.array(others), pa.array(counts.astype(np.int32))], schema=schema)


def sets_of(docs: DataFrame, ids: DataFrame, digest=lambda tokens: tokens.view(np.int64)) -> DataFrame:
    """doc, tokens (or their ``digest``) of the documents in ``ids`` (doc; written).

    Ids are broadcast up to ``MOST_IDS``, else joined by a shuffle.
    """
    wanted = bounded(ids, MOST_IDS)
    mine = docs.join(ids if wanted is None else wanted, docs["doc_id"] == ids["doc"], "left_semi")

    def rows(keys, texts):
        for key, text in zip(keys, texts):
            yield key, digest(shingles(text))

    return arrow_pass(mine, ["doc_id", "text"], "doc long, tokens array<long>", rows)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b; written) whose sets reach the similarity, by exact intersection. Written."""
    ids = write_out(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), "join-ids")
    sets = write_out(sets_of(docs, ids), "join-sets")
    left, right = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    near = DEN * both >= NUM * (F.size("x") + F.size("y") - both)
    return write_out(pairs.join(left, "a").join(right, "b").filter(near).select("a", "b").distinct(), "join-links")


def _block_links(docs: DataFrame, rest: DataFrame, block: int = 256) -> DataFrame:
    """Links of the few sets whose own subsets cannot reach their bound, each compared with every set, in blocks of about ``block``."""
    found = None
    blocks = -(-rest.count() * 2 // block)
    for i in range(blocks):
        own = write_out(rest.filter(F.pmod(F.xxhash64("doc"), F.lit(blocks)) == i), "join-ids")
        sets = [(r.doc, np.array(r.tokens, np.int64)) for r in sets_of(docs, own).collect()]

        def rows(keys, texts, sets=sets):
            for key, text in zip(keys, texts):
                tokens = shingles(text).view(np.int64)
                for doc, other in sets:
                    small, large = sorted((len(tokens), len(other)))
                    if key is not None and key != doc and small * DEN >= large * NUM:
                        both = len(np.intersect1d(tokens, other))
                        if both and DEN * both >= NUM * (small + large - both):
                            yield key, doc

        links = arrow_pass(docs, ["doc_id", "text"], "a long, b long", rows)
        found = links if found is None else found.unionByName(links)
    return write_out(found, "join-links")


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc, n, component of each document with words (null: its own), and doc, n, f1, f2 of each set. Both written."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(24, -(-chars // TASK_CHARS))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    signatures = docs.mapInArrow(_signature_batches(parts), SIGNATURE_TYPES)
    shared = write_out(
        signatures.repartitionById(parts, "part").mapInArrow(lambda b: _shared_subsets(b, parts), SHARED), "join-shared")

    whole = F.struct("n", "f1", "f2")
    info = write_out(shared.filter("what = 'i'").groupBy("doc").agg(
        *(F.max_by(c, whole).alias(c) for c in ("n", "own", "many", "f1", "f2")), (F.max(whole) != F.min(whole)).alias("several")), "join-info")
    copies = write_out(info.groupBy("n", "f1", "f2").agg(F.min("doc").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c"), "join-copies")
    sized = write_out(info.join(copies, ["n", "f1", "f2"], "left").select(
        "doc", F.coalesce("rep", "doc").alias("rep"), "n", "own", "many"), "join-sized")
    reps = sized.filter("doc = rep").drop("rep")
    same = sized.filter("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))

    met = F.aggregate("costs", F.lit(0).cast("long"), lambda total, c: total + c.bitwiseAND(F.lit(0xFFFFFFFF)))
    held = shared.filter("what = 's'").select("part", "doc", "sigs", "costs")
    weights = held.groupBy("doc").agg(F.sum(met).alias("weight"))
    labelled = write_out(reps.join(weights, "doc").withColumn("comp", F.col("doc")), "join-labelled")

    # First each set against hubs with which it shares most subsets: large groups fall together without comparing all pairs.
    links = same.limit(0)
    for seed in range(HUB_ROUNDS):
        near = held.join(labelled.select("doc", "comp", "weight"), "doc").repartitionById(parts, "part").mapInArrow(
            _hub_pairs(seed), "doc long, other long, shared int")
        best = F.slice(F.sort_array(F.collect_list(F.struct("c", "other")), asc=False), 1, 3)
        near = near.groupBy("doc", "other").agg(F.sum("shared").alias("c")).join(labelled.select("doc", "own"), "doc")
        tried = write_out(near.filter("c * 6 >= own").groupBy("doc").agg(best.alias("t")).select(
            F.col("doc").alias("a"), F.explode("t.other").alias("b")), "join-hubs")
        if not tried.limit(1).count():
            break
        links = write_out(links.unionByName(verified(docs, tried)), "join-links")
        component = write_out(components(links).withColumnRenamed("node", "doc"), "join-component")
        labelled = write_out(labelled.drop("comp").join(component, "doc", "left").withColumn(
            "comp", F.coalesce("component", "doc")).drop("component"), "join-labelled")

    # Then every set looks itself up by its cheapest subsets, among sets of other components.
    subsets = write_out(held.join(labelled.drop("weight"), "doc"), "join-subsets")
    looks = write_out(subsets.select("doc", "n", "own", "many", "sigs", "costs").repartition(parts, "doc").mapInArrow(
        _look_ups(parts), "part int, doc long, sigs array<long>, modes array<int>"), "join-looks")
    asks = looks.filter("part IS NOT NULL").join(labelled, "doc").select(
        F.lit("a").alias("what"), "part", "doc", "comp", "n", "sigs", "modes")
    crowded = F.exists("costs", lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)) + F.shiftright(c, 32) >= CROWD)
    known = subsets.select(
        F.lit("i").alias("what"), "part", "doc", "comp", "n", "sigs", F.lit(None).cast("array<int>").alias("modes"), crowded.alias("crowded"))
    # An id that repeats stands for several sets, so it gets no bitmap.
    ids = write_out(known.filter("crowded").select("doc").distinct(), "join-crowded")
    bits = write_out(sets_of(docs, ids, bitmap).groupBy("doc").agg(F.count("*").alias("c"), F.first("tokens").alias("bits")).filter(
        "c = 1").drop("c"), "join-bits")
    asks = asks.join(bits, "doc", "left")
    known = known.filter("NOT crowded").drop("crowded").withColumn("bits", F.lit(None).cast("array<long>")).unionByName(
        known.filter("crowded").drop("crowded").join(bits, "doc", "left"))
    met = asks.unionByName(known).repartitionById(parts, "part").mapInArrow(_meet, "doc long, other long, shared int")
    pairs = write_out(met.groupBy("doc", "other").agg(F.sum("shared").alias("shared")).select(
        F.col("doc").alias("a"), F.col("other").alias("b"), "shared"), "join-pairs")
    all_links = same.unionByName(links)
    if pairs.limit(1).count():
        to = labelled.select(F.col("doc").alias("b"), F.col("comp").alias("to"))
        first = write_out(pairs.join(to, "b").groupBy("a", "to").agg(F.max_by("b", F.struct("shared", "b")).alias("b")).select("a", "b"), "join-first")
        more = verified(docs, first)
        joined = components(links.unionByName(more))
        known = write_out(joined, "join-labels")
        left = pairs.join(known.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(
            known.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        left = write_out(left.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).join(first, ["a", "b"], "left_anti").select("a", "b"), "join-rest")
        all_links = all_links.unionByName(more)
        if left.limit(1).count():
            all_links = all_links.unionByName(verified(docs, left))
    # An id that repeats with other sets was looked up by one of them only: it is compared with every set.
    several = info.filter("several").select("doc")
    # Sets that share nothing may still have too few segments to be sure of it.
    units = F.col("own") + F.when(F.col("n") <= int(band_tops()[band_tops() <= SMALL].max()), F.col("many")).otherwise(0)
    bare = reps.filter(units <= F.floor(2 * F.col("n") * (DEN - NUM) / (DEN + NUM))).join(labelled, "doc", "left_anti").select("doc")
    rest = write_out(looks.filter("part IS NULL").select("doc").unionByName(bare).unionByName(several).distinct(), "join-unreached")
    if rest.limit(1).count():
        all_links = all_links.unionByName(_block_links(docs, rest))
    final = components(all_links)
    result = write_out(info.select("doc", "n").join(final.withColumnRenamed("node", "doc"), "doc", "left"), "join-result")
    return result, shared.filter("what = 'i'").select("doc", "n", "f1", "f2")


def _told(docs: DataFrame, result: DataFrame, *more) -> DataFrame:
    return docs.select("doc_id").join(result, docs["doc_id"] == result["doc"], "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: components of documents linked by a similarity of ``NUM`` / ``DEN`` or more.

    A document without words is linked with nothing and stands for itself. Rows with a null doc_id take no part in links and get a null
    component; rows that repeat a doc_id are one document, with the links of each. No rows give no rows; other columns are ignored.
    Links inside a component are not all looked for; ``link_counts`` and ``links`` have them all.
    """
    docs = docs.select("doc_id", "text")
    return _told(docs, _joined(docs)[0])


def _members(result: DataFrame, prints: DataFrame) -> DataFrame:
    """doc, component, tokens, rep, copies of each document with words: documents of one set have one representative. Written.

    A document whose id repeats with other sets stands for itself.
    """
    sets = prints.groupBy("doc").agg(F.max(F.struct("n", "f1", "f2")).alias("p"), F.min(F.struct("n", "f1", "f2")).alias("q"),
                                     F.sum("n").alias("tokens"))
    several = F.col("p") != F.col("q")
    sets = write_out(sets.join(result.select("doc", F.coalesce("component", "doc").alias("component")), "doc").select(
        "doc", "component", "tokens", "p.*", F.when(several, F.col("doc")).otherwise(F.lit(0)).alias("own"), several.alias("several")), "join-prints")
    key = ["n", "f1", "f2", "several", "own"]
    reps = sets.groupBy(*key).agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    return write_out(sets.join(write_out(reps, "join-reps"), key).select("doc", "component", "tokens", "rep", "copies"), "join-members")


def _near(tokens: np.ndarray, lengths: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For the sets at ``rows`` x those at ``columns``, whether they are linked, by exact intersection."""
    code = np.unique(tokens, return_inverse=True)[1]
    shared = np.bincount(code) > 1
    order = np.argsort(code, kind="stable")
    order = order[shared[code[order]]]
    at, code = np.repeat(np.arange(len(lengths)), lengths)[order], (np.cumsum(shared) - 1)[code[order]]
    both = np.zeros((len(rows), len(columns)), np.int64)
    for low in range(0, int(shared.sum()), CELL_CODES):
        span = slice(*np.searchsorted(code, [low, low + CELL_CODES]))
        held = np.zeros((len(lengths), CELL_CODES), np.float32)
        held[at[span], code[span] - low] = 1
        both += (held[rows] @ held[columns].T).astype(np.int64)
    return (both > 0) & (DEN * both >= NUM * (lengths[rows][:, None] + lengths[columns][None, :] - both))


def _cell(counted: bool):
    """Links between the two blocks of a cell, or inside its one block: pairs (a, b), a < b, or for each document the number of documents linked."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("block", "ascending"), ("doc", "ascending")])
        doc, block, copies = (table.column(c).to_numpy() for c in ("doc", "block", "copies"))
        lists = table.column("tokens").combine_chunks()
        first = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))  # an id that repeats has several sets
        doc, copies, parted = doc[first], copies[first], block[first] != block[0]
        sides = [np.flatnonzero(block == b) for b in (block.min(), block.max())]
        near = _near(_flat(lists), _lengths(lists), *sides)
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        if not one and not parted.any():  # nobody in the other block
            near = near[:, :0]
        left = ~parted
        right = left if one else parted
        if near.size:
            near = np.logical_or.reduceat(near, first[left], axis=0)
            near = np.logical_or.reduceat(near, first[right] - sides[1][0], axis=1)
        else:
            near = np.zeros((int(left.sum()), int(right.sum())), bool)
        if one:
            np.fill_diagonal(near, False)
        if counted:
            found = [(doc[left], near @ copies[right])] + ([] if one else [(doc[right], copies[left] @ near)])
            ids, n = (np.concatenate(c) for c in zip(*found))
            return pa.table({"doc": pa.array(ids[n > 0], pa.int64()), "links": pa.array(n[n > 0], pa.int64())})
        x, y = np.nonzero(np.triu(near) if one else near)
        x, y = doc[left][x], doc[right][y]
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})

    return run


def _linked(docs: DataFrame, members: DataFrame, counted: bool) -> DataFrame:
    """Every link between representatives, as pairs (a, b), or counted: doc, links (one for each copy of the other). Written.

    Only documents of one component can be linked. Its representatives are dealt by hash into blocks of bounded size, and each cell
    of two blocks compares all their sets, so nothing depends on the index and no group is one task.
    """
    reps = members.filter("doc = rep").select("doc", "component", "tokens", "copies")
    sizes = write_out(reps.groupBy("component").agg(F.count("*").alias("m"), F.sum("tokens").alias("t")).filter("m > 1").select(
        "component", F.greatest(F.ceil(F.col("m") / CELL_SETS), F.ceil(F.col("t") / CELL_TOKENS)).cast("int").alias("blocks")), "join-sizes")
    placed = write_out(reps.drop("tokens").join(sizes, "component").withColumn(
        "block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")), "join-placed")
    few = bounded(placed, MOST_IDS)
    mine = docs.join(placed if few is None else few, docs["doc_id"] == placed["doc"])

    def rows(*columns):
        for *own, text in zip(*columns):
            tokens = shingles(text)
            if len(tokens):
                yield (*own, tokens.view(np.int64))

    sets = arrow_pass(mine, ["doc", "component", "block", "blocks", "copies", "text"],
                      "doc long, component long, block int, blocks int, copies long, tokens array<long>", rows)
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    cells = sets.withColumn("cell", F.explode(cell)).select("component", "cell.*", "doc", "block", "copies", "tokens")
    return write_out(cells.groupBy("component", "i", "j").applyInArrow(
        _cell(counted), "doc long, links long" if counted else "a long, b long"), "join-all-links")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b), a < b, between representatives of different sets; and (doc, rep, copies) of each document with words.

    Documents with equal sets have one representative, the smallest, and are linked with each other and with all that it is linked
    with. See ``near_duplicates`` for odd rows.
    """
    docs = docs.select("doc_id", "text")
    members = _members(*_joined(docs))
    return _linked(docs, members, False), members.select("doc", "rep", "copies")


def link_counts(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` and n_links: the number of other documents that a document is linked with, exact copies among them."""
    docs = docs.select("doc_id", "text")
    result, prints = _joined(docs)
    members = _members(result, prints)
    others = _linked(docs, members, True).groupBy("doc").agg(F.sum("links").alias("links")).withColumnRenamed("doc", "rep")
    counts = members.join(write_out(others, "join-counts"), "rep", "left").select(
        "doc", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    counted = write_out(result.join(counts, "doc", "left"), "join-counted")
    return _told(docs, counted, F.coalesce("n_links", F.lit(0)).alias("n_links"))
