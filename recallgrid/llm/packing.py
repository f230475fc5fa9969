"""Best-fit packing planned over the histogram of lengths."""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.bpe import word_ids
from recallgrid.llm.common import arrow_pass, rank_within, write_out

#: Closes every document.
END_ID = 1


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Best fit, longest first, over counts: runs (length, first_rank, n, sequence, per, offset), and the number of sequences.

    A run seats n pieces of one length, ``per`` in each sequence from ``sequence`` on, one after the other from ``offset``. Sequences that are
    filled alike stay together as one group, so work and runs depend on the number of lengths, not of pieces: each length
    splits at most one group, into three.
    """
    runs, opened = [], 0
    groups: list[tuple[int, int, int]] = []  # (room, first sequence, number), sorted
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        at = bisect.bisect_left(groups, (length, -1, -1))
        changed, keep = [], groups[:at]
        while left:
            if at < len(groups):
                room, first, n = groups[at]
                at += 1
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, full * per, first, per, capacity - room))
                changed.append((room - per * length, first, full))
                rank, left = rank + full * per, left - full * per
            if full < n:
                if left:
                    runs.append((length, rank, left, first + full, left, capacity - room))
                    changed.append((room - left * length, first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    changed.append((room, first + full, n - full))
        groups = sorted(g for g in keep + changed + groups[at:])
    return runs, opened


def _piece_rows(path: str, capacity: int):
    end = struct.pack("<I", END_ID)

    def rows(docs, texts) -> Iterator[tuple]:
        for doc, ids in zip(docs, word_ids([t or "" for t in texts], path)):
            ids += end
            for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[start: start + 4 * capacity]
                yield doc, piece, start // 4, len(own) // 4, zlib.crc32(own)

    return rows


def token_pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end id, cut only where longer than ``capacity``."""
    return arrow_pass(docs, ["doc_id", "text"], "doc_id long, piece int, start long, length long, ids_crc32 long", _piece_rows(path, capacity))


def pack(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """Seat every document's tokens in sequences of at most ``capacity``, as few as best fit decreasing needs.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver. Pieces are ranked within their length and take the
    planned seat of that rank. Columns: those of ``token_pieces``, sequence_id, offset (gapless from 0 in each sequence).
    Null texts are empty and take the end id only; null doc_ids and repeated rows are seated like any row; no rows give no rows.
    """
    pieces = write_out(token_pieces(docs, path, capacity), "pack-pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    ranked = rank_within(pieces, "length", [F.col("doc_id"), F.col("piece")], ["doc_id", "piece"])
    # Runs of a length follow each other by rank: an array of their first ranks finds a piece's run.
    by_length: dict[int, list] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(tuple(run))
    seats = docs.sparkSession.createDataFrame(
        [(length, bisect_key, *run) for length, own in by_length.items() for bisect_key, run in enumerate(own)],
        "s_length long, run int, first_rank long, n long, sequence long, per long, room_at long")
    seat = F.col("rank") - F.col("first_rank")
    joined = ranked.join(F.broadcast(seats), (F.col("length") == F.col("s_length")) & (seat >= 0) & (seat < F.col("n")))
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(seat / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("room_at") + F.pmod(seat, F.col("per")) * F.col("length")).cast("long").alias("offset"))
