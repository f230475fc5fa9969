"""Sharding: indivisible groups, largest first, go to the shard with the tightest room that still holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import rank_within, write_out


class RoomTree:
    """Open shards in a balanced search tree (a treap) ordered by (room, shard)."""

    def __init__(self):
        self.root = None  # node: [key, priority, left, right]

    @staticmethod
    def _priority(key):
        return hash((key, 0x9E3779B97F4A7C15))

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, shard: int) -> None:
        left, right = self._split(self.root, (room, shard))
        node = [(room, shard), self._priority((room, shard)), None, None]
        self.root = self._merge(self._merge(left, node), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (room, shard) with the least room of at least ``size``."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        key = node[0]
        _, rest = self._split(right, (key[0], key[1] + 1))
        self.root = self._merge(left, rest)
        return key


def best_fit_decreasing(items: list[tuple[int, object]], capacity: int, most: int | None = None) -> dict | None:
    """Shard number of each item, for (size, key) ``items``; None if more than ``most`` shards of ``capacity`` are needed."""
    tree, placed, opened = RoomTree(), {}, 0
    for size, key in items:
        found = tree.take_tightest(size)
        if found is None:
            if size > capacity or opened == most:
                return None
            found, opened = (capacity, opened), opened + 1
        placed[key] = found[1]
        tree.add(found[0] - size, found[1])
    return placed


def smallest_capacity(items: list[tuple[int, object]], shards: int, steps: int = 14) -> dict:
    """Placement into at most ``shards`` shards with the smallest capacity that best fit decreasing manages (to 1 in 10 000)."""
    items = sorted(items, key=lambda x: (-x[0], str(x[1])))
    total = sum(s for s, _ in items)
    low = max(-(-total // shards), items[0][0] if items else 1, 1)
    best = best_fit_decreasing(items, low, shards)
    if best is not None:
        return best
    high = low
    while best is None:
        high *= 2
        best = best_fit_decreasing(items, high, shards)
    for _ in range(steps):
        if high - low <= max(1, total // shards // 20_000):
            break
        middle = (low + high) // 2
        found = best_fit_decreasing(items, middle, shards)
        if found is None:
            low = middle
        else:
            best, high = found, middle
    return best


def shard_documents(docs: DataFrame, shards: int = 16, parts: int = 1024, lots: int = 1 << 14) -> DataFrame:
    """Deal documents into ``shards`` shards of near equal bytes; documents with equal texts stay together.

    A group is indivisible. Groups of at least 1 / ``parts`` of a shard are placed one by one: there are at most
    ``shards * parts`` of them, whatever the input. All smaller groups are hashed into ``lots`` lots, and each lot is placed as one
    item, so the plan on the driver is bounded and the rest is joined to it.

    Columns: doc_id, size (UTF-8 bytes + 1), text_crc32, law ('bytes'), shard, slot (gapless in each shard), grown_shard (null).
    A null text counts as empty bytes but forms a group of its own. Null doc_ids and repeated rows are rows like any other.
    No rows give no rows. Other columns are ignored.
    """
    rows = write_out(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), "text").alias("grp")), "shard-rows")
    groups = write_out(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = max(2, -(-total // (shards * parts)))
    spark = docs.sparkSession
    lot = F.pmod(F.xxhash64("grp"), F.lit(lots)).cast("int")
    large = [(r.bytes, ("g", r.grp)) for r in groups.filter(F.col("bytes") >= least).collect()]
    small = [(r.bytes, ("l", r.lot)) for r in
             groups.filter(F.col("bytes") < least).groupBy(lot.alias("lot")).agg(F.sum("bytes").alias("bytes")).collect()]
    plan = smallest_capacity(large + small, shards)
    by_group = spark.createDataFrame([(k, s) for (kind, k), s in plan.items() if kind == "g"], "g long, g_shard int")
    by_lot = spark.createDataFrame([(k, s) for (kind, k), s in plan.items() if kind == "l"], "l int, l_shard int")
    placed = (rows.join(F.broadcast(by_group), F.col("grp") == F.col("g"), "left")
              .join(F.broadcast(by_lot), lot == F.col("l"), "left")
              .select("doc_id", "size", "text_crc32", F.coalesce("g_shard", "l_shard").alias("shard")))
    placed = write_out(placed, "shard-placed")
    ranked = rank_within(placed, "shard", [F.col("doc_id"), F.col("text_crc32")], ["doc_id", "text_crc32"])
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
