"""Minimax contiguous partition of a corpus into shards of nearly equal bytes, with DataFrame operations alone.

The atomic groups are the equal texts, ordered by the hash of their text; the largest of them, as many as there are
shards, come first, since only they can be larger than what the other shards hold. Such a group has a shard alone, and the
smallest capacity is sought that a greedy pass from left to right fits the rest into.

The groups are never listed in one place. The search begins with the sums of ``RANGES`` ranges of the hash. From these, a
binary search gives a capacity that is possible (cuts between ranges) and one that no partition can beat (cuts anywhere
inside ranges). Between the two, every cut can only lie in a short stretch; only the ranges in those stretches are split
into finer ones, and so on until they are single groups. Then the two capacities meet, and the partition is the minimax
over all groups. What the driver sees are the sums of a bounded number of ranges.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.llm.common import read_table, settle, text_or_empty

HASH_BITS = 60
RANGE_BITS, FINER_BITS, MOST_OPEN = 15, 7, 512
CHUNK_ROWS = 1000


class Range(NamedTuple):
    """Groups with a hash from ``first`` up to the next range's; ``groups`` of them, ``size`` bytes, the largest ``most``."""

    first: int
    bits: int
    size: int
    groups: int
    most: int


class Line:
    """Ranges in order behind the heavy groups, with running sums for the greedy passes."""

    def __init__(self, heavy: list[int], ranges: list[Range]):
        self.size = [*heavy, *(r.size for r in ranges)]
        self.most = [*heavy, *(r.most for r in ranges)]
        self.atomic = [True] * len(heavy) + [r.groups == 1 for r in ranges]
        self.ends = [0]
        for x in self.size:
            self.ends.append(self.ends[-1] + x)
        self.total = self.ends[-1]

    def alone(self, capacity: int) -> int:
        """Heavy groups above the capacity, which come first; each has a shard of its own."""
        n = 0
        while n < len(self.size) and self.atomic[n] and self.size[n] > capacity:
            n += 1
        return n

    def item(self, place: int) -> int:
        """The item that holds the byte after ``place``."""
        return min(bisect_right(self.ends, place) - 1, len(self.size) - 1)

    def whole(self, place: int, capacity: int) -> int:
        """Where a greedy shard from ``place`` ends if it may only be cut between items; ``place`` itself if nothing fits."""
        return self.ends[bisect_right(self.ends, place + capacity) - 1]

    def free(self, place: int, capacity: int) -> int:
        """Where it ends at most: it may be cut anywhere inside an item of several groups."""
        end = min(place + capacity, self.total)
        at = self.item(end)
        return max(self.ends[at], place) if end < self.total and self.atomic[at] else end

    def sure(self, place: int, capacity: int) -> int:
        """Where it ends at least: short of the capacity by less than one group."""
        end = min(place + capacity, self.total)
        at = self.item(end)
        return end if end >= self.total else max(place, self.ends[at], end - self.most[at] if not self.atomic[at] else 0)

    def after(self, place: int, capacity: int, step: Callable[[int, int], int]) -> int:
        """The end of the shard that begins at ``place``, be it a lone group or a greedy fill."""
        at = self.item(place)
        return self.ends[at + 1] if at < self.alone(capacity) else step(place, capacity)

    def cuts(self, capacity: int, shards: int, step: Callable[[int, int], int]) -> list[int] | None:
        """Ends of the shards behind the lone groups, or None if ``shards`` do not suffice."""
        n = self.alone(capacity)
        place, found = self.ends[n], []
        while place < self.total:
            end = step(place, capacity)
            if end <= place or n + len(found) >= shards:
                return None
            found.append(end)
            place = end
        return found

    def least(self, shards: int, step: Callable[[int, int], int], low: int) -> int:
        """The smallest capacity from ``low`` on with which ``shards`` suffice."""
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.cuts(mid, shards, step) is None else (low, mid)
        return low


def _ranges(groups: DataFrame, bits: int, within: list[int] | None = None, outer: int = 0) -> list[Range]:
    """Sums of the ranges of ``bits`` bits; with ``within``, only of those inside these ranges of ``outer`` bits."""
    if within is not None:
        groups = groups.where(F.shiftright("h", HASH_BITS - outer).isin([first >> (HASH_BITS - outer) for first in within]))
    first = F.shiftleft(F.shiftright("h", HASH_BITS - bits), HASH_BITS - bits).alias("first")
    rows = groups.groupBy(first).agg(F.sum("bytes").alias("size"), F.count("*").alias("groups"), F.max("bytes").alias("most")).collect()
    return sorted(Range(r["first"], bits, r["size"], r["groups"], r["most"]) for r in rows)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Shards of the heaviest groups by hash, and for the others (hash, shard) wherever another shard begins.

    ``groups`` holds (h, bytes), one row a group. The largest shard is the smallest that any contiguous partition has,
    where a group above the others' capacity has a shard alone. Fewer groups than shards leave the last shards empty.
    """
    heavy = groups.orderBy(F.desc("bytes"), "h").limit(shards).collect()
    rest = groups.where(~F.col("h").isin([r["h"] for r in heavy])) if heavy else groups
    sizes = [r["bytes"] for r in heavy]
    ranges = _ranges(rest, RANGE_BITS)
    while True:
        line = Line(sizes, ranges)
        low = line.least(shards, line.free, max((r.most for r in ranges), default=0))
        high = line.least(shards, line.whole, low)
        if low == high:
            break
        # The cuts of the best capacity lie between the surest ones with ``low`` and the freest ones with ``high``.
        open_: set[int] = set()
        near = far = 0
        for _ in range(shards):
            near, far = line.after(near, low, line.sure), line.after(far, high, line.free)
            open_.update(i - len(sizes) for i in range(line.item(near), line.item(far) + 1) if not line.atomic[i])
        bits = min(ranges[i].bits for i in open_)
        now = set(sorted((i for i in open_ if ranges[i].bits == bits), key=lambda i: -ranges[i].size)[:MOST_OPEN])
        finer = _ranges(rest, min(HASH_BITS, bits + FINER_BITS), [ranges[i].first for i in now], bits)
        ranges = sorted([r for i, r in enumerate(ranges) if i not in now] + finer)
    return _numbered(line, [r["h"] for r in heavy], ranges, high, shards)


def _numbered(line: Line, heavy: list[int], ranges: list[Range], capacity: int, shards: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Items to shards: lone groups by their place, the others by the greedy cuts with ``capacity``."""
    alone = line.alone(capacity)
    ends = line.cuts(capacity, shards, line.whole) or []
    # Shards that the greedy pass did not need halve the largest ones that can be cut.
    for _ in range(shards - alone - len(ends)):
        halves = []
        for a, b in zip([line.ends[alone], *ends], ends):
            i, j = bisect_right(line.ends, a) - 1, bisect_right(line.ends, b) - 1
            if j - i > 1:
                halves.append((a - b, min(line.ends[i + 1 : j], key=lambda x: abs(2 * x - a - b))))
        if not halves:
            break
        ends = sorted([*ends, min(halves)[1]])
    of_heavy, begins = {}, []
    for i in range(len(line.size)):
        shard = i if i < alone else alone + bisect_right(ends, line.ends[i])
        if i < len(heavy):
            of_heavy[heavy[i]] = shard
        elif not begins or begins[-1][1] != shard:
            begins.append((ranges[i - len(heavy)].first, shard))
    return of_heavy, begins


def shard_documents(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``).

    Size is the UTF-8 bytes of the text plus 16; null text counts none. Equal texts share a shard; slots run from 0
    without a gap. A null id is placed like any other, repeated rows each get a slot, an empty table gives an empty
    result, and other columns are not read. Very long texts are groups like others. Different texts that share the first
    ``HASH_BITS`` bits of their hash are one group.
    """
    text = text_or_empty(text_col)
    rows = settle(
        df.select(
            F.col(f"`{id_col}`").alias("_ls_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = settle(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    of_heavy, begins = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for first, number in begins:
        shard = F.when(F.col("h") >= first, number).otherwise(shard)
    for h, number in of_heavy.items():
        shard = F.when(F.col("h") == h, number).otherwise(shard)
    # Rows of a shard are numbered chunk by chunk; chunks follow a hash of the row, so a hot text or id is spread over all.
    per_shard = {r["shard"]: r["n"] for r in groups.withColumn("shard", shard).groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    chunks = F.element_at(F.array(*[F.lit(max(1, -(-per_shard.get(s, 0) // CHUNK_ROWS))) for s in range(shards)]), F.col("shard") + 1)
    placed = settle(rows.withColumn("shard", shard.cast("int")).withColumn("chunk", F.pmod(F.xxhash64(F.lit("slot"), "row"), chunks.cast("long"))))
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = settle(
        placed.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    nth = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("row"))
    return (
        placed.withColumn("nth", nth)
        .join(offsets, ["shard", "chunk"])
        .select(
            F.col("_ls_id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
