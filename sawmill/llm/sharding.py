"""Minimax contiguous partition of documents into shards.

Documents with equal texts are one atomic group; groups are in the order of a 60-bit hash of the text. The partition with
the smallest possible largest shard is sought: a binary search over the capacity, each checked greedily over the ordered sizes.

The driver never sees all groups. It holds an ordered list of intervals of the hash with their sizes, at first 2**FIRST of
them. Taking intervals as indivisible gives a capacity that is surely feasible, taking them as divisible (but those of one group) one that
is surely a lower bound. While these differ, only the intervals that a cut can fall into under capacities between the two
are split in 2**STEP, each by its own width, by another aggregate; so the answer is that over all groups, and what is held stays small.

Within a shard rows are numbered in the order of the hash and then of doc_id.

Defined cases: null text has no bytes and is equal to the empty text in its group; size is the bytes of the text plus 1; a null doc_id
is placed like any other; repeated rows are placed each, together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.llm.common import ranked, saved

BITS, FIRST, STEP = 60, 14, 8


@dataclass(frozen=True)
class Interval:
    """Hashes from low to low + width - 1; size: of all its documents; single: all have one hash."""

    low: int
    width: int
    size: int
    single: bool


def _greedy(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where each shard ends (as a count of sizes), each taking as much as fits, or None if it takes more shards."""
    ends, load, most = [], 0, max(sizes, default=0)
    if most > capacity:
        return None
    for i, s in enumerate(sizes):
        if load + s > capacity:
            ends.append(i)
            load = 0
            if len(ends) == shards:
                return None
        load += s
    return [*ends, len(sizes)]


def _least(feasible, low: int, high: int) -> int:
    """The smallest feasible capacity of low to high; high is feasible."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def _loose(intervals: list[Interval], capacity: int, shards: int) -> list[int] | None:
    """The total size before each cut if intervals of many groups could be cut anywhere, or None."""
    cuts, total, load = [], 0, 0
    for x in intervals:
        left = x.size
        if x.single:
            if left > capacity:
                return None
            if load + left > capacity:
                cuts.append(total)
                load = 0
            load += left
            total += left
        else:
            while load + left > capacity:
                total += capacity - load
                left -= capacity - load
                cuts.append(total)
                load = 0
                if len(cuts) >= shards:
                    return None
            load += left
            total += left
        if len(cuts) >= shards:
            return None
    return [*cuts, *[total] * (shards - 1 - len(cuts))]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, first hash of each shard after the first) for groups(key, size), keys of BITS bits."""

    def summed(rows: DataFrame, width: int) -> list[Interval]:
        """Intervals of this width, a power of two."""
        wide, shift = width, width.bit_length() - 1
        found = rows.groupBy(F.shiftright("key", shift).alias("at")).agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("single"), F.min("key").alias("low")).collect()
        return [Interval(r["low"] if r["single"] else r["at"] * wide, 1 if r["single"] else wide, r["size"], r["single"]) for r in found]

    intervals = sorted(summed(groups, 1 << (BITS - FIRST)), key=lambda x: x.low)
    while True:
        total = sum(x.size for x in intervals)
        sizes = [x.size for x in intervals]
        high = _least(lambda c: _greedy(sizes, c, shards) is not None, max(-(-total // shards), max(sizes, default=0)), max(total, 1))
        low = _least(lambda c: _loose(intervals, c, shards) is not None, -(-total // shards), high)
        if low >= high:
            break
        # a cut of any capacity between lies between those of the lowest and of the highest
        before, n = [], 0
        for x in intervals:
            before.append(n)
            n += x.size
        first, last = _loose(intervals, low, shards), [before[e] if e < len(before) else total for e in _greedy(sizes, high, shards)[:-1]]
        last += [total] * (shards - 1 - len(last))
        split = set()
        for a, b in zip(first, last):
            i, j = (max(0, bisect.bisect_right(before, v) - 1) for v in (min(a, b), max(a, b)))
            split.update(k for k in range(max(0, i - 1), min(len(intervals), j + 2)) if not intervals[k].single)
        if not split:
            split = {k for k, x in enumerate(intervals) if not x.single}
        done = [intervals[k] for k in range(len(intervals)) if k not in split]
        for width in {intervals[k].width for k in split}:
            joined: list[list[int]] = []
            for low_, high_ in sorted((x.low, x.low + x.width) for x in (intervals[k] for k in split) if x.width == width):
                if joined and joined[-1][1] == low_:
                    joined[-1][1] = high_
                else:
                    joined.append([low_, high_])
            near = groups.where(" or ".join(f"key between {a} and {b - 1}" for a, b in joined))
            done += summed(near, max(1, width >> STEP))
        intervals = sorted(done, key=lambda x: x.low)
    ends = _greedy([x.size for x in intervals], high, shards)
    return high, [intervals[e].low if e < len(intervals) else 1 << BITS for e in ends[:-1]] + [1 << BITS] * (shards - len(ends))


def shards_by_bytes(documents: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of documents(doc_id, text, ...)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long").alias("key"),
    )
    rows = saved(rows, "sizes")
    _, cuts = minimax_cuts(rows, shards)
    shard = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    order = ["key", "doc_id"]
    placed = ranked(rows.withColumn("shard", shard.cast("int")).repartitionByRange(*order).sortWithinPartitions(*order), "shard", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
