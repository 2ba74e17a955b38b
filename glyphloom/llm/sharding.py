"""Sharding by a minimax contiguous partition of atomic groups.

Rows with equal texts are one atomic group. Groups stand in the order of the SHA-256 of
their text, which mixes sources evenly; shards are runs of that order. The smallest
capacity with which a greedy fill needs no more than the wanted number of shards is
found by binary search, and the cuts are those of that greedy fill.

The driver never sees the groups: it sees, round by round, at most ``marks`` buckets of
positions with the first and last group end in each. A lookup that falls between the two
is a range, so a greedy fill gives a lower and an upper answer; where they disagree, the
next round looks closer at just the places where cuts can fall, until all is exact.

Null text: size 1 like the empty text, but a group of its own. Every row counts, so
repeated rows get a slot each. An empty table gives no rows. A table with fewer groups
than shards leaves the last shards empty. Columns of the input other than the id and
the text are not returned, so their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _accumulated(rows: DataFrame) -> DataFrame:
    """Sorts rows over partitions; adds the partition, the row's number and the bytes up to and with it there, and whether it is its group's last row there."""
    # Ties in (group, id) are equal rows, so their order does not matter.
    parted = rows.repartitionByRange("grp", "id").sortWithinPartitions("grp", "id").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, held = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            held, table = table.slice(table.num_rows - 1), table.slice(0, table.num_rows)
            groups = table["grp"].to_pylist()
            rest = table.num_rows - 1
            if rest:
                sizes = table["size"].to_numpy()[:rest]
                ends = np.array([groups[i] != groups[i + 1] for i in range(rest)])
                sums = total + np.cumsum(sizes)
                out = table.slice(0, rest).append_column("n", pa.array(n + 1 + np.arange(rest))).append_column("upto", pa.array(sums)).append_column("last", pa.array(ends))
                n, total = n + rest, int(sums[-1])
                yield from out.combine_chunks().to_batches()
        if held is not None:
            total += held["size"][0].as_py()
            yield from held.append_column("n", pa.array([n + 1])).append_column("upto", pa.array([total])).append_column("last", pa.array([True])).combine_chunks().to_batches()

    return parted.mapInArrow(run, "id long, grp binary, size long, text_crc32 long, part int, n long, upto long, last boolean")


class _Marks:
    """What is known of the group ends: buckets with their first and last end, in order."""

    def __init__(self, total: int, largest: int):
        self.total, self.least = total, largest
        self.first, self.last = [], []

    def set(self, first: list[int], last: list[int]) -> None:
        self.first, self.last = first, last

    def at_most(self, x: int) -> tuple[int, int]:
        """The largest group end not above x: bounds of it, equal if it is known."""
        i = bisect_right(self.first, x) - 1
        if i < 0:
            return 0, 0
        return (self.last[i],) * 2 if self.last[i] <= x else (self.first[i], x)

    def cuts(self, capacity: int, shards: int, upper: bool) -> list[int]:
        """The ends of a greedy fill's shards, from bounds below or above."""
        out, at = [], 0
        while len(out) < shards and at < self.total:
            if at + capacity >= self.total:
                at = self.total
            else:
                at = self.at_most(at + capacity)[upper]
            out.append(at)
        return out

    def fits(self, capacity: int, shards: int, upper: bool) -> bool:
        return (c := self.cuts(capacity, shards, upper)) == [] or c[-1] == self.total


def _smallest(low: int, high: int, fits) -> int:
    """The smallest capacity in (low, high] that fits; high does."""
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int, marks: int = 4096) -> list[int]:
    """The ends of the shards, where ``ends`` has the group ends in a column ``end``."""
    if not total:
        return []
    marks = max(marks, 64 * shards)  # fewer could leave the places of the cuts as wide as they were
    known = _Marks(total, largest)
    low, high = max(largest, -(-total // shards)) - 1, total
    windows = [(0, total)]
    while True:
        width = max(1, -(-sum(b - a for a, b in windows) // marks))
        # end in (a, b] of a window; its bucket counts on from those of the windows before.
        bucket, base = F.lit(None).cast("long"), 0
        for a, b in windows:
            bucket = F.coalesce(bucket, F.when((F.col("end") > a) & (F.col("end") <= b), F.lit(base) + F.floor((F.col("end") - a - 1) / width)))
            base += -(-(b - a) // width)
        inside = " or ".join(f"(end > {a} and end <= {b})" for a, b in windows)
        found = sorted((r["first"], r["last"]) for r in ends.where(inside).groupBy(bucket.alias("bucket")).agg(F.min("end").alias("first"), F.max("end").alias("last")).collect())
        known.set([f for f, _ in found], [x for _, x in found])
        high = _smallest(low, high, lambda c: known.fits(c, shards, False))
        low = min(high - 1, _smallest(low, high, lambda c: known.fits(c, shards, True)) - 1)
        below, above = known.cuts(low + 1, shards, False), known.cuts(high, shards, True)
        if high - low == 1 and known.cuts(high, shards, False) == above:
            return above
        # A cut of any capacity between lies from the lower answer for the lowest to the upper answer for the highest.
        below += [total] * (len(above) - len(below))
        spans = sorted((max(0, a - 1), b) for a, b in zip(below, above) if a < total)
        windows = []
        for a, b in spans:
            if windows and a <= windows[-1][1]:
                windows[-1] = (windows[-1][0], max(b, windows[-1][1]))
            else:
                windows.append((a, b))


def shard(docs: DataFrame, shards: int = 16, id: str = "doc_id", text: str = "text", marks: int = 4096) -> DataFrame:
    """A row for each document: its id, size, text_crc32, shard, and slot in the shard."""
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id).cast("long").alias("id"),
        F.when(F.col(text).isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(t, 256))).alias("grp"),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(t).alias("text_crc32"),
    )
    rows = staged(_accumulated(rows), "shard-rows")
    parts = sorted(
        rows.groupBy("part").agg(F.min("grp").alias("first"), F.max("grp").alias("final"), F.max("n").alias("n"), F.max("upto").alias("upto")).collect(), key=lambda r: r["part"]
    )  # a row for each partition
    start_n, start_b, at, offsets = 0, 0, 0, []
    for i, p in enumerate(parts):
        goes_on = i + 1 < len(parts) and parts[i + 1]["first"] == p["final"]
        offsets.append((p["part"], start_n, start_b, p["n"] if goes_on else -1))
        start_n, start_b = start_n + p["n"], start_b + p["upto"]
    spark = docs.sparkSession
    offsets = F.broadcast(spark.createDataFrame(offsets, "part int, before_n long, before_b long, no_end long"))
    placed = rows.join(offsets, "part").select("id", "size", "text_crc32", (F.col("n") + F.col("before_n")).alias("n"), (F.col("upto") + F.col("before_b")).alias("end"), (F.col("last") & (F.col("n") != F.col("no_end"))).alias("last"))
    ends = placed.where("last").select("end", "n")
    # The largest group: the largest distance of neighbouring ends; by partial sums, as a group may span partitions.
    largest = rows.groupBy("grp").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] or 0
    cuts = minimax_cuts(ends, start_b, largest, shards, marks)
    firsts = {r["end"]: r["n"] for r in ends.where(F.col("end").isin(cuts)).collect()} if cuts else {}
    bounds = [(0, 0)] + [(c, firsts[c]) for c in cuts]
    shard_of, first = F.lit(0), F.lit(0).cast("long")
    for k, (cut, n) in enumerate(bounds[1:-1], 1):
        shard_of = F.when(F.col("end") > cut, F.lit(k)).otherwise(shard_of)
        first = F.when(F.col("end") > cut, F.lit(n).cast("long")).otherwise(first)
    return placed.select(F.col("id").alias(id), "size", "text_crc32", shard_of.cast("int").alias("shard"), (F.col("n") - 1 - first).alias("slot"))
