"""Shards by best-fit decreasing: whole groups enter the fullest bin that still takes them.

Groups of equal texts are packed twice. Tasks pack the groups of their hash range, largest
first, into units of a 1024th of a shard; then the units, whose number is bounded by the
number of shards and not by the data, are packed into the shards in the same way. Both find
the tightest bin in a balanced tree of remaining capacities.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.common import grouped, numbered, text_key
from faultweave.session import materialise

#: Units that fill one shard, groups that one task packs, and most tasks that pack.
UNITS_PER_SHARD = 1024
GROUPS_PER_PART = 50_000
MAX_PARTS = 8192


class Openings:
    """Bins by remaining capacity: a balanced two-level tree of sorted leaves."""

    LEAF = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.last: list[tuple[int, int]] = []

    def add(self, room: int, bin_id: int) -> None:
        entry = (room, bin_id)
        if not self.leaves:
            self.leaves, self.last = [[entry]], [entry]
            return
        at = min(bisect_left(self.last, entry), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, entry)
        if len(leaf) > 2 * self.LEAF:
            self.leaves[at : at + 1] = [leaf[: self.LEAF], leaf[self.LEAF :]]
            self.last[at : at + 1] = [leaf[self.LEAF - 1], leaf[-1]]
        else:
            self.last[at] = leaf[-1]

    def _take(self, at: int, place: int) -> tuple[int, int]:
        entry = self.leaves[at].pop(place)
        if self.leaves[at]:
            self.last[at] = self.leaves[at][-1]
        else:
            del self.leaves[at], self.last[at]
        return entry

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room of at least ``size``."""
        at = bisect_left(self.last, (size, -1))
        if at == len(self.leaves):
            return None
        return self._take(at, bisect_left(self.leaves[at], (size, -1)))

    def take_widest(self) -> tuple[int, int]:
        return self._take(len(self.leaves) - 1, -1)


def best_fit_decreasing(sizes: Iterable[int], capacity: int, bins: int | None = None) -> list[int]:
    """The bin of each size; sizes must come largest first.

    With ``bins`` there are exactly so many, and what fits in none enters the one with most
    room; without, a new bin opens. A size beyond the capacity fills a bin of its own.
    """
    open_bins, chosen, n = Openings(), [], 0
    for n in range(bins or 0):
        open_bins.add(capacity, n)
    n = bins or 0
    for size in sizes:
        found = open_bins.take_tightest(size)
        if found is None and bins:
            found = open_bins.take_widest()
        if found is None:
            found = (capacity, n)
            n += 1
        room, bin_id = found
        chosen.append(bin_id)
        open_bins.add(room - size, bin_id)
    return chosen


def _pack_parts(batches: Iterable[pa.RecordBatch], unit: int) -> Iterator[pa.RecordBatch]:
    for (part,), group in grouped(batches, ["part"]):
        bins = best_fit_decreasing(group.column("bytes").to_pylist(), unit)
        table = pa.table(
            {
                "key": group.column("key"),
                "chunk": group.column("chunk"),
                "bytes": group.column("bytes"),
                "part": pa.array([part] * len(bins), pa.int64()),
                "bin": pa.array(bins, pa.int64()),
            }
        )
        yield from table.to_batches()


def best_fit_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int | None = None, capacity: int | None = None
) -> DataFrame:
    """(id, ``size``, ``text_crc32``, ``shard``, ``slot``) of every row.

    ``size`` is the UTF-8 bytes of the text plus one. Give ``n_shards`` for so many shards of
    near equal bytes, or ``capacity`` for as few as can be of so many bytes. Rows with equal
    texts share a shard, unless together they exceed its capacity: then their rows are cut
    into as few even pieces as fit. Null texts form one group, empty ones another. Repeated
    rows take a slot each; slots run from 0 without gaps. An empty table gives no rows.
    """
    if (n_shards is None) == (capacity is None):
        raise ValueError("give the number of shards or their capacity")
    spark = docs.sparkSession
    size = (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("id"), text_key(text_col).alias("key"), size.alias("size"), crc.alias("text_crc32")
    )
    rows = materialise(rows, "sizes")
    groups = materialise(
        rows.groupBy("key").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n")), "groups"
    )
    n_groups, total = groups.agg(F.count(F.lit(1)), F.sum(F.col("size") * F.col("n"))).first()
    total = total or 0
    room = capacity or max(1, -(-total // n_shards))
    unit = max(1, room // UNITS_PER_SHARD)
    n_parts = min(MAX_PARTS, max(1, -(-n_groups // GROUPS_PER_PART)))

    # a group beyond the capacity is cut by rows
    per_chunk = F.greatest(F.lit(1), F.floor(F.lit(room) / F.col("size")))
    n_chunks = F.ceil(F.col("n") / per_chunk).cast("long")
    even = F.ceil(F.col("n") / F.col("n_chunks")).cast("long")
    groups = groups.withColumn("n_chunks", n_chunks).withColumn("per_chunk", even)
    chunks = groups.select(
        "key", "size", "n", "per_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("chunk")
    )
    in_chunk = F.least(F.col("per_chunk"), F.col("n") - F.col("chunk") * F.col("per_chunk"))
    chunks = chunks.select(
        "key",
        "chunk",
        (in_chunk * F.col("size")).alias("bytes"),
        F.pmod(F.xxhash64("key", "chunk"), F.lit(n_parts)).alias("part"),
    ).where("bytes > 0")
    packed = (
        chunks.repartition("part")
        .sortWithinPartitions("part", F.col("bytes").desc(), "key", "chunk")
        .mapInArrow(lambda b: _pack_parts(b, unit), "key string, chunk long, bytes long, part long, bin long")
    )
    packed = materialise(packed, "packed")

    # at most 2 * total / unit + n_parts units, so their number has a fixed bound per shard
    units = packed.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes")).collect()
    units.sort(key=lambda u: (-u.bytes, u.part, u.bin))
    shards = best_fit_decreasing([u.bytes for u in units], room, n_shards)
    placed = spark.createDataFrame(
        [(u.part, u.bin, s) for u, s in zip(units, shards)], "part long, bin long, shard int"
    )
    placed = packed.join(F.broadcast(placed), ["part", "bin"]).select("key", "chunk", "shard")

    cut = groups.where("n_chunks > 1").select("key", "per_chunk")
    whole = rows.join(cut, "key", "left_anti").withColumn("chunk", F.lit(0).cast("long"))
    parts = materialise(rows.join(cut, "key", "left_semi"), "cut")
    parts = numbered(parts, ["key"], "nth").join(cut, "key")
    parts = parts.withColumn("chunk", F.floor(F.col("nth") / F.col("per_chunk")).cast("long")).drop("nth", "per_chunk")
    rows = whole.unionByName(parts).join(placed, ["key", "chunk"])
    rows = materialise(rows.select("id", "size", "text_crc32", "shard"), "sharded")
    return numbered(rows, ["shard"], "slot").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
