"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are dealt into blocks. If every source with blocks left got its
share of each slot, by the exact weights, block ``j`` of a source would begin and end at two
moments; it is released in the slot of the first and due before the slot after the second.
Each slot takes, of the released blocks, the one due first. A block fits its window of that
fluid schedule whole, so such a choice always meets the deadlines, and every source is
always less than one block from its share, however many sources and slots there are.

All documents are used once. When a source runs out, a new phase starts, in which those
left share the slots by their weights; the windows run on through it.

The choices follow each other, so one task makes them, from the sizes of the sources alone:
one step for each block, with all sources but no document in memory.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.common import fresh, numbered, text_key
from faultweave.session import materialise

#: Slots of a cycle of ``schedule``, whose weights are multiples of its inverse.
CYCLE = 4096
#: What doubles may be off by, in slots.
EPSILON = 1e-6
#: Slots that are handed on at a time.
BATCH = 65_536
BLOCK_DOCS = 32


def shares(weights: Mapping[str, float], cycle: int = CYCLE) -> dict[str, int]:
    """Whole slots of a cycle for each source, at least one, by largest remainder."""
    total = sum(weights.values())
    exact = {s: Fraction(w) / Fraction(total) * cycle for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    spare = cycle - sum(slots.values())
    while spare > 0:
        for s in sorted(exact, key=lambda s: (slots[s] - exact[s], s))[:spare]:
            slots[s] += 1
        spare = cycle - sum(slots.values())
    while spare < 0:
        most = max(slots, key=lambda s: (slots[s] - exact[s] if slots[s] > 1 else -cycle, slots[s], s))
        slots[most] -= 1
        spare += 1
    return slots


def pfair_cycle(slots: Mapping[str, int], cycle: int = CYCLE) -> dict[str, list[int]]:
    """The slots of each source's blocks in one cycle, by earliest deadline first."""
    released: list[tuple[int, str, int]] = []
    waiting = [(0, s, 0) for s in sorted(slots)]
    heapq.heapify(waiting)
    taken: dict[str, list[int]] = {s: [] for s in slots}
    for now in range(cycle):
        while waiting and waiting[0][0] <= now:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(released, (deadline(j, slots[s], cycle), s, j))
        due, s, j = heapq.heappop(released)
        if due <= now:
            raise AssertionError(f"block {j} of {s} is late")
        taken[s].append(now)
        if j + 1 < slots[s]:
            heapq.heappush(waiting, (release(j + 1, slots[s], cycle), s, j + 1))
    return taken


def release(j: int, share: int, cycle: int = CYCLE) -> int:
    return j * cycle // share


def deadline(j: int, share: int, cycle: int = CYCLE) -> int:
    return -(-(j + 1) * cycle // share)


@dataclass(frozen=True)
class Phase:
    """What a source does in a phase: its blocks from ``block`` on, from slot ``slot`` on."""

    source: str
    phase: int
    block: int
    slot: int
    share: int
    places: list[int]

    def slot_of(self, block: int, cycle: int = CYCLE) -> int:
        turns, at = divmod(block - self.block, self.share)
        return self.slot + turns * cycle + self.places[at]


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float], cycle: int = CYCLE) -> list[Phase]:
    """The phases of a mixture whose cycles repeat, by weights rounded to whole slots of a cycle.

    ``mix`` keeps the weights as they are; see ``walk``.
    """
    done = {s: 0 for s, n in blocks.items() if n}
    phases: list[Phase] = []
    start = 0
    number = 0
    while done:
        slots = shares({s: weights[s] for s in done}, cycle)
        places = pfair_cycle(slots, cycle)
        now = {s: Phase(s, number, done[s], start, slots[s], places[s]) for s in done}
        phases += now.values()
        # the phase ends before the first slot whose block does not exist
        end = min(now[s].slot_of(blocks[s], cycle) for s in done)
        for s in list(done):
            turns, rest = divmod(end - start, cycle)
            done[s] += turns * slots[s] + sum(1 for p in places[s] if p < rest)
            if done[s] >= blocks[s]:
                del done[s]
        start, number = end, number + 1
    return phases


def walk(
    sizes: Sequence[int], weights: Sequence[float], block_docs: int = BLOCK_DOCS
) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(source, block, phase, release, deadline, slot, first position) slot by slot.

    ``sizes`` are documents, at least one each. Times are by ``t(v) = sum(min(w * v, blocks))``: at
    the virtual time ``v`` a source has had ``w * v`` blocks, or all.
    """
    if not len(sizes):
        return
    blocks = -(-np.asarray(sizes, "i8") // block_docs)
    shares = np.asarray(weights, "f8")
    shares = shares / math.fsum(shares)
    ends = blocks / shares
    order = np.argsort(ends, kind="stable")
    # from the k-th end on: blocks of ended sources, weight of the others
    had = np.concatenate([[0], np.cumsum(blocks[order])]).tolist()
    left = np.append(np.cumsum(shares[order][::-1])[::-1], 0.0).tolist()
    by_end = ends[order].tolist()

    def time(v: float) -> float:
        k = bisect_right(by_end, v)
        return had[k] + v * left[k]

    moments = [time(v) for v in by_end]
    phase_ends = [t for t, after in zip(moments, [*moments[1:], math.inf]) if after - t > EPSILON]
    blocks, shares = blocks.tolist(), shares.tolist()

    def released(s: int, j: int) -> int:
        return int(time(j / shares[s]) + EPSILON)

    waiting = [(0, s, 0) for s in range(len(blocks))]
    ready: list[tuple[int, int, int, int]] = []
    phase = position = 0
    for now in range(sum(blocks)):
        while waiting and waiting[0][0] <= now:
            at, s, j = heappop(waiting)
            heappush(ready, (math.ceil(time((j + 1) / shares[s]) - EPSILON), s, j, at))
        due, s, j, at = heappop(ready)
        if due <= now:
            raise AssertionError(f"block {j} of source {s} is late")
        # a slot in which a source ends belongs to the next phase
        while phase + 1 < len(phase_ends) and phase_ends[phase] < now + 1 - EPSILON:
            phase += 1
        yield s, j, phase, at, due, now, position
        position += min(block_docs, sizes[s] - j * block_docs)
        if j + 1 < blocks[s]:
            heappush(waiting, (released(s, j + 1), s, j + 1))


def _slots(sources: DataFrame, block_docs: int) -> DataFrame:
    """``walk`` over (``name``, ``n``, ``weight``), in one task."""
    out = pa.schema(
        [("block", pa.int64()), ("phase", pa.int32())]
        + [(n, pa.int64()) for n in ("release", "deadline", "slot", "first")]
    )

    def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        rows = rows.sort_by("name")  # tasks that are repeated give the same slots
        names, sizes = rows["name"].combine_chunks(), rows["n"].to_pylist()
        steps = walk(sizes, rows["weight"].to_pylist(), block_docs)
        while part := list(islice(steps, BATCH)):
            source, *values = zip(*part)
            arrays = [pa.array(list(v), f.type) for v, f in zip(values, out)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(source)), *arrays], ["name", *out.names])

    def one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from walked(held)

    return sources.repartition(1).mapInArrow(
        one, "name string, block long, phase int, release long, deadline long, slot long, first long"
    )


def mix(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.7,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """(id, ``key``, ``source``, ``block``, ``phase``, ``release``, ``deadline``, ``slot``, ``position``).

    ``weights`` are positive, by source name, and need only be given in proportion; every other
    source weighs as much as the least of them. Without weights a source of n documents weighs
    ``n ** temperature``, which lifts small sources. A null source is a source of its own,
    written as null. Within a source documents come in the order of hash buckets. Repeated
    rows take a place each; ``position`` runs from 0 without gaps; ``key`` is the text's key.
    """
    spark = docs.sparkSession
    if weights and not all(0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive")
    # the marks keep a null apart from a source of any name
    name = F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col)))
    rows = materialise(docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), name.alias("name")), "rows")
    sources = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    if weights:
        given = spark.createDataFrame([(f"1{s}", float(w)) for s, w in weights.items()], "name string, weight double")
        least = F.lit(float(min(weights.values())))
        sources = sources.join(given, "name", "left").withColumn("weight", F.coalesce("weight", least))
    else:
        sources = sources.withColumn("weight", F.pow("n", F.lit(temperature)))
    slots = materialise(_slots(materialise(sources, "sources"), block_docs), "slots")

    dealt = numbered(rows, ["name"], "nth")
    dealt = dealt.withColumn("block", F.floor(F.col("nth") / block_docs).cast("long")).join(slots, ["name", "block"])
    source = F.when(F.substring("name", 1, 1) == "0", F.lit(None)).otherwise(F.expr("substring(name, 2)"))
    return dealt.select(
        F.col("id").alias(id_col),
        "key",
        source.alias("source"),
        "block",
        "phase",
        "release",
        "deadline",
        "slot",
        (F.col("first") + F.col("nth") % block_docs).alias("position"),
    )


def places(docs: DataFrame, **options) -> DataFrame:
    """(``doc_id``, ``key``, ``source``, ``position``): the first place of rows equal in these."""
    return mix(docs, **options).groupBy("doc_id", "key", "source").agg(F.min("position").alias("position"))


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """All rows of ``docs`` in the order of the mixture: files, and rows in them, follow it.

    Rows equal in doc_id, text and source stay together at the first of their places.
    """
    key, place = fresh(docs, "key"), fresh(docs, "place")
    first = places(docs, **options)
    keyed = docs.withColumn(key, text_key("text"))
    same = (
        keyed["doc_id"].eqNullSafe(first["doc_id"])
        & (keyed[key] == first["key"])
        & keyed["source"].eqNullSafe(first["source"])
    )
    placed = keyed.join(first, same).select(*[keyed[f"`{c}`"] for c in docs.columns], first["position"].alias(place))
    return placed.repartitionByRange(place).sortWithinPartitions(place).drop(place)
