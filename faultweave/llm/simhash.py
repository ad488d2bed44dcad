"""Near-duplicates by SimHash fingerprints, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 * reach`` bits share a value that differs from
either in at most ``reach``. So each fingerprint emits all such variants, and those that
emit one variant are linked. Variants that begin with the same bits belong to one task: a
fingerprint is sent once to every beginning that its variants can have, and the task that
owns the beginning makes the variants themselves. That is the shuffle on variants with
some 17 times fewer rows, and it stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.llm.common import components, fresh, grouped, smallest_reachable, text_key
from faultweave.session import materialise

SEED = 42
BITS = 64
#: Shingles whose hashes are in memory at a time.
CHUNK = 200_000
#: Variants that one beginning has on average, and that a task makes at a time.
VARIANTS_PER_KEY = 1 << 20
VARIANTS_AT_A_TIME = 1 << 22


def _hashes(words: list[bytes], width: int) -> Iterator[int]:
    if len(words) <= width:
        yield xxhash.xxh64_intdigest(b" ".join(words), SEED)
        return
    joined = b" ".join(words)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    start = 0
    for i in range(width - 1, len(words)):
        yield xxhash.xxh64_intdigest(joined[start : ends[i]], SEED)
        start = ends[i - width + 1] + 1


def fingerprint_of(data: bytes | None, width: int = 4) -> int:
    """The fingerprint of one text: ASCII lower case, words between ASCII white space."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    hashes, count, total = _hashes(words, width), 0, np.zeros(BITS, "i8")
    while part := [h for _, h in zip(range(CHUNK), hashes)]:
        bits = np.unpackbits(np.array(part, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype="i8")
        count += len(part)
    return int(np.packbits((2 * total > count).astype("u1"), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = 4) -> Column:
    """The 64-bit fingerprint of a text as a signed long; zero for a null or wordless text.

    A bit is 1 if it is set in over half the XXH64 hashes of the word shingles, repeats
    included. Fewer words than a shingle form one shingle.
    """

    @F.arrow_udf("long")
    def compute(texts: pa.Array) -> pa.Array:
        values = [fingerprint_of(t.as_py(), width) for t in texts]
        return pa.array(np.array(values, "<u8").view("<i8"), pa.int64())

    return compute(text.cast("binary"))


def _masks(bits: int, flips: int) -> np.ndarray:
    values = [sum(1 << i for i in chosen) for n in range(flips + 1) for chosen in combinations(range(bits), n)]
    return np.array(values, "<u8")


def _collisions(low: np.ndarray, left: np.ndarray, who: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (who, who) that share a variant of their ``bits`` low bits, ``left`` flips each.

    Fingerprints of one variant come as a chain of pairs. Beyond the memory bound the
    variants are made beginning by beginning.
    """
    counts = np.bincount(left)
    size = sum(int(n) * sum(math.comb(bits, k) for k in range(r + 1)) for r, n in enumerate(counts))
    if size > VARIANTS_AT_A_TIME and bits:
        step = min(4, bits)
        rest = bits - step
        top, below = low >> np.uint64(rest), low & np.uint64((1 << rest) - 1)
        for begin in range(1 << step):
            used = np.bitwise_count(top ^ np.uint64(begin)).astype("i8")
            near = used <= left
            if near.sum() > 1:
                yield from _collisions(below[near], (left - used)[near], who[near], rest)
        return
    values, owners = [], []
    for flips in np.flatnonzero(counts):
        chosen = left == flips
        masks = _masks(bits, int(flips))
        values.append((low[chosen][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(who[chosen], len(masks)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    yield owner[same], owner[same + 1]


def _links(batches: Iterable[pa.RecordBatch], prefix_bits: int, reach: int) -> Iterator[pa.RecordBatch]:
    rest = BITS - prefix_bits
    for (begin,), group in grouped(batches, ["begin"]):
        prints = np.unique(group.column("print").to_numpy().view("u8"))
        if len(prints) < 2:
            continue
        used = np.bitwise_count((prints >> np.uint64(rest)) ^ np.uint64(begin)).astype("i8")
        low = prints & np.uint64((1 << rest) - 1)
        everyone = np.arange(len(prints))
        root = everyone
        for a, b in _collisions(low, reach - used, everyone, rest):
            near = np.bitwise_count(prints[a] ^ prints[b]) <= 2 * reach
            a, b = a[near], b[near]
            # pairs are folded into the forest as they come, so they are never all in memory
            new = root[a] != root[b]
            if new.any():
                joined = smallest_reachable(len(prints), root[a[new]], root[b[new]])
                root = joined[root]
        linked = np.flatnonzero(root != everyone)
        if len(linked):
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints[linked].view("i8")), pa.array(prints[root[linked]].view("i8"))], ["a", "b"]
            )


def ball_links(prints: DataFrame, count: int, distance: int = 4) -> DataFrame:
    """Links (a, b) that connect all of the distinct ``print`` values at ``distance`` bits or fewer.

    Each task gives a spanning forest of the links it finds, so that fingerprints close
    together never become all their pairs. ``distance`` must be even.
    """
    if distance % 2 or distance < 2:
        raise ValueError("the bit distance must be even and at least 2")
    reach = distance // 2
    ball = sum(math.comb(BITS, k) for k in range(reach + 1))
    prefix_bits = min(32, max(4, math.ceil(math.log2(max(2, count) * ball / VARIANTS_PER_KEY))))
    begin = F.shiftrightunsigned("print", BITS - prefix_bits)
    masks = F.array(*[F.lit(int(m)) for m in _masks(prefix_bits, reach)])
    sent = prints.select("print", F.explode(F.transform(masks, lambda m: begin.bitwiseXOR(m))).alias("begin"))
    return (
        sent.repartition("begin")
        .sortWithinPartitions("begin")
        .mapInArrow(lambda batches: _links(batches, prefix_bits, reach), "a long, b long")
    )


def simhash_groups(prints: DataFrame, id_col: str = "doc_id", distance: int = 4) -> DataFrame:
    """Add ``root`` and ``component_id`` to rows with ``print``.

    ``root`` is one fingerprint of the linked rows, ``component_id`` their smallest id; null
    ids are ignored by the minimum, so a group of null ids only has none. ``prints`` is read
    several times and should be a written table.
    """
    per_print = materialise(prints.groupBy("print").agg(F.min(id_col).alias("least")), "prints")
    roots = components(ball_links(per_print.select("print"), per_print.count(), distance))
    rooted = per_print.join(roots, per_print["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce(roots["root"], "print").alias("root")
    )
    rooted = materialise(rooted, "roots")
    # written, so that Spark can split the join at a root of many fingerprints
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = rooted.join(least, "root").select("print", "root", "component_id")
    return prints.join(named, "print", "left")


def simhash_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4
) -> DataFrame:
    """(id, ``fingerprint``, ``component_id``) of every row.

    Null and wordless texts have the fingerprint zero, linked like any other; repeated rows
    each give a row; an empty table gives none; other columns are not read.
    """
    prints = materialise(docs.select(id_col, fingerprint(F.col(text_col), width).alias("print")), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return simhash_groups(prints, id_col, distance).select(id_col, hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of ``docs``.

    The row with the smallest doc_id stays; null ids come last, then the text's key and the
    fingerprint decide. Rows equal in these count as one, whatever their other columns hold.
    """
    mark, key = fresh(docs, "print"), fresh(docs, "key")
    marked = docs.select("*", fingerprint(F.col("text"), width).alias(mark), text_key("text").alias(key))
    marked = materialise(marked, "marked")
    light = marked.select(F.col(mark).alias("print"), "doc_id", F.col(key).alias("key"))
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key", "print").alias("rank")
    groups = simhash_groups(light, "doc_id", distance).select("root", rank)
    first = groups.groupBy("root").agg(F.min("rank").alias("rank")).select("rank.*")
    same = (
        (marked[mark] == first["print"]) & (marked[key] == first["key"]) & marked["doc_id"].eqNullSafe(first["doc_id"])
    )
    kept = marked.join(first, same, "left_semi")
    return kept.dropDuplicates([mark, key, "doc_id"]).select(*docs.columns)
