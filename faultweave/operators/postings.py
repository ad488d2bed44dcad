"""A kept inverted index of texts by character n-grams, for finding names inside them.

The index lists the texts of every different gram of one, two and three characters; a row
holds those of one slice of texts as bytes (``held``: how far each number lies above the
``first``), so that a gram's list is many short rows that Spark moves as one value each. A text that
holds a name holds all grams of the name, so the texts on the posting list of the name's
rarest gram are the only ones to look through; each of them is then read once for all the
names that it may hold. A gram that no text has shows at once that a name is nowhere.
Names stay in Spark tables throughout. The tables are partitioned by a hash of the gram,
so a lookup reads only the folders of the grams it needs, and texts added later form a
generation of their own.

Where no index is kept, neighbouring texts form blocks and only the grams of each block are
listed. A name goes once to every block that has its rarest gram, and a block's texts are
read once for its names, so what travels grows with blocks and not with texts times names.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.session import materialise, path_exists

LONGEST = 3
#: Folders of each table; more for more texts.
BUCKETS = 32
#: Posting lists longer than this are read in parts, so that one gram of very many texts and names is many tasks.
PART_ROWS = 1 << 20
#: Characters of texts whose grams a task lists at a time.
SLICE_CHARS = 1 << 21
#: Names that are looked for in a text at a time.
NAMES_AT_A_TIME = 1 << 12
#: Texts that share a matcher.
TEXTS_AT_A_TIME = 128

#: Texts of a block at most; its characters are at most those of a slice, unless it is one text.
BLOCK_TEXTS = 1 << 16
#: Characters of names that a block is searched for at a time.
BLOCK_NAME_CHARS = 1 << 20

#: Texts that an unpacked batch of lists has at least, unless it is the last.
LISTED_AT_A_TIME = 1 << 16

_LISTS = pa.schema([("gram", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("held", pa.binary())])
_LIST = "gram string, first long, n long, held binary"


def _grams(name: Column, size: int) -> Column:
    """All grams of ``size`` characters of a name that has so many, each as often as it stands there."""
    return F.transform(F.sequence(F.lit(1), F.length(name) - (size - 1)), lambda i: F.substring(name, i, F.lit(size)))


def _slice_lists(seqs: list[int], texts: list[list[str]]) -> Iterator[pa.RecordBatch]:
    """The lists of one slice by gram; ``texts`` has the texts of each row.

    A row's number and a gram, its characters numbered within the slice, fit 64 bits, so one
    sort brings the rows of a gram together. A slice that is too large for it is halved.
    """
    chars = sum(len(t) for row in texts for t in row)
    joined = np.frombuffer("".join(t for row in texts for t in row).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(sys.maxunicode + 1, bool)
    seen[joined] = True
    letters = np.flatnonzero(seen).astype(np.uint32)
    bits, row_bits = max(1, len(letters).bit_length()), (len(seqs) - 1).bit_length()
    if len(seqs) > 1 and (chars > SLICE_CHARS or LONGEST * bits + row_bits > 63):
        half = len(seqs) // 2
        yield from _slice_lists(seqs[:half], texts[:half])
        yield from _slice_lists(seqs[half:], texts[half:])
        return
    number = np.zeros(int(letters[-1]) + 1 if len(letters) else 1, np.uint64)
    number[letters] = np.arange(len(letters), dtype=np.uint64)
    codes = number[joined]
    lengths = np.array([len(t) for row in texts for t in row], np.int64)
    field = np.repeat(np.arange(len(lengths)), lengths)
    row = np.repeat(np.repeat(np.arange(len(texts), dtype=np.uint64), [len(r) for r in texts]), lengths)
    places = np.array(seqs, np.int64)
    mask, last = np.uint64((1 << row_bits) - 1), np.uint64((1 << bits) - 1)
    width = next(w for w in (1, 2, 4, 8) if max(seqs, default=0) - min(seqs, default=0) < 1 << (8 * w))
    ends = lengths.cumsum()
    keyed = np.empty(0, np.uint64)
    for size in range(LONGEST, 0, -1):
        if size == LONGEST:
            n = max(0, len(codes) - size + 1)
            gram = codes[:n]
            for i in range(1, size):
                gram = (gram << np.uint64(bits)) | codes[i : i + n]
            # a gram does not go from one text into the next
            keyed = ((gram << np.uint64(row_bits)) | row[:n])[field[:n] == field[size - 1 :]]
        else:
            # the beginnings of the longer grams, and the grams at the ends of the texts
            at = (ends - size)[lengths >= size]
            gram = codes[at]
            for i in range(1, size):
                gram = (gram << np.uint64(bits)) | codes[at + i]
            begun = (keyed >> np.uint64(row_bits + bits) << np.uint64(row_bits)) | (keyed & mask)
            keyed = np.concatenate([begun, (gram << np.uint64(row_bits)) | row[at]])
        keyed.sort()
        keyed = keyed[np.append(True, keyed[1:] != keyed[:-1])[: len(keyed)]]
        if not len(keyed):
            continue
        gram, held = keyed >> np.uint64(row_bits), places[(keyed & mask).astype(np.int64)]
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        different = gram[starts]
        written = np.stack(
            [letters[((different >> np.uint64(bits * i)) & last).astype(np.int64)] for i in range(size - 1, -1, -1)], axis=1
        )
        written = written.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        counts = np.diff(np.append(starts, len(held)))
        first = np.minimum.reduceat(held, starts)
        above = (held.astype(np.uint64) - np.repeat(first, counts).astype(np.uint64)).astype(f"<u{width}")
        offsets = (np.append(starts, len(held)) * width).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([written[i : i + size] for i in range(0, len(written), size)], pa.string()),
                pa.array(first, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(above)]),
            ],
            schema=_LISTS,
        )


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, _parts, seq) of lists with gram, _parts, first, n and held."""
    for batch in batches:
        first, n = (batch.column(c).to_numpy() for c in ("first", "n"))
        texts = batch.column("held")
        start = 0
        for end in range(1, batch.num_rows + 1):
            if end < batch.num_rows and n[start:end].sum() < LISTED_AT_A_TIME:
                continue
            above = []
            for i in range(start, end):
                held = texts[i].as_buffer()
                above.append(np.frombuffer(held, f"<u{len(held) // n[i]}").astype(np.uint64) + np.uint64(int(first[i]) % (1 << 64)))
            which = pa.array(np.repeat(np.arange(start, end), n[start:end]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("gram").take(which),
                    batch.column("_parts").take(which),
                    pa.array(np.concatenate(above).astype(np.int64), pa.int64()),
                ],
                names=["gram", "_parts", "seq"],
            )
            start = end


def _text_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seqs, *columns = (column.to_pylist() for column in batch.columns)
        rows: list[list[str]] = []
        start = chars = 0
        for at, texts in enumerate(zip(*columns)):
            texts = [t.decode("utf-8", "replace") for t in texts]
            more = sum(map(len, texts))
            if rows and chars + more > SLICE_CHARS:
                yield from _slice_lists(seqs[start:at], rows)
                rows, start, chars = [], at, 0
            rows.append(texts)
            chars += more
        if rows:
            yield from _slice_lists(seqs[start:], rows)


def matcher(names: list[str]) -> Callable[[str], set[str]]:
    """The function that finds which of the names stand in a text, by one pass over it."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for name in names:
        machine.add_word(name, name)
    machine.make_automaton()
    hit = itemgetter(1)
    return lambda text: set(map(hit, machine.iter(text)))


def _held_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, seq) of the names that a text holds; a batch has seq, the names asked for and the texts, as bytes.

    Neighbouring texts are asked for much the same names, so they share a matcher.
    """

    def plain(value: bytes) -> str:
        return value.decode("utf-8", "surrogateescape")

    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_A_TIME):
            rows = list(zip(*(column.to_pylist() for column in batch.slice(start, TEXTS_AT_A_TIME).columns)))
            find = matcher([plain(name) for name in {name for row in rows for name in row[1]}])
            names: list[bytes] = []
            places: list[int] = []
            for seq, wanted, *texts in rows:
                held = {h.encode("utf-8", "surrogateescape") for h in set().union(*map(find, map(plain, texts)))}
                found = [name for name in wanted if name in held]
                names.extend(found)
                places.extend([seq] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(places, pa.int64())], names=["name", "seq"])


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts, as bytes, with the number of their block."""
    block, chars, texts = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns[1:]:
            sizes += pc.binary_length(column).to_numpy(zero_copy_only=False)
        blocks = []
        for more in sizes.tolist():
            if texts and (chars + more > SLICE_CHARS or texts == BLOCK_TEXTS):
                block, chars, texts = block + 1, 0, 0
            chars, texts = chars + more, texts + 1
            blocks.append(block)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], names=[*batch.schema.names, "block"])


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram, n) of batches with the block and its texts: the grams of a run of a block's texts and how many have each."""

    def listed(block: int, rows: list[list[str]]) -> Iterator[pa.RecordBatch]:
        for lists in _slice_lists(list(range(len(rows))), rows):
            number = pa.array(np.full(lists.num_rows, block), pa.int64())
            yield pa.RecordBatch.from_arrays([number, lists.column("gram"), lists.column("n")], names=["block", "gram", "n"])

    last, rows = None, []
    for batch in batches:
        for block, *texts in zip(*(column.to_pylist() for column in batch.columns)):
            if rows and block != last:
                yield from listed(last, rows)
                rows = []
            last = block
            rows.append([t.decode("utf-8", "replace") for t in texts])
    if rows:
        yield from listed(last, rows)


def _block_pairs(names: pa.Table, texts: pa.Table) -> pa.Table:
    """(name, seq) of the names that a block's texts hold, once per text; both as bytes."""
    import ahocorasick

    asked = pc.unique(names.column("name"))
    machine = ahocorasick.Automaton()
    for i, name in enumerate(asked.to_pylist()):
        machine.add_word(name.decode("utf-8", "surrogateescape"), i)
    machine.make_automaton()
    hit = itemgetter(1)
    held: list[int] = []
    counts: list[int] = []
    for row in zip(*(column.to_pylist() for column in texts.drop_columns(["block", "_part", "seq"]).columns)):
        found = set()
        for text in row:
            found.update(map(hit, machine.iter(text.decode("utf-8", "surrogateescape"))))
        held.extend(found)
        counts.append(len(found))
    seqs = texts.column("seq").to_numpy()
    return pa.table({"name": asked.take(pa.array(held, pa.int64())), "seq": pa.array(np.repeat(seqs, counts), pa.int64())})


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_postings(texts: DataFrame, path: str, generation: int = 0, buckets: int = BUCKETS) -> None:
    """Index the texts (``seq`` and any string columns, null as empty) as a generation at ``path``.

    A repeated run overwrites its generation. ``seq`` must be unique over all generations,
    and all generations written with the same ``buckets``.
    """
    spark = texts.sparkSession
    fields = [c for c in texts.columns if c != "seq"]
    kept = texts.select(F.col("seq").cast("long").alias("seq"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields])
    kept.write.mode("overwrite").parquet(f"{path}/texts/generation={generation}")
    kept = spark.read.schema(kept.schema).parquet(f"{path}/texts/generation={generation}")
    # a text without a number is in no list
    lists = kept.where("seq IS NOT NULL").select("seq", *[F.col(c).cast("binary") for c in fields])
    lists = lists.mapInArrow(_text_lists, _LIST)
    # written once, since the ranges are found by a pass of their own
    lists = materialise(lists, "gram-lists").withColumn("bucket", _bucket(F.col("gram"), buckets))
    postings = lists.repartitionByRange("bucket", "gram", "first").sortWithinPartitions("bucket", "gram", "first")
    postings.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/generation={generation}")
    written = spark.read.schema("gram string, n long, bucket int").parquet(f"{path}/postings/generation={generation}")
    counts = written.groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
    counts = counts.repartitionByRange("bucket", "gram")
    counts.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams/generation={generation}")


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, generation int, bucket int").parquet(f"{path}/{name}")


def _numbers(grams: DataFrame) -> list[int]:
    """The buckets of these grams, at most as many as there are."""
    return sorted(r[0] for r in grams.select("bucket").distinct().collect())


def _name_grams(names: DataFrame) -> DataFrame:
    """(name, gram) of the different grams of each name, a short one being its own."""
    short = F.length("name") < LONGEST
    grams = F.when(short, F.array("name")).otherwise(F.array_distinct(_grams(F.col("name"), LONGEST)))
    return names.select("name", F.explode(grams).alias("gram"))


def _rarest(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(name, gram, n) by the (gram, n) of the texts, of the names whose grams are all among them."""
    held = held.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = asked.join(materialise(held, "gram-counts"), "gram", "left")
    rarest = counted.groupBy("name").agg(
        F.min(F.struct("n", "gram")).alias("_rarest"), F.count(F.lit(1)).alias("_grams"), F.count("n").alias("_held")
    )
    return rarest.where("_held = _grams").select("name", "_rarest.gram", "_rarest.n")


def rarest_grams(names: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """(name, gram, n) of the names whose grams all stand in some text: the rarest and its number of texts."""
    asked = materialise(_name_grams(names).withColumn("bucket", _bucket(F.col("gram"), buckets)), "name-grams")
    held = _read(names.sparkSession, path, "grams", "gram string, n long")
    return _rarest(asked, held.where(F.col("bucket").isin(_numbers(asked))))


def _parts() -> Column:
    return F.ceil(F.col("n") / F.lit(PART_ROWS)).cast("int").alias("_parts")


def posted_pairs(names: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """(name, seq) of every text that holds a name; ``names`` has distinct names that are not empty.

    The names of one gram and its posting list meet in parts: the list is cut by a hash of
    the text, and the names go to each part of it. A text is then read for all names that it
    may hold, up to ``NAMES_AT_A_TIME`` of them together.
    """
    spark = names.sparkSession
    if not path_exists(spark, f"{path}/postings"):
        return spark.createDataFrame([], "name string, seq long")
    chosen = rarest_grams(names, path, buckets).select("*", _parts())
    chosen = materialise(chosen.withColumn("bucket", _bucket(F.col("gram"), buckets)), "rarest-grams")
    lists = _read(spark, path, "postings", _LIST).where(F.col("bucket").isin(_numbers(chosen)))
    texts = spark.read.parquet(f"{path}/texts").drop("generation")
    texts = texts.select("seq", *[F.col(c).cast("binary") for c in texts.columns if c != "seq"])
    return _listed_pairs(chosen, lists, texts)


def _listed_pairs(chosen: DataFrame, lists: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, seq) of the texts, as bytes, that hold a name, by the lists of the names' grams."""
    wanted = chosen.select("gram", "_parts").distinct()
    lists = lists.join(wanted, "gram").select("gram", "_parts", "first", "n", "held")
    lists = lists.mapInArrow(_listed, "gram string, _parts int, seq long")
    lists = lists.select("gram", "seq", F.pmod(F.xxhash64("seq"), F.col("_parts")).cast("int").alias("_part"))
    spread = chosen.select("name", "gram", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    chunks = F.lit(-(-chosen.count() // NAMES_AT_A_TIME) or 1)
    candidates = spread.join(lists, ["gram", "_part"]).select("name", "seq").repartition("seq")
    candidates = candidates.groupBy("seq", F.pmod(F.xxhash64("name"), chunks).alias("_chunk"))
    candidates = materialise(candidates.agg(F.collect_list(F.col("name").cast("binary")).alias("names")), "candidates")
    held = candidates.drop("_chunk").join(texts, "seq").mapInArrow(_held_names, "name binary, seq long")
    return held.select(F.col("name").cast("string").alias("name"), "seq")


def pairs_by_blocks(names: DataFrame, texts: DataFrame) -> DataFrame:
    """:func:`posted_pairs` of texts as :func:`write_postings` takes them, where no index is kept.

    A row per gram and block is all that is listed. A name goes to a block once, whatever
    number of its texts may hold it, and each text is read once for up to
    ``BLOCK_NAME_CHARS`` characters of names; pairs are rows only where a text holds the name.
    """
    fields = [c for c in texts.columns if c != "seq"]
    plain = texts.select(F.col("seq").cast("long").alias("seq"), *[F.coalesce(F.col(c), F.lit("")).cast("binary").alias(c) for c in fields])
    # a text without a number is not looked through
    schema = ", ".join(["seq long", *[f"`{c}` binary" for c in fields], "block long"])
    texts = materialise(plain.where("seq IS NOT NULL").mapInArrow(_in_blocks, schema), "text-blocks")
    blocks = texts.select("block", *fields).mapInArrow(_block_grams, "block long, gram string, n long")
    blocks = materialise(blocks, "block-grams")
    asked = materialise(_name_grams(names), "name-grams")
    chosen = materialise(_rarest(asked, blocks).select("*", _parts()), "rarest-grams")
    chars = chosen.groupBy("gram").agg(F.sum(F.length("name")).alias("_chars"))
    parts = F.ceil(F.sum("_chars") / F.lit(BLOCK_NAME_CHARS)).cast("int").alias("_parts")
    # a row per some million characters of texts
    sizes = F.broadcast(materialise(blocks.join(chars, "gram").groupBy("block").agg(parts), "block-parts"))
    repeated = materialise(texts.groupBy("seq").count().where("count > 1").select("seq"), "repeated-texts")
    again = None if repeated.isEmpty() else texts.join(repeated, "seq", "left_semi").drop("block")
    if again is not None:
        texts = texts.join(repeated, "seq", "left_anti")
    part = F.pmod(F.xxhash64("name"), F.col("_parts")).cast("int").alias("_part")
    left = blocks.select("block", "gram").join(chosen.select("name", "gram"), "gram").join(sizes, "block")
    left = left.select("block", part, F.col("name").cast("binary").alias("name"))
    every_part = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")
    right = texts.join(sizes, "block").select("block", every_part, "seq", *fields)
    left, right = (df.groupBy("block", "_part") for df in (left, right))
    pairs = left.cogroup(right).applyInArrow(_block_pairs, "name binary, seq long")
    pairs = pairs.select(F.col("name").cast("string").alias("name"), "seq")
    if again is None:
        return pairs
    # texts that share a number are answered together, as from a kept index
    return pairs.unionByName(_listed_pairs(chosen, again.mapInArrow(_text_lists, _LIST), again))
