"""Files that each hold one JSON array of objects, read by many tasks.

A file is read in splits, and in each as pieces that end in a closing brace. Whether a
brace closes anything depends on what came before the split: a piece may begin inside a
string, and at any depth. So each split is scanned for both states it may begin in, which
gives the state it ends in, the change of depth and how often an object ended at each
relative depth. Running through these few numbers in the order of the splits tells where
every split truly begins, and then the splits are cut into objects in parallel. An object
that lies in several splits is put together from its parts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.session import materialise

_INSIDE = re.compile(r'(?:[^"\\]|\\.)*("?)', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|([{\[])|([}\]])', re.S)
_OPENING = re.compile(r"\s*\[", re.S)
_BETWEEN = re.compile(r"\s*(,?)\s*", re.S)
_END = re.compile(r"\s*\]\s*\Z", re.S)
_SUMMARY = "file string, start long, state int, after int, change long, depths array<long>, ends array<long>"
_BEGIN = "file string, start long, begin_state int, begin_depth long, begin_element long"


def scan(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a piece ends inside a string, and its change of depth, its closing brace included."""
    at = 0
    if inside:
        match = _INSIDE.match(piece)
        if not match[1]:
            return True, 0
        at = match.end()
    change = 0
    for token in _TOKEN.finditer(piece, at):
        if token[2]:
            change += 1
        elif token[3]:
            change -= 1
        elif not token[1]:
            return True, change
    return False, change - 1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of all files, without the brace that ends each but the last of a file."""
    return (
        spark.read.option("lineSep", "}")
        .text(path, recursiveFileLookup=True)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("value").alias("piece"),
        )
    )


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and each state it may begin in, what ``_SUMMARY`` says."""
    at, found = None, []

    def close() -> Iterator[pa.RecordBatch]:
        for state, (inside, depth, ends) in enumerate(found):
            values = [at[0], at[1], state, int(inside), depth, list(ends), list(ends.values())]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = [c.split()[0] for c in _SUMMARY.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        for file, start, piece in zip(*[batch.column(c).to_pylist() for c in ("file", "start", "piece")]):
            if (file, start) != at:
                yield from close()
                at, found = (file, start), [(False, 0, Counter()), (True, 0, Counter())]
            for state, (inside, depth, ends) in enumerate(found):
                inside, change = scan(piece, inside)
                if not inside:
                    ends[depth + change] += 1
                found[state] = (inside, depth + change, ends)
    yield from close()


def _begins(splits: pa.Table) -> pa.Table:
    """How each split of a file begins: state, depth and number of the object; an error if the file is no array."""
    rows = sorted(splits.to_pylist(), key=lambda r: (r["start"], r["state"]))
    inside, depth, element, out = 0, 0, 0, []
    for k in range(0, len(rows), 2):
        row = rows[k + inside]
        out.append((row["file"], row["start"], inside, depth, element))
        element += sum(n for at, n in zip(row["depths"], row["ends"]) if at + depth == 1)
        inside, depth = row["after"], depth + row["change"]
    # the last piece of a file has no brace, but was scanned as if it had
    if inside or depth != -1:
        raise ValueError(f"{rows[0]['file']} holds no JSON array")
    names = [c.split()[0] for c in _BEGIN.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)


def _objects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, element, whole, text) of the objects, or parts of objects, in sorted pieces."""
    at, inside, depth, element, held = None, False, 0, 0, []
    begun = closed = entire = False  # the array has begun, has ended; the object held began in this split
    out: list[tuple] = []

    def part(whole: bool) -> None:
        if held:
            out.append((*at, element, whole, "".join(held)))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], ["file", "start", "element", "whole", "text"]
        )

    for batch in batches:
        names = ("file", "start", "begin_state", "begin_depth", "begin_element", "piece")
        for file, start, state, first_depth, first_element, piece in zip(*[batch.column(c).to_pylist() for c in names]):
            if (file, start) != at:
                part(False)
                if first_element is None:
                    raise ValueError("the files were cut otherwise when they were scanned")
                at, inside, depth, element = (file, start), bool(state), first_depth, first_element
                held, begun, closed, entire = [], False, False, False
            wrong = closed
            if not inside and depth == 0 and element == 0 and not begun:
                opening = _OPENING.match(piece)
                wrong |= not opening
                piece, depth, begun = piece[opening.end() :] if opening else piece, 1, True
            if not inside and depth == 1 and not held:
                comma = _BETWEEN.match(piece)
                rest = piece[comma.end() :]
                if rest.startswith("{"):
                    wrong |= bool(comma[1]) != (element > 0)
                    piece, entire = rest, True
                else:
                    wrong |= not _END.match(piece)
                    closed, depth = True, -1
            if wrong:
                raise ValueError(f"{file} holds no JSON array of objects")
            if closed:
                continue
            inside, change = scan(piece, inside)
            depth += change
            held.append(piece + "}")
            if not inside and depth == 1:
                part(entire)
                held, element = [], element + 1
        yield batch_of(out)
        out.clear()
    part(False)
    yield batch_of(out)


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(file, element, text): the objects of each file's array, numbered from 0.

    A file that does not hold one JSON array of objects is an error; empty files are skipped.
    The files are read twice, which must cut them alike; under another
    ``spark.sql.files.maxPartitionBytes`` the second pass fails.
    """
    pieces = _pieces(spark, path)
    summaries = materialise(pieces.mapInArrow(_summaries, _SUMMARY), "array-splits")
    begins = materialise(summaries.groupBy("file").applyInArrow(_begins, _BEGIN), "array-begins")
    dealt = pieces.withColumn("row", F.monotonically_increasing_id()).repartition("file", "start")
    known = dealt.join(begins, ["file", "start"], "left").sortWithinPartitions("file", "start", "row")
    parts = known.mapInArrow(_objects, "file string, start long, element long, whole boolean, text string")
    parts = materialise(parts, "array-parts")
    ordered = F.array_sort(F.collect_list(F.struct("start", "text")))
    cut = parts.where("NOT whole").groupBy("file", "element")
    joined = cut.agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))
    return parts.where("whole").select("file", "element", "text").unionByName(joined)
