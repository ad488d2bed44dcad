"""Removal of repeated passages by hashing lines.

Texts are cut at line ends and, since passages also stand inside lines, at sentence ends
within them. Units are normalised (lower case, white space as one blank), hashed, and
grouped over the whole corpus. Ranks are (doc_id, hash of the text, place); the occurrence
of the lowest rank stays, all others are repeats, and repeats in a row in one document form
a run. A line or paragraph that an earlier document holds is found by its sentences, since
how a line is cut follows from the line alone; one without sentence ends is a unit itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultweave.llm.common import fresh
from faultweave.session import materialise

#: Shorter runs stay, if a caller wants that; by default every repeat goes.
MIN_WORDS = 1
#: Units in memory at a time.
CHUNK = 100_000

_PATTERNS = {
    "line": r"[^\n]*[^\s][^\n]*",
    "paragraph": r"[^\n]*[^\s][^\n]*(?:\n[^\n]*[^\s][^\n]*)*",
    "sentence": r"[^\s](?:[^\n.!?]|[.!?]+(?![.!?\s]))*(?:[.!?]+(?=\s|\Z))?",
}
UNITS = {name: re.compile(pattern) for name, pattern in _PATTERNS.items()}


def units_of(text: str, unit: str = "sentence") -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of a text; offsets count code points."""
    for match in UNITS[unit].finditer(text):
        words = match.group().lower().split()
        if words:
            yield match.start(), match.end(), len(words), xxhash.xxh3_128_digest(" ".join(words))


def _cut(batches: Iterable[pa.RecordBatch], unit: str) -> Iterator[pa.RecordBatch]:
    names = ["place", "start", "end", "words", "again"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    for batch in batches:
        rows: list[int] = []
        values: list[tuple] = []
        digests: list[bytes] = []

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(list(v), k) for v, k in zip(zip(*values), kinds)]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *arrays, *map(pa.array, halves.T.copy())],
                ["doc_id", "text_key", *names, "high", "low"],
            )

        for row, text in enumerate(batch.column(2)):
            seen: set[bytes] = set()
            for place, (start, end, words, digest) in enumerate(units_of(text.as_py() or "", unit)):
                rows.append(row)
                values.append((place, start, end, words, digest in seen))
                digests.append(digest)
                seen.add(digest)
                if len(rows) >= CHUNK:
                    yield flush()
                    rows, values, digests = [], [], []
        if rows:
            yield flush()


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per removed run: (``doc_id``, ``text_key``, ``start``, ``end``, ``n_units``,
    ``n_words``, ``first_doc_id``), offsets in code points of the original text, end exclusive;
    ``first_doc_id`` is a document that holds the first unit of the run before.

    ``text_key`` is the XXH64 of the text, which tells rows of one id apart. Null and blank
    texts have no units. Null ids rank last. Rows equal in id and text are one document.
    Repeats inside a document count like those across documents; a task sees them by itself,
    so only the first occurrence in each document is compared with other documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    schema = (
        f"doc_id {kind}, text_key long, place int, start int, end int, words int, again boolean, high long, low long"
    )
    units = materialise(chosen.mapInArrow(lambda b: _cut(b, unit), schema), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    # partial minima leave the map side, so a digest of a third of all units is no hot key
    firsts = (
        units.where("NOT again")
        .groupBy("high", "low")
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("high", "low", "first")
    )
    # two numbers travel in one long
    pair = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32) + F.col(b)
    packed = units.select("doc_id", "text_key", "high", "low", "again", pair("place", "words").alias("at"), pair("start", "end").alias("span"))
    across = packed.where("NOT again").drop("again").join(firsts, ["high", "low"]).where(rank != F.col("first"))
    across = across.select("doc_id", "text_key", "at", "span", F.col("first.doc_id").alias("first_doc_id"))
    inside = packed.where("again").select("doc_id", "text_key", "at", "span", F.col("doc_id").alias("first_doc_id"))
    lower = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    upper = lambda c: F.shiftright(c, 32).cast("int")
    repeats = across.unionByName(inside).select(
        "doc_id",
        "text_key",
        upper("at").alias("place"),
        lower("at").alias("words"),
        upper("span").alias("start"),
        lower("span").alias("end"),
        "first_doc_id",
    )
    repeats = repeats.dropDuplicates(["doc_id", "text_key", "place"])
    in_doc = Window.partitionBy("doc_id", "text_key").orderBy("place")
    runs = repeats.withColumn("run", F.col("place") - F.row_number().over(in_doc))
    return (
        runs.groupBy("doc_id", "text_key", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count(F.lit(1)).alias("n_units"),
            F.sum("words").alias("n_words"),
            F.min_by("first_doc_id", "place").alias("first_doc_id"),
        )
        .where(F.col("n_words") >= min_words)
        .drop("run")
    )


def without_passages(docs: DataFrame, **options) -> DataFrame:
    """The documents without their repeated passages, all columns kept; ``n_chars`` follows."""
    key, cuts, text = fresh(docs, "key"), fresh(docs, "cuts"), F.col("text")
    spans = (
        repeated_passages(docs, **options)
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts))
    )
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(spans["doc_id"]) & (keyed[key] == spans["text_key"])
    both = keyed.join(spans, same, "left").select(*[keyed[f"`{c}`"] for c in docs.columns], spans[cuts])
    # what stands before, between and after the cuts
    ends = F.concat(F.array(F.lit(0)), F.col(cuts)["end"])
    starts = F.concat(F.col(cuts)["start"], F.array(F.length(text)))
    kept = F.array_join(F.zip_with(ends, starts, lambda e, s: F.substr(text, e + 1, s - e)), "")
    cleaned = F.when(F.col(cuts).isNull(), text).otherwise(kept)
    lost = F.aggregate(F.col(cuts), F.lit(0), lambda total, c: total + c["end"] - c["start"])
    new = {"text": cleaned, "n_chars": (F.length(text) - F.coalesce(lost, F.lit(0))).cast("long")}
    return both.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
