"""Packing token sequences by the linear grouping scheme.

Lengths are whole numbers up to the capacity, so a histogram of bounded size says all that
packing needs. On it the driver makes the plan:

1. Pieces longer than an eighth of the capacity are sorted and cut into groups of equal
   cardinality; each group's lengths count as its longest.
2. For these few sizes, column generation finds how often to use each configuration (a set
   of sizes that fits), with a knapsack over the capacity as its pricing step.
3. The configurations used a whole number of times are filled with actual lengths.
4. What remains, and all small pieces, go best-fit in decreasing order into the rest.

The plan is a list of runs: "of length L, pieces from the i-th on, k per sequence, from
sequence s and offset o on". Their number depends on the capacity alone. Spark numbers the
pieces within each length and looks their places up.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.common import numbered, text_key
from faultweave.session import materialise

CAPACITY = 4096
END_ID = 1
#: Groups of equal cardinality, and the inverse of the share above which a length is large.
GROUPS = 32
LARGE = 8
MAX_ROUNDS = 300
#: Words whose ids a Python worker remembers, and the longest of them.
MEMO = 400_000
MEMO_CHARS = 48
#: Characters of text coded at a time; a longer text is alone.
CHUNK_CHARS = 4_000_000


class Plan:
    """Places by length. Bins that look alike are kept as (first bin, number)."""

    def __init__(self, histogram: Mapping[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = {length: n for length, n in histogram.items() if n}
        self.first = dict.fromkeys(self.left, 0)
        self.bins = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.rooms: list[int] = []
        self.by_room: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, n: int, per_bin: int, bin_id: int, offset: int) -> None:
        self.runs.append((length, self.first[length], n, per_bin, bin_id, offset))
        self.first[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def offer(self, bin_id: int, n: int, room: int) -> None:
        """Let best-fit use bins with this room."""
        if not n or not room:
            return
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append((bin_id, n))

    def fill(self, configuration: list[list[int]], n: int) -> None:
        """Make ``n`` bins with one length of each listed group, as long as the group lasts."""
        open_bins = [(self.open(n), n, 0)]
        for group in configuration:
            then = []
            for bin_id, many, used in open_bins:
                while many and group:
                    length = group[-1][0]
                    take = min(many, group[-1][1])
                    self.put(length, take, 1, bin_id, used)
                    then.append((bin_id, take, used + length))
                    bin_id, many = bin_id + take, many - take
                    group[-1][1] -= take
                    if not group[-1][1]:
                        group.pop()
                if many:
                    then.append((bin_id, many, used))
            open_bins = then
        for bin_id, many, used in open_bins:
            self.offer(bin_id, many, self.capacity - used)

    def best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                at = bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    room = self.capacity
                    many = -(-n // (room // length))
                    bin_id = self.open(many)
                else:
                    room = self.rooms[at]
                    bin_id, many = self.by_room[room].pop()
                    if not self.by_room[room]:
                        del self.by_room[room]
                        self.rooms.pop(at)
                each = room // length
                full = min(many, n // each)
                if full:
                    self.put(length, full * each, each, bin_id, self.capacity - room)
                    self.offer(bin_id, full, room - each * length)
                    bin_id, many, n = bin_id + full, many - full, n - full * each
                if many and n:  # fewer than ``each`` remain
                    self.put(length, n, n, bin_id, self.capacity - room)
                    self.offer(bin_id, 1, room - n * length)
                    bin_id, many = bin_id + 1, many - 1
                if many:
                    self.offer(bin_id, many, room)


def linear_groups(histogram: Mapping[int, int], n_groups: int) -> list[tuple[int, list[list[int]]]]:
    """(longest, [[length, count], ...] ascending) of groups of equal cardinality, longest first."""
    total = sum(histogram.values())
    bounds = sorted({-(-total * (g + 1) // n_groups) for g in range(n_groups)})
    groups: list[tuple[int, list[list[int]]]] = []
    seen, at, part = 0, 0, []
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            take = min(n, bounds[at] - seen)
            part.append([length, take])
            seen, n = seen + take, n - take
            if seen == bounds[at]:
                groups.append((part[0][0], part[::-1]))
                at, part = at + 1, []
    merged: list[tuple[int, list[list[int]]]] = []
    for size, part in groups:  # groups of one rounded length are one size
        if merged and merged[-1][0] == size:
            merged[-1] = (size, part + merged[-1][1])
        else:
            merged.append((size, part))
    return merged


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """(uses of each size, times) that meet the demand with about the fewest bins.

    The linear programme of Gilmore and Gomory by column generation: the basis starts with
    one size per configuration; a knapsack finds the configuration that gains most.
    """
    sizes_, wanted = np.array(sizes), np.array(demand, "f8")
    basis = np.diag(capacity // sizes_).astype("f8")
    times = wanted / np.diag(basis)
    for _ in range(MAX_ROUNDS):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        uses, gain = _knapsack(sizes_, price, capacity)
        if gain < 1 + 1e-6:
            break
        column = uses.astype("f8")
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        times = np.maximum(np.linalg.solve(basis, wanted), 0)
    return [(basis[:, k].astype(int).tolist(), float(times[k])) for k in range(len(sizes))]


def _knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Uses of each size that fit and have the largest sum of prices, item by item."""
    value, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        best, choice = value.copy(), np.full(capacity + 1, -1)
        for k, size in enumerate(sizes.tolist()):
            with_it = value[:-size] + price[k]
            better = with_it > best[size:] + 1e-12
            best[size:][better] = with_it[better]
            choice[size:][better] = k
        choices.append(choice)
        value = best
    uses, room = np.zeros(len(sizes), "i8"), capacity
    for choice in reversed(choices):
        if choice[room] >= 0:
            uses[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return uses, float(value[capacity])


def plan_runs(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first piece, pieces, pieces per sequence, first sequence, offset) of all pieces."""
    plan = Plan(histogram, capacity)
    if n := plan.left.get(capacity):
        plan.put(capacity, n, 1, plan.open(n), 0)
    large = {length: n for length, n in plan.left.items() if length * LARGE > capacity}
    if large:
        groups = linear_groups(large, GROUPS)
        demand = [sum(n for _, n in part) for _, part in groups]
        for uses, times in configurations([size for size, _ in groups], demand, capacity):
            if whole := int(times + 1e-6):
                plan.fill([groups[g][1] for g, k in enumerate(uses) for _ in range(k)], whole)
    plan.best_fit()
    return plan.runs


def _byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, spare = [], 256
    for b in range(256):
        if b in plain:
            symbols.append(chr(b))
        else:
            symbols.append(chr(spare))
            spare += 1
    return symbols


class WordIds:
    """Token ids of texts, by the ids of their words.

    The tokenizer lower-cases and splits at white space, which it drops, so a text's ids are
    those of its words in a row; each different word of a chunk is coded once, and words
    are remembered. Texts with characters for which this is not plain (special tokens,
    control characters, rare spaces, letters beyond Latin, text not in NFC) are coded whole.
    So are all texts where the file's settings are not those that ``known_settings`` states.
    """

    #: without these a text is plain and in NFC; U+0130 is lower-cased to two characters
    odd = r"<\||[^\t-\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]"
    split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    #: settings of a tokenizer file for which the way by words is right
    known_settings = {
        "normalizer": {
            "type": "Sequence",
            "normalizers": [
                {"type": "NFC"},
                {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
                {"type": "Lowercase"},
            ],
        },
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {
                    "type": "Split",
                    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                    "behavior": "Removed",
                    "invert": True,
                },
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        with open(vocabulary, encoding="utf-8") as file:
            settings = json.load(file)
        self.by_words = (
            all(settings.get(name) == known for name, known in self.known_settings.items())
            and all("<|" in token["content"] for token in settings.get("added_tokens") or ())
            and settings["model"].get("type") == "BPE"
            and not settings["model"].get("dropout")
            and not (settings.get("truncation") or settings.get("padding"))
        )
        self.symbols = _byte_symbols()
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            coded = piece if piece.isascii() else "".join(map(self.symbols.__getitem__, piece.encode()))
            ids = self._remember(piece, array("I", [t.id for t in self.model.tokenize(coded)]).tobytes())
        return ids

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)
        if word[:-1].isalpha() and word[-1] in ".,!?;:":
            ids = self._piece(word[:-1]) + self._piece(word[-1])
        else:
            ids = b"".join(map(self._piece, self.split.findall(word)))
        return self._remember(word, ids)

    def _remember(self, word: str, ids: bytes) -> bytes:
        if len(word) <= MEMO_CHARS:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[word] = ids
        return ids

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = pc.dictionary_encode(words.values)
        different = coded.dictionary.to_pylist()
        ids = [i if i is not None else self._word(w) for w, i in zip(different, map(self.known.get, different))]
        lengths = np.fromiter(map(len, ids), "i8", len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        of_word = coded.indices.to_numpy()
        n = lengths[of_word]
        ends = np.cumsum(n)
        flat = np.frombuffer(b"".join(ids), "<u4")
        flat = flat[np.repeat(starts[of_word] - (ends - n), n) + np.arange(int(n.sum()))]
        bounds = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        return [flat[s:e] for s, e in zip(bounds, bounds[1:])]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian 32-bit numbers."""
        if not self.by_words:
            return [self._whole(t) for t in texts]
        strings = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(strings, self.odd)
        found = iter(self._plain(strings.filter(pc.invert(odd))))
        return [
            self._whole(t) if o else next(found)
            for t, o in zip(texts, odd.to_pylist())
        ]


def _word_ids(vocabulary: str) -> WordIds:
    """One object per Python worker: functions sent by value lose their module's globals."""
    place = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if getattr(place, "vocabulary", None) != vocabulary:
        place.vocabulary, place.word_ids = vocabulary, WordIds(vocabulary)
    return place.word_ids


def _chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, ``keep``, ``piece``, ``start``, ``length``, ``ids_crc32``): each document's ids and the
    end id, cut at the capacity. A null text counts as an empty one and is the end id alone."""
    out = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _word_ids(vocabulary)
        for batch in batches:
            row = 0
            for chunk in _chunks(t.as_py() or "" for t in batch.column(1)):
                rows, values = [], []
                for ids in ids_of(chunk):
                    ids = np.append(ids, np.uint32(END_ID))
                    for piece, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        rows.append(row)
                        values.append((piece, at, len(part), zlib.crc32(part.tobytes())))
                    row += 1
                arrays = [pa.array(list(v), f.type) for v, f in zip(zip(*values), out)]
                own = [batch.column(c).take(pa.array(rows)) for c in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*own, *arrays], ["id", *kept, *out.names])

    kept = list(keep)
    kind = lambda c: docs.schema[c].dataType.simpleString()
    fields = [f"id {kind(id_col)}", *[f"{c} {kind(c)}" for c in kept]]
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *kept)
    return chosen.mapInArrow(
        pieces, ", ".join([*fields, "piece int, start long, length long, ids_crc32 long"])
    ).withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, capacity: int = CAPACITY, place: str | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to the capacity.

    As few sequences as the scheme finds; pieces lie gapless from 0 in each. Equal rows take
    a place each. ``pieces`` is read several times and should be a written table.

    With ``place``, a column of numbers from 0 on that is dropped, pieces of one length are
    used in its order, and sequences are numbered by their smallest place.
    """
    spark = pieces.sparkSession
    # at most as many rows as the capacity
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    if any(not r.length or not 0 < r.length <= capacity for r in counted):
        raise ValueError("lengths must be from 1 to the capacity")
    runs = plan_runs({r.length: r.n for r in counted}, capacity)
    nth = F.col("_nth")
    plan = spark.createDataFrame(
        runs, "length long, _first long, _many long, _each long, _sequence long, _offset long"
    )
    found = numbered(pieces, ["length"], "_nth", place).join(F.broadcast(plan), "length")
    found = found.where((nth >= F.col("_first")) & (nth < F.col("_first") + F.col("_many")))
    at = nth - F.col("_first")
    packed = found.select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )
    if place is None:
        return packed
    packed = materialise(packed, "packed")
    first = materialise(packed.groupBy("sequence_id").agg(F.min(place).alias("_place")), "first")
    # as many sequences as before, so the numbers stay without gaps
    ranks = numbered(first, [], "_rank", "_place").select("sequence_id", "_rank")
    own = [F.col(c) for c in pieces.columns if c != place]
    return packed.join(ranks, "sequence_id").select(*own, F.col("_rank").alias("sequence_id"), "offset")


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, places: DataFrame | None = None
) -> DataFrame:
    """The pieces of all documents with their places; see ``token_pieces`` and ``pack``.

    Null ids are kept, repeated rows are packed each, an empty table gives no rows, and
    other columns are not read. ``places`` (``doc_id``, ``key`` of the text, ``source``,
    ``position``), as ``mixing.places`` gives them, is the order that ``pack`` follows.
    """
    if places is None:
        return pack(materialise(token_pieces(docs, vocabulary, capacity=capacity), "pieces"), capacity)
    keyed = docs.select("doc_id", "text", text_key("text").alias("key"), "source")
    pieces = materialise(token_pieces(keyed, vocabulary, capacity=capacity, keep=["key", "source"]), "pieces")
    same = (
        pieces["doc_id"].eqNullSafe(places["doc_id"])
        & (pieces["key"] == places["key"])
        & pieces["source"].eqNullSafe(places["source"])
    )
    own = [pieces[c] for c in pieces.columns if c not in ("key", "source")]
    placed = materialise(pieces.join(places, same).select(*own, places["position"]), "placed")
    return pack(placed, capacity, "position")
