"""Fill-in-the-middle: cut texts in three and lay the parts out around markers.

A text is cut at two token bounds into prefix, middle and suffix. ``psm`` is
``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``, ``plain`` the
text itself. The bytes of a chunk of texts lie in one buffer: a scan finds the cuts, the
displacements of the parts go into a difference array, whose cumulative sum is the distance
each byte moves, and one scatter writes all outputs. Restoring reads the markers, computes
the same displacements from the output alone and gathers the bytes back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultweave.llm.common import fresh

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
PLAIN_FROM = 90
SPM_BELOW = 20
FORMS = ("plain", "psm", "spm")
#: Bytes of text in one buffer; a longer text is alone.
CHUNK_BYTES = 4_000_000
#: Bytes whose displacements and token starts are in memory at a time.
WINDOW = 1 << 20

FIELDS = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True


def _starts(data: np.ndarray, low: int, high: int, first: np.ndarray) -> np.ndarray:
    """The places from ``low`` to ``high`` where a token begins; ``first`` are the texts' first bytes."""
    part = data[low:high]
    begins = (part & 0xC0) != 0x80
    letter = _letter[data[max(low - 1, 0) : high]]
    if low == 0:
        letter = np.concatenate([[False], letter])
    begins &= ~(letter[1:] & letter[:-1])
    begins[first[np.searchsorted(first, low) : np.searchsorted(first, high)] - low] = True
    return np.flatnonzero(begins) + low


def _scan(data: np.ndarray, bounds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and of the whole buffer before it."""
    counts = np.zeros(len(bounds) - 1, "i8")
    for low in range(0, len(data), WINDOW):
        at = _starts(data, low, min(low + WINDOW, len(data)), first)
        counts += np.diff(np.searchsorted(at, bounds))
    return counts, np.cumsum(counts) - counts


def _places(data: np.ndarray, ranks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the tokens of these numbers in the buffer begin."""
    place, before = np.zeros(len(ranks), "i8"), 0
    for low in range(0, len(data), WINDOW):
        at = _starts(data, low, min(low + WINDOW, len(data)), first)
        here = (ranks >= before) & (ranks < before + len(at))
        place[here] = at[ranks[here] - before]
        before += len(at)
    return place


def _chars(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Code points between each ``low`` and ``high``; the ranges ascend and do not overlap."""
    edges = np.stack([low, high], axis=1).reshape(-1)
    counts = np.zeros(len(edges), "i8")
    for start in range(0, len(data), WINDOW):
        lead = np.cumsum((data[start : start + WINDOW] & 0xC0) != 0x80)
        reach = np.clip(edges - start, 0, len(lead))
        counts += np.where(reach > 0, lead[reach - 1], 0)
    return counts[1::2] - counts[::2]


def _marked(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text holds one of the three markers."""
    found = np.zeros(len(bounds) - 1, bool)
    for low in range(0, len(data) - MARK + 1, WINDOW):
        high = min(low + WINDOW, len(data) - MARK + 1)
        letter = data[low + 1 : high + 1]
        at = (data[low:high] == 0x3C) & (data[low + 2 : high + 2] == 0x3E)
        at &= (letter == 0x50) | (letter == 0x53) | (letter == 0x4D)
        at = np.flatnonzero(at) + low
        text = np.searchsorted(bounds, at, side="right") - 1
        found[text[at + MARK <= bounds[text + 1]]] = True
    return found


def _displace(size: int, parts: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For windows of a buffer, how far each byte moves; a part moves by its shift.

    ``parts`` are the ascending beginnings of the parts. Each change of the shift is noted at
    the first byte of its part, and the running sum over the bytes is their displacement.
    """
    steps = np.diff(shifts, prepend=0)
    carried = 0
    for low in range(0, size, WINDOW):
        high = min(low + WINDOW, size)
        difference = np.zeros(high - low, "i8")
        a, b = np.searchsorted(parts, [low, high])
        np.add.at(difference, parts[a:b] - low, steps[a:b])
        difference[0] += carried
        moved = np.cumsum(difference)
        carried = int(moved[-1])
        yield low, high, moved


def _draws(key: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(key.encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def transform_chunk(texts: list[bytes], keys: list[str]) -> list[tuple]:
    """A tuple of ``FIELDS`` for each text in UTF-8; the key decides its cuts and form."""
    lengths = np.fromiter(map(len, texts), "i8", len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    low, high = bounds[:-1], bounds[1:]
    data = np.frombuffer(b"".join(texts), "u1")
    first = low[lengths > 0]
    counts, before = _scan(data, bounds, first)
    draws = np.array([_draws(k) for k in keys], "u8").reshape(-1, 4)
    cuts = np.sort((draws[:, :2] % (counts[:, None] + 1).astype("u8")).astype("i8"), axis=1)
    plain = (lengths == 0) | _marked(data, bounds) | (draws[:, 2] % 100 >= PLAIN_FROM)
    spm = ~plain & (draws[:, 3] % 100 < SPM_BELOW)

    inside = cuts < counts[:, None]
    at = np.repeat(high[:, None], 2, axis=1)
    at[inside] = _places(data, (before[:, None] + cuts)[inside], first)
    cut1, cut2 = at[:, 0], at[:, 1]
    prefix, middle, suffix = cut1 - low, cut2 - cut1, high - cut2

    out_bounds = np.concatenate([[0], np.cumsum(lengths + np.where(plain, 0, 3 * MARK))])
    out = out_bounds[:-1] - low  # how far a text's first byte moves
    shift = np.where(spm, 2 * MARK + suffix, MARK)
    parts = np.stack([low, cut1, cut2], axis=1)
    shifts = np.stack([shift, 3 * MARK + suffix, np.where(spm, MARK - prefix, 2 * MARK) - middle], axis=1)
    shifts = np.where(plain[:, None], 0, shifts) + out[:, None]

    result = np.empty(int(out_bounds[-1]), "u1")
    kept = parts.reshape(-1) < len(data)
    for a, b, moved in _displace(len(data), parts.reshape(-1)[kept], shifts.reshape(-1)[kept]):
        result[np.arange(a, b) + moved] = data[a:b]
    begin = out_bounds[:-1]
    for rows, marker, place in (
        (~plain & ~spm, PREFIX, begin),
        (~plain & ~spm, SUFFIX, begin + MARK + prefix),
        (spm, SUFFIX, begin),
        (spm, PREFIX, begin + MARK + suffix),
        (~plain, MIDDLE, begin + 2 * MARK + prefix + suffix),
    ):
        result[place[rows][:, None] + np.arange(MARK)] = np.frombuffer(marker, "u1")

    chars = np.stack([_chars(data, low, cut1), _chars(data, cut1, cut2)])
    whole = result.tobytes()
    return [
        (
            int(counts[i]),
            FORMS[0] if plain[i] else FORMS[1 + int(spm[i])],
            None if plain[i] else int(chars[0, i]),
            None if plain[i] else int(chars[1, i]),
            whole[out_bounds[i] : out_bounds[i + 1]],
        )
        for i in range(len(texts))
    ]


def restore_chunk(outputs: list[bytes], forms: list[str | None]) -> list[bytes]:
    """The texts of these outputs, from their markers and forms alone."""
    texts = []
    lengths = np.fromiter(map(len, outputs), "i8", len(outputs))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(outputs), "u1")
    n = len(outputs)
    plain = np.fromiter((f not in FORMS[1:] for f in forms), bool, n)
    spm = np.fromiter((f == FORMS[2] for f in forms), bool, n)
    second = np.fromiter(
        (0 if p else o.index(PREFIX if s else SUFFIX, MARK) for o, p, s in zip(outputs, plain, spm)), "i8", n
    )
    third = np.fromiter((0 if p else o.index(MIDDLE, k + MARK) for o, p, k in zip(outputs, plain, second)), "i8", n)
    one, two = second - MARK, third - second - MARK
    prefix, suffix = np.where(spm, two, one), np.where(spm, one, two)
    middle = lengths - third - MARK
    # a restored text's parts, by their beginnings in the restored buffer
    text_lengths = np.where(plain, lengths, lengths - 3 * MARK)
    text_bounds = np.concatenate([[0], np.cumsum(text_lengths)])
    begin = text_bounds[:-1]
    parts = np.stack([begin, begin + np.where(plain, 0, prefix), begin + np.where(plain, 0, prefix + middle)], axis=1)
    sources = np.stack([np.where(spm, second + MARK, MARK), third + MARK, np.where(spm, MARK, second + MARK)], axis=1)
    shifts = bounds[:-1, None] + sources - (parts - begin[:, None]) - begin[:, None]
    shifts = np.where(plain[:, None], (bounds[:-1] - begin)[:, None], shifts)
    size = int(text_bounds[-1])
    result = np.empty(size, "u1")
    kept = parts.reshape(-1) < size
    for a, b, moved in _displace(size, parts.reshape(-1)[kept], shifts.reshape(-1)[kept]):
        result[a:b] = data[np.arange(a, b) + moved]
    whole = result.tobytes()
    texts.extend(whole[text_bounds[i] : text_bounds[i + 1]] for i in range(n))
    return texts


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The values in UTF-8, null as empty, in chunks of bounded bytes, with the number of the first."""
    chunk, size, first = [], 0, 0
    for k, value in enumerate(column.view(pa.binary())):
        text = value.as_py() or b""
        if chunk and size + len(text) > CHUNK_BYTES:
            yield first, chunk
            chunk, size, first = [], 0, k
        chunk.append(text)
        size += len(text)
    if chunk:
        yield first, chunk


def _with(part: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, name])


_ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string()}


def transform(
    docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", seed: str = "1"
) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and a struct of ``FIELDS``, whose column name is returned too.

    The cuts and the form follow from the SHA-256 of seed, colon and key, so equal rows get
    equal outputs and a repeated task repeats them; a null key counts as an empty one. A null
    or empty text has no tokens and is plain with an empty output; a text that holds a marker
    stays plain. Texts are never shortened. An empty table gives no rows.
    """
    fim = fresh(docs, "fim")
    key = fresh(docs, "fim_key")
    schema = T.StructType([*docs.schema.fields, T.StructField(fim, FIELDS)])
    kinds = [(f.name, _ARROW[f.dataType]) for f in FIELDS]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key).to_pylist()
            plain = batch.drop_columns([key])
            for first, texts in _chunks(batch.column(text_col)):
                rows = transform_chunk(texts, keys[first : first + len(texts)])
                columns = [list(c) for c in zip(*rows)]
                arrays = [pa.array(c, pa.binary() if n == "output" else k) for c, (n, k) in zip(columns, kinds)]
                arrays[-1] = arrays[-1].view(pa.string())
                struct = pa.StructArray.from_arrays(arrays, names=[n for n, _ in kinds])
                yield _with(plain.slice(first, len(texts)), fim, struct)

    keyed = docs.withColumn(key, F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key_col).cast("string"), F.lit(""))))
    return keyed.mapInArrow(cut, schema), fim


def restore(outputs: DataFrame, output_col: str, form_col: str) -> tuple[DataFrame, str]:
    """All columns of ``outputs`` and the text each output was made of, whose column name is returned too.

    A null output gives an empty text; a form other than ``psm`` and ``spm`` counts as plain.
    An output without the markers of its form is an error.
    """
    name = fresh(outputs, "restored")
    schema = T.StructType([*outputs.schema.fields, T.StructField(name, T.StringType())])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(form_col).to_pylist()
            for first, chunk in _chunks(batch.column(output_col)):
                texts = restore_chunk(chunk, forms[first : first + len(chunk)])
                yield _with(batch.slice(first, len(chunk)), name, pa.array(texts, pa.binary()).view(pa.string()))

    return outputs.mapInArrow(gather, schema), name
