"""Quality rules, lines first: failing lines go, then documents that lost too much.

Each line is judged by itself:

- punctuation: a line of fewer than 12 words must end in a stop, colon or semicolon;
- navigation: a fifth of its words or more are bare separators;
- boilerplate: fewer than 20 words with one of the fixed phrases;
- symbols: more than one symbol of ``#*$%&|<>`` per five words;
- shouting: at least five words, with more letters A-Z than a-z, or ``!!`` and ``??`` for more
  than every second word;
- stutter: at least eight words, of which more than half equal the word before them.

A line without words is kept and counts for nothing. A document is rejected by the base
rules (fewer than 20 words, or over 30 % of its words in 8-word windows that repeat), or if
the removed lines held more than half of the characters of its words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultweave.llm.common import fresh

WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
ENDING = r"""[.!?…:;。！？]["'”’»)\]]*[\x20\x09-\x0D]*\Z"""
SEPARATOR = "[|»›>•·/~=_*–—-]+"
BOILERPLATE = (
    rb"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie|javascript|lorem ipsum|click here"
    rb"|sign (up|in) |log ?in |subscribe|share this|read more|skip to content|powered by)"
)
WINDOW = 8
MIN_WORDS = 20
#: Bytes of text whose words are in memory at a time; a longer text is alone.
CHUNK_BYTES = 1_000_000

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_lines_removed", T.LongType()),
        T.StructField("chars_removed", T.LongType()),
        T.StructField("clean_text", T.StringType()),
    ]
)

_ending = re.compile(ENDING)
_separator = re.compile(SEPARATOR)
_separator_bytes = bytes(set("|»›>•·/~=_*–—-".encode()))
_boilerplate = re.compile(BOILERPLATE)
_lower, _upper = bytes(range(97, 123)), bytes(range(65, 91))


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def line_fails(line: bytes, words: list[bytes], n_symbols: int) -> bool:
    """Whether a line of UTF-8 fails; ``words`` are those of the line."""
    n = len(words)
    if not n:
        return False
    if n < 12 and not _ending.search(line.decode(errors="replace")):
        return True
    if 5 * n_symbols > n:
        return True
    if n < 20 and _boilerplate.search(line):
        return True
    # only words of these bytes can be separators
    if 5 * (n - len(line.translate(None, _separator_bytes).split())) >= n:
        if 5 * sum(1 for w in words if _separator.fullmatch(w.decode(errors="replace"))) >= n:
            return True
    if n >= 5 and (_count(line, _upper) > _count(line, _lower) or 2 * (line.count(b"!!") + line.count(b"??")) > n):
        return True
    return n >= 8 and 2 * sum(map(eq, words, islice(words, 1, None))) > n


def _repeats(codes: np.ndarray, docs: np.ndarray, n_docs: int, exact: bool) -> np.ndarray:
    """Words of each document in windows of equal codes that it holds twice or more."""
    if len(codes) < WINDOW:
        return np.zeros(n_docs, "i8")
    inside = docs[: 1 - WINDOW] == docs[WINDOW - 1 :]
    if exact:  # numbers of pairs, of pairs of pairs, and so on: equal numbers mean equal windows
        window, width = codes, 1
        while width < WINDOW:
            _, window = np.unique(window[:-width] * (int(window.max()) + 1) + window[width:], return_inverse=True)
            width *= 2
        window = window[inside] * n_docs + docs[: 1 - WINDOW][inside]
    else:
        window = np.zeros(len(inside), "u8")
        for k in range(WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(inside)].view("u8")
        window = (window + docs[: 1 - WINDOW].astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F))[inside]
    starts = np.flatnonzero(inside)
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    starts = starts[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))]
    cover = np.zeros(len(codes) + 1, "i8")
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return np.bincount(docs[np.cumsum(cover[:-1]) > 0], minlength=n_docs)


def repeat_words(words: list[list[bytes]]) -> list[int]:
    """Words of each document in 8-word windows that it holds twice or more, first included.

    Hashes find the documents that may have such windows; those are counted exactly.
    """
    counts = np.array([len(w) for w in words], "i8")
    hashes = np.fromiter((h for w in words for h in map(hash, w)), "i8", int(counts.sum()))
    found = _repeats(hashes, np.repeat(np.arange(len(words)), counts), len(words), exact=False)
    maybe = np.flatnonzero(found)
    if len(maybe):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids = np.fromiter((number[w] for i in maybe for w in words[i]), "i8", int(counts[maybe].sum()))
        found[maybe] = _repeats(ids, np.repeat(np.arange(len(maybe)), counts[maybe]), len(maybe), exact=True)
    return found.tolist()


def measure(texts: list[bytes]) -> list[tuple]:
    """A tuple of ``FIELDS`` for each text in UTF-8."""
    rows, all_words = [], []
    for text in texts:
        seen: set[bytes] = set()
        symbols = repeats = removed = lost = 0
        kept_lines, in_text = [], []
        lines = text.split(b"\n")
        for line in lines:
            words = line.split()
            if words:
                n_symbols = _count(line, SYMBOLS)
                symbols += n_symbols
                repeats += line in seen
                seen.add(line)
                in_text += words
                if line_fails(line, words, n_symbols):
                    removed += 1
                    lost += _word_chars(line)
                    continue
            kept_lines.append(line)
        all_words.append(in_text)
        rows.append((len(in_text), _word_chars(text), symbols, repeats, len(lines), removed, lost, b"\n".join(kept_lines)))
    result = []
    for (n_words, chars, symbols, repeats, n_lines, removed, lost, clean), again in zip(rows, repeat_words(all_words)):
        failed = n_words < MIN_WORDS or 100 * again > 30 * n_words
        kept = not failed and 2 * lost <= chars
        result.append((n_words, chars, symbols, repeats, again, failed, kept, n_lines, removed, lost, clean))
    return result


def _word_chars(data: bytes) -> int:
    """Code points outside white space: bytes that do not continue a code point."""
    return len(data) - _count(data, WHITE + _continuing)


_continuing = bytes(range(0x80, 0xC0))


def _chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def line_first(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs`` and a struct of ``FIELDS``, whose column name is returned too.

    A null text counts as an empty one and its ``clean_text`` is empty; it fails for want of
    words. Rows are judged one by one, so repeated rows get equal verdicts.
    """
    verdict = fresh(docs, "quality")
    schema = T.StructType([*docs.schema.fields, T.StructField(verdict, FIELDS)])
    fields = [(f.name, _ARROW[f.dataType]) for f in FIELDS]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col).view(pa.binary())
            rows = 0
            for chunk in _chunks(t.as_py() or b"" for t in column):
                arrays = [pa.array(values, kind) for values, (_, kind) in zip(zip(*measure(chunk)), fields)]
                arrays[-1] = arrays[-1].view(pa.string())
                struct = pa.StructArray.from_arrays(arrays, names=[n for n, _ in fields])
                part = batch.slice(rows, len(chunk))
                yield pa.RecordBatch.from_arrays([*part.columns, struct], [*part.schema.names, verdict])
                rows += len(chunk)

    return docs.mapInArrow(judge, schema), verdict


_ARROW = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.binary()}


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, their failing lines removed; ``n_chars`` follows the text."""
    judged, verdict = line_first(docs)
    return cleaned(judged.where(f"`{verdict}`.kept"), docs.columns, f"`{verdict}`.clean_text")


def cleaned(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` of ``rows`` with another text and the number of its characters."""
    new = {"text": F.expr(text), "n_chars": F.length(F.expr(text)).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])
