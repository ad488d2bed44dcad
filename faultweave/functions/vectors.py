"""Vector expressions, and the hook for a user-given text encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[Column], Column]

# Bytes used of each digest, and the width of the stored vectors.
SHA_BYTES = 32
MD5_BYTES = 8
DEFAULT_DIM = 1024


def _hex_bytes(digest: Column, n: int) -> Column:
    # One expression per byte: unlike a lambda over positions, they share one digest per row.
    return F.array(
        *[F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / F.lit(255.0) for i in range(n)]
    )


def sha_embedding(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """The SHA-256 bytes over 255, repeated and cut to ``dim`` values."""
    values = _hex_bytes(F.sha2(text, 256), min(dim, SHA_BYTES))
    if dim <= SHA_BYTES:
        return values
    return F.slice(F.flatten(F.array_repeat(values, -(-dim // SHA_BYTES))), 1, dim)


def md5_embedding(text: Column) -> Column:
    """The first eight MD5 bytes over 255."""
    return _hex_bytes(F.md5(text), MD5_BYTES)


def as_double(vector: Column) -> Column:
    return vector.cast(T.ArrayType(T.DoubleType()))


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; floats are widened first."""
    squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def single_dimension(df: DataFrame, vector: str = "embedding") -> int | None:
    """The one vector width of a table (None when it is empty); raises when widths differ."""
    width = F.size(vector)
    low, high = df.agg(F.min(width), F.max(width)).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} values in one store; rebuild it with one embedder")
    return low


def same_dimension(store: Column, query: Column) -> Column:
    return F.size(store) == F.size(query)


def encoder_embedding(
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    batch_size: int = 32,
    normalise: bool = True,
) -> Embedder:
    """Turn a batch encoder into a column function.

    ``make_encoder`` runs once per Python worker task and returns a function from a list
    of texts to a matrix with one row per text.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            rows: list[np.ndarray] = []
            for start in range(0, len(texts), batch_size):
                matrix = np.asarray(encoder(texts.iloc[start : start + batch_size].tolist()), dtype=np.float64)
                if normalise:
                    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                    matrix = matrix / np.where(norm == 0.0, 1.0, norm)
                rows.extend(matrix)
            yield pd.Series(rows, index=texts.index, dtype=object)

    return lambda text: encode(text)


def embed_column(df: DataFrame, text: str, embed: Embedder, out: str = "embedding") -> DataFrame:
    """Add the vector of a text column; ``embed`` is any of the functions above."""
    return df.withColumn(out, embed(F.col(text)))
