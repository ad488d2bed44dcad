"""Customer scores and their bands."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lower edges of the score bands, and the rows scored per model call.
MEDIUM_FROM = 0.30
HIGH_FROM = 0.65
SCORE_CHUNK = 1000


def risk_band(score: Column) -> Column:
    """low, medium or high; scores outside [0, 1) and NaN count as high, null stays null."""
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when((score >= 0.0) & (score < MEDIUM_FROM), F.lit("low"))
        .when((score >= MEDIUM_FROM) & (score < HIGH_FROM), F.lit("medium"))
        .otherwise(F.lit("high"))
    )


def linear_score(features: dict[str, float], intercept: float = 0.0) -> Column:
    """A weighted sum of columns, for models that need no Python."""
    score = F.lit(float(intercept))
    for name, weight in features.items():
        score = score + F.col(name) * F.lit(float(weight))
    return score


def score_customers(
    customers: DataFrame, features: Sequence[str], scaler: Any, model: Any, out: str = "score"
) -> DataFrame:
    """Add the class-1 probability of a fitted model, scored in chunks inside Arrow batches.

    ``scaler`` has ``transform`` and ``model`` has ``predict_proba``; both travel to the
    workers with the function.
    """

    @F.pandas_udf("double")
    def probability(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            frame = pd.concat(columns, axis=1, keys=list(features))
            parts = [
                np.asarray(model.predict_proba(scaler.transform(frame.iloc[i : i + SCORE_CHUNK])))[:, 1]
                for i in range(0, len(frame), SCORE_CHUNK)
            ]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return customers.withColumn(out, probability(*[F.col(c) for c in features]))
