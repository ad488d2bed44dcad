"""Portfolio risk totals and calendar checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.operators.skew import skewed_join


def positions_with_factors(positions: DataFrame, factors: DataFrame, skewed: bool = False) -> DataFrame:
    """Each position with each of its instrument's risk factors, or with none.

    With ``skewed``, instruments that very many positions hold are found and dealt first.
    """
    if skewed:
        return skewed_join(positions, factors, ["instrument_id"], "left", spread=["position_id"])
    return positions.join(factors, "instrument_id", "left")


def risk_totals(positions: DataFrame, factors: DataFrame) -> DataFrame:
    """Notional, risk and positions per portfolio and currency over the left join above.

    Both sides are added up per instrument before they meet, so a hot instrument crosses
    the network as a few rows and several factors multiply sums in place of rows.
    """
    held = positions.groupBy("instrument_id", "portfolio_id", "currency_code").agg(
        F.sum("notional_value").alias("notional"),
        F.count("position_id").alias("positions"),
        F.count("*").alias("rows"),
    )
    weights = factors.groupBy("instrument_id").agg(
        F.sum("risk_weight").alias("weight"), F.count("*").alias("factors")
    )
    copies = F.coalesce("factors", F.lit(1).cast("long"))
    return (
        held.join(weights, "instrument_id", "left")
        .groupBy("portfolio_id", "currency_code")
        .agg(
            F.sum(F.col("notional") * copies).alias("total_notional"),
            F.sum(F.col("weight") * F.col("rows")).alias("total_risk"),
            F.sum(F.col("positions") * copies).alias("position_count"),
        )
    )


# When a day counts as month end, and the months that end a quarter.
MONTH_END_DAY = 28
QUARTER_END_MONTHS = (3, 6, 9, 12)


def is_month_end(date: Column) -> Column:
    return F.dayofmonth(date) >= MONTH_END_DAY


def is_quarter_end(date: Column) -> Column:
    return is_month_end(date) & F.month(date).isin(*QUARTER_END_MONTHS)


def volume_period(df: DataFrame, date: str) -> DataFrame:
    """Add month_end, quarter_end and high_volume."""
    month_end, quarter_end = is_month_end(F.col(date)), is_quarter_end(F.col(date))
    return df.withColumns(
        {"month_end": month_end, "quarter_end": quarter_end, "high_volume": month_end | quarter_end}
    )


def instrument_count(df: DataFrame, run: str, instrument: str = "instrument_id") -> DataFrame:
    """Instruments and records per run."""
    return df.groupBy(run).agg(F.countDistinct(instrument).alias("instruments"), F.count("*").alias("records"))
