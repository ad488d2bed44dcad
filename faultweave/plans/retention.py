"""Which files are past their time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The retention of logs.
RETENTION_DAYS = 30
LOG_SUFFIX = ".log"


def expired(files: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Log files whose age in whole days is above ``days``."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("mtime")
    age = F.floor(seconds / F.lit(86400))
    return files.withColumn("age_days", age).where(
        F.endswith(F.col("name"), F.lit(LOG_SUFFIX)) & (F.col("age_days") > days)
    )
