"""Log files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultweave.functions.text import file_label
from faultweave.session import materialise


def read_logs(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """log_name, line_no (from 1), line.

    Large files are read in splits. A line's number is its place in its split plus the
    lines in the splits before it, so no file has to pass through one task. The lines are
    counted in one pass and numbered in another, which must cut files alike; a result that
    is computed under another ``spark.sql.files.maxPartitionBytes`` fails.

    By default each file is a log. With ``by_folder`` a log is a folder whose files, in
    name order, are its parts.
    """
    file = F.col("_metadata.file_path")
    name = F.element_at(F.split(file, "/"), -2 if by_folder else -1)
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        file_label(name).alias("log_name"),
        file.alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )
    splits = lines.groupBy("log_name", "file", "start").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("log_name").orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    offsets = materialise(splits.select("file", "start", "first", "n", before.alias("before")), "log-splits")
    place = F.col("row") - F.col("first")
    number = F.when((place >= 0) & (place < F.col("n")), place + F.col("before") + 1).otherwise(
        F.raise_error(F.lit("the files were cut otherwise when their lines were counted"))
    )
    numbered = lines.join(offsets, ["file", "start"], "left")
    return numbered.select("log_name", number.alias("line_no"), "line")
