"""Which reads are used: stored and restored as a table, counted and picked from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a read.
NEW, BOOKED, USED = 0, 1, 2


def store_used(used: DataFrame, path: str) -> None:
    """Write the ids of used reads."""
    used.select("read_id").distinct().write.mode("overwrite").parquet(path)


def restore_used(reads: DataFrame, path: str) -> DataFrame:
    """Reads that are not in the stored table; stored ids that the reads lack are an error."""
    used = reads.sparkSession.read.parquet(path)
    if not used.join(reads, "read_id", "left_anti").isEmpty():
        raise ValueError("the stored state belongs to other reads")
    return unused(reads, used)


def unused(reads: DataFrame, used: DataFrame) -> DataFrame:
    """Reads not among the used ones."""
    return reads.join(used.select("read_id"), "read_id", "left_anti")


def next_seeds(reads: DataFrame) -> DataFrame:
    """``(file_ord, read_id)``: the first new read of each file, in file order (T5, A1)."""
    return reads.where(F.col("flag") == NEW).groupBy("file_ord").agg(F.min("read_id").alias("read_id"))


def fullest(reads: DataFrame) -> DataFrame:
    """``(file_ord, n)``: the file with most new reads, ties to the lower number; no row if none is new (C4)."""
    left = reads.where((F.col("flag") == NEW) & F.col("file_ord").isNotNull()).groupBy("file_ord").agg(F.count(F.lit(1)).alias("n"))
    return left.orderBy(F.desc("n"), "file_ord").limit(1)


def depleted(reads: DataFrame) -> DataFrame:
    """``(total, used, share)`` of the reads: the measure of early termination."""
    return reads.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("flag") == USED).alias("used")).withColumn("share", F.when(F.col("total") > 0, F.col("used") / F.col("total")))
