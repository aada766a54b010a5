"""Incremental counters over arriving reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Parquet files of reads as they are put into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def progress(reads: DataFrame) -> DataFrame:
    """Per file: reads so far, their letters, and the reads already used. The same plan serves a batch table.

    Only algebraic states are kept, one for each file.
    """
    return reads.groupBy("file_ord").agg(
        F.count(F.lit(1)).alias("n_reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("bigint").alias("n_letters"), F.count_if(F.col("flag") == 2).alias("n_used")
    )
