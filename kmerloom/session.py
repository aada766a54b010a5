"""Session helpers shared by all operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context; their Python may not find it otherwise."""
    sc = spark.sparkContext
    if not getattr(sc, "_kmerloom_shipped", False):
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='kmerloom-')}/{package.name}", "zip", package.parent, package.name)
        sc.addPyFile(archive)
        sc._kmerloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory, columns pruned by whoever reads it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the folder that the cluster names.

    A directory of our own is set only where the session has none and runs in local mode (tests).
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kmerloom-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    ship(df.sparkSession)
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpoint``, in columns that are compressed: for rows with letters. The folder stays beside the checkpoints until these are cleared."""
    ship(df.sparkSession)
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a Python-heavy stage at least one input partition per core.

    A small scan may put all rows into a few tasks, whatever the number of splits, and so may a table written from
    coalesced shuffles; only inputs of few partitions are shuffled. ``df`` is a scan or a checkpoint with narrow steps.
    """
    ship(df.sparkSession)
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts >= 4 * cores or len(df.inputFiles()) >= cores:  # few partitions hold few files
        return df
    many = max(cores, parts)
    return df.repartition(many, *keys) if keys else df.repartition(many)


def numbered(df: DataFrame, *order: str, name: str = "i") -> DataFrame:
    """Adds ``name``, 0, 1, 2 ... in the given order, without putting the rows in one task.

    The rows are sorted in ranges; only the number of rows in each range is put in sequence.
    """
    rows = checkpoint(df.orderBy(*order).withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id() % (1 << 33)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size")).select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "_range").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


def scratch(spark: SparkSession) -> str:
    """A new folder for files, beside the checkpoints, where all executors can read and write."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
