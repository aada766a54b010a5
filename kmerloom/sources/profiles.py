"""Text forms of profile databases, training tables and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, numbered
from .fastx import read_fastx

#: Fixed value: how a profile database begins.
HEADER = "%WORD_LENGTH:"


def weight_text(w: Column) -> Column:
    """Whole numbers (within 1e-5 of their truncation) without decimals, others with five."""
    whole = F.abs(w - F.when(w < 0, F.ceil(w)).otherwise(F.floor(w))) < 0.00001
    return F.when(whole, F.format_string("%.0f", w)).otherwise(F.format_string("%7.5f", w))


def as_lines(vectors: DataFrame) -> DataFrame:
    """``(class_ord, value)`` lines ``name:v0:v1:...`` from ``(class_ord, class, vector)``."""
    return vectors.select("class_ord", F.concat_ws(":", F.coalesce("class", F.lit("")), F.array_join(F.transform("vector", weight_text), ":")).alias("value"))


def as_vectors(profiles: DataFrame) -> DataFrame:
    """``(class_ord, class, vector)`` from dense ``(class_ord, class, code, w)`` rows; a vector has 4^k entries, no more."""
    packed = F.array_sort(F.collect_list(F.struct("code", "w")))
    return profiles.groupBy("class_ord", "class").agg(F.transform(packed, lambda e: e["w"]).alias("vector"))


def write_db(profiles: DataFrame, k: int, path: str) -> None:
    """A folder of text files, header first, classes in order from file to file."""
    spark = profiles.sparkSession
    lines = as_lines(as_vectors(profiles)).unionByName(spark.createDataFrame([(-1, f"{HEADER}{k}")], "class_ord bigint, value string"))
    lines.orderBy("class_ord").select("value").write.mode("overwrite").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, line)``: the lines of files, numbered in the order of file names and places, however they are split."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return numbered(rows, "file", "block", "place", name="line").select("value", "line")


def read_db(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``(class_ord, class, code, w)`` of a text database and its word length; 7 if the header names none above 2.

    The database may be one file or many, in any number of partitions; ``class_ord`` counts its lines, the header being line 0.
    """
    lines = checkpoint(_lines(spark, path))
    head = lines.where("line = 0").first()
    digits = "".join(c for c in (head.value if head and head.value.startswith(HEADER) else "")[len(HEADER) :].strip() if c.isdigit())
    k = int(digits) if digits and int(digits) > 2 else 7
    cells = lines.where("line > 0").select("line", F.split("value", ":").alias("c"))
    rows = cells.select(F.col("line").alias("class_ord"), F.col("c")[0].alias("class"), F.posexplode(F.slice("c", 2, 4**k)).alias("code", "w"))
    return rows.select("class_ord", "class", F.col("code").cast("bigint").alias("code"), F.expr("coalesce(try_cast(w as double), 0.0)").alias("w")), k


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, class, path)`` of a table ``class<blanks>fasta``."""
    cells = F.split(F.trim("value"), "[ \t]+")
    return _lines(spark, path).where(F.trim("value") != "").select(F.col("line").alias("ord"), cells[0].alias("class"), cells[1].alias("path"))


def training_sequences(spark: SparkSession, table: DataFrame) -> DataFrame:
    """``(ord, class, seq)`` of the files of a training table; the table itself is small and listed on the driver."""
    listed = table.orderBy("ord").collect()
    classes = spark.createDataFrame([(i, r["class"]) for i, r in enumerate(listed)], "ord int, class string")
    rows = read_fastx(spark, [r["path"] for r in listed], name_stop="strict")
    return rows.select(F.col("file_ord").alias("ord"), "seq").join(F.broadcast(classes), "ord").select("ord", "class", "seq")


def bin_lines(assigned: DataFrame) -> DataFrame:
    """``>name`` and class, two lines for each read."""
    return assigned.select(F.format_string(">%s\n%s", "name", "class").alias("value"))
