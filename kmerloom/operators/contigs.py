"""Contig tables: statistics, filters, tiers and the text forms they are written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import gc_content

#: Shortest contig that is written, and the length tiers of the exact assembler.
MIN_LENGTH = 125
TIERS = (300, 600, 2000)


def emitted(contigs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Contigs longer than ``min_length`` letters of their sequence."""
    return contigs.where(F.length("seq") > min_length)


def filtered(contigs: DataFrame, min_len: int = 0, min_cov: float = 0.0) -> DataFrame:
    """Contigs of at least that length and coverage; nulls pass neither."""
    return contigs.where((F.col("len") >= min_len) & (F.col("cov") >= min_cov))


def longest_first(contigs: DataFrame) -> DataFrame:
    """By falling length, ties by ``contig_id`` and sequence."""
    return contigs.orderBy(F.desc("len"), "contig_id", "seq")


def tier(length: Column) -> Column:
    """'short', 'medium' or 'long'; null below the shortest tier."""
    low, medium, long = TIERS
    return F.when(length >= long, "long").when(length >= medium, "medium").when(length >= low, "short")


def coverage(edges: DataFrame) -> DataFrame:
    """``(contig, cov, stdev)`` from ``(contig, span, weight, length)``: mean and population deviation of the weight over
    the letters of a contig (C7, C8, C9); rounding below zero is cut off."""
    sums = edges.groupBy("contig").agg(
        F.sum(F.col("span") * F.col("weight")).alias("w"), F.sum(F.col("span") * F.col("weight") * F.col("weight")).alias("w2"), F.max("length").alias("n")
    )
    mean = F.col("w") / F.col("n")
    return sums.select("contig", mean.alias("cov"), F.sqrt(F.greatest(F.lit(0.0), F.col("w2") / F.col("n") - mean * mean)).alias("stdev"))


def _text(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(value.isNotNull(), F.format_string("%.1f", value)).otherwise("")


def as_table(contigs: DataFrame) -> DataFrame:
    """Tab-separated lines of seven columns (O1); nulls are empty."""
    cells = [F.coalesce(F.col("contig_id"), F.lit("")), F.coalesce(F.col("len").cast("string"), F.lit("")), _text("cov"), _text("stdev"), _text("gc"), F.coalesce(F.col("seed"), F.lit("")), F.coalesce(F.col("seq"), F.lit(""))]
    return contigs.select(F.array_join(F.array(*cells), "\t").alias("value"))


#: The labels of the fields that follow the id in a header, in order, and what each holds.
HEADER_FIELDS = {"len": r"\d+", "cov": r"[0-9.]+", "stdev": r"[0-9.]+", "GC": r"[0-9.]+", "seed": r"\S+"}


def fasta_header(spaced: bool = False) -> Column:
    """``>id_len_..._cov_..._stdev_..._GC_..._seed_...``; with a blank after the id if ``spaced``."""
    shown = {"len": F.coalesce(F.col("len").cast("string"), F.lit("")), "seed": F.coalesce(F.col("seed"), F.lit(""))}
    parts = [F.lit(">"), F.coalesce(F.col("contig_id"), F.lit(""))]
    for i, label in enumerate(HEADER_FIELDS):
        parts += [F.lit(f"{' ' if spaced and i == 0 else '_'}{label}_"), shown.get(label, _text(label.lower()))]
    return F.concat(*parts)


def as_fasta(contigs: DataFrame, spaced: bool = False) -> DataFrame:
    return contigs.select(F.concat(fasta_header(spaced), F.lit("\n"), F.coalesce("seq", F.lit(""))).alias("value"))


def from_fasta(records: DataFrame, min_len: int = 0) -> DataFrame:
    """Contig rows from ``(header, seq)`` records whose header has the six fields; others are left out.

    The id ends at a blank or at ``_len_``.
    """
    pattern = r"^>?(\S+?)(?:\s+|_)" + "_".join(f"{label}_({form})" for label, form in HEADER_FIELDS.items())
    part = lambda i: F.regexp_extract("header", pattern, i)
    rows = records.where(F.col("header").rlike(pattern)).select(
        part(1).alias("contig_id"), part(2).cast("int").alias("len"), part(3).cast("double").alias("cov"), part(4).cast("double").alias("stdev"),
        part(5).cast("double").alias("gc"), part(6).alias("seed"), "seq",
    )
    return rows.where(F.col("len") >= min_len)


def as_dot(edges: DataFrame, least_weight: float | None = None) -> DataFrame:
    """Graphviz statements of ``(src, dst, weight)`` edges, one line each (O8); put them between ``digraph {`` and ``}``.

    All edges are drawn unless ``least_weight`` leaves out lighter ones.
    """
    drawn = edges if least_weight is None else edges.where(F.col("weight") >= least_weight)
    return drawn.select(F.format_string('"%s" -> "%s" [label="%s"];', F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string")).alias("value"))


def with_gc(contigs: DataFrame) -> DataFrame:
    return contigs.withColumn("gc", gc_content(F.col("seq")))


def write_table(contigs: DataFrame, path: str, append: bool = False) -> None:
    """O1 with O3: appended when resuming, else overwritten."""
    as_table(contigs).write.mode("append" if append else "overwrite").text(path)


def write_fasta(contigs: DataFrame, path: str, append: bool = False) -> None:
    as_fasta(contigs).write.mode("append" if append else "overwrite").text(path)


def write_tiers(contigs: DataFrame, path: str) -> None:
    """One folder for each tier."""
    rows = contigs.withColumn("tier", tier(F.length("seq"))).where(F.col("tier").isNotNull())
    rows.write.mode("overwrite").partitionBy("tier").parquet(path)
