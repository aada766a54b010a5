"""Queries over the index flushes, in which a few k-mers own a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hot_keys import dominant_keys, entry_totals
from ..session import table


def _lowest_read(origins: Column) -> Column:
    return F.array_min(F.transform(origins, lambda o: F.when(o["seqid"] >= 0, o["seqid"]).otherwise(-o["seqid"] - 1)))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = table(spark, sf_dir, "hashbuckets")
    return entry_totals(buckets, "kmer", F.coalesce(F.greatest(F.size("origins"), F.lit(0)), F.lit(0)), _lowest_read(F.col("origins")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_keys(_totals(spark, sf_dir), 0.01).select(F.col("key").alias("kmer"), F.col("low").alias("read_id"))


def p1_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).select(F.col("key").alias("kmer"), "n_entries", F.col("low").alias("read_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_entries)}

_ENTRIES = """
SELECT kmer, CAST(sum(coalesce(len(origins), 0)) AS BIGINT) AS n_entries,
  min(list_min(list_transform(origins, lambda o: CASE WHEN o.seqid >= 0 THEN o.seqid ELSE -o.seqid - 1 END))) AS read_id
FROM hashbuckets GROUP BY kmer
"""

ORACLE = {
    "p1_found": f"SELECT kmer, read_id FROM ({_ENTRIES}) WHERE kmer IS NOT NULL AND n_entries * 100 >= (SELECT sum(len(origins)) FROM hashbuckets)",
    "p1_entries": _ENTRIES,
}
