"""Contigs of reads of any length by exact overlaps: reads within others are dropped, the rest joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread
from .assembly import assembled, distinct_reads, usable
from .contigs import TIERS, tier
from .overlap import within


def outermost(once: DataFrame, k: int) -> DataFrame:
    """Distinct reads that occur within no longer one, on either strand.

    A read within another is a match of its whole length: only k-mers that begin reads leave their task, and pairs are compared
    where these meet (see ``overlap.within``).
    """
    rows = spread(once).select(F.col("id").alias("read_id"), "seq")
    return once.join(within(rows, k).select(F.col("read_id").alias("id")), "id", "left_anti")


def exact_contigs(reads: DataFrame, k: int = 25, min_length: int = TIERS[0]) -> DataFrame:
    """``(seed_id, len, tier, seed, seq)`` of contigs of at least ``min_length`` letters, from ``(read_id, name, seq)`` reads.

    Each read goes on to the one that it overlaps longest, where that is mutual. Reads with N, null ones, those without an id and those
    shorter than ``k`` are left out; reads within others lengthen nothing and are dropped. An empty table gives no rows.
    """
    found = assembled(checkpoint(outermost(distinct_reads(usable(reads, k)), k)), k, by_letter=False)
    return found.where(F.col("len") >= min_length).select("seed_id", "len", tier(F.col("len")).alias("tier"), "seed", "seq")
