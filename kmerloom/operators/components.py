"""Reads that can ever meet in one assembly: links by shared k-mers and their connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import revcomp
from ..session import checkpoint, spread
from .assembly import distinct_reads, usable
from .kmers import end_kmers, indexable, slide


def links(reads: DataFrame, k: int) -> DataFrame:
    """``(a, b)``: each read with a representative of every k-mer that it shares and that begins some read.

    Reads that hold a k-mer are linked to the lowest read that begins with it, on either strand: a star for each k-mer,
    never all pairs, however many reads share it. A k-mer and its reverse complement are one; components are those of the
    full relation.
    """
    either = lambda c: F.least(c, revcomp(F.col(c))).alias("kmer")
    hubs = end_kmers(reads, k).select("read_id", either("kmer")).groupBy("kmer").agg(F.min("read_id").alias("b"))
    held = slide(indexable(reads.select("read_id", "seq")), k).select(F.col("read_id").alias("a"), either("kmer"))
    return held.join(hubs, "kmer").where("a <> b").select("a", "b").distinct()


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, comp)``: every node with the least node of its component.

    Alternating large-star and small-star rounds keep the number of edges within that of the input and end after about
    as many rounds as the logarithm of the longest path. Each round is written to the checkpoint folder once. The joins
    stream a hub's edges against its one row of state, and the adaptive skew join splits them; no list is ever gathered.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = checkpoint(both), None
    for _ in range(max_rounds):
        ways = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        current = checkpoint(small.where("u <> v").distinct())
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    lowest = current.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return nodes.select("id").join(lowest, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def overlap_components(reads: DataFrame, k: int) -> DataFrame:
    """``(id, comp)`` of all reads without N that have a k-mer: every read with the lowest one of its component.

    Reads that are equal on either strand are one node. ``read_id`` may be of any type that has an order.
    """
    plain = usable(reads.select("read_id", F.lit(None).cast("string").alias("name"), "seq"), k)
    once = distinct_reads(plain)
    nodes = spread(once.select(F.col("id").alias("read_id"), "seq"))
    found = components(once.select("id"), links(nodes, k))
    named = found.join(once.select("id", "seq"), "id").join(once.select(F.col("id").alias("comp"), F.col("read_id").alias("lowest")), "comp")
    either = lambda c: F.least(c, revcomp(F.col(c))).alias("either")
    return plain.select(F.col("read_id").alias("id"), either("seq")).join(named.select(either("seq"), F.col("lowest").alias("comp")), "either").select("id", "comp")
