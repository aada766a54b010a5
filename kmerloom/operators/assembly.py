"""Assembly by joins: every strand of every read chooses the read that continues it, and mutual choices make paths.

There is one definition at every size. No component, graph or path is gathered anywhere: overlaps are an equi-join of
ends and beginnings (see ``ends``), choices are sums and maxima by read, paths are ranked by pointer doubling, and
the letters that the reads of a path add are put together as the contig that they are.

A read continues a strand if it begins with at least ``k`` letters that end the strand and has more. The ways on
differ by their next letter. Contigs take the way that most reads go (copies counted), ties in the order A, C, G, T, and on
it the read with the longest overlap, ties to the lowest read (the highest, where the lowest is the strand's own read). A step
is taken if the reverse complement of its target chooses the way back over the same overlap. ``unitigs`` and ``exact_contigs``
take the longest overlap, whatever its next letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import revcomp
from ..session import checkpoint, spread
from ..session import numbered as number_rows
from .contigs import MIN_LENGTH, with_gc
from .ends import beginnings, end_sieves, same_read, tails
from .kmers import indexable

#: Contigs whose reads are added up together.
PART = 100_000
CONTIG = ["seed_id", "len", "cov", "stdev", "seed", "reads", "seq"]


def usable(reads: DataFrame, k: int) -> DataFrame:
    """Reads that take part: with an id, without N, of ``k`` letters at least."""
    if k <= 8:
        raise ValueError("the overlap must exceed 8")
    return indexable(reads.select("read_id", "name", "seq")).where((F.length("seq") >= k) & F.col("read_id").isNotNull())


def distinct_reads(reads: DataFrame) -> DataFrame:
    """``(id, occr, read_id, name, seq)``: reads that are equal on either strand as one, in file order.

    The first of them gives name and strand. ``id`` is made while they are written in order of ``read_id``, which may be of any
    type that has an order; it is unique whatever the ids look like.
    """
    either = F.least("seq", revcomp(F.col("seq")))
    once = reads.groupBy(either.alias("either")).agg(F.count(F.lit(1)).alias("occr"), F.min(F.struct("read_id", "name", (F.col("seq") != either).alias("back"))).alias("first"))
    rows = once.select("occr", F.col("first.read_id").alias("read_id"), F.col("first.name").alias("name"), F.when(F.col("first.back"), revcomp(F.col("either"))).otherwise(F.col("either")).alias("seq"))
    return checkpoint(rows.orderBy("read_id").withColumn("id", F.monotonically_increasing_id()))


def strands(once: DataFrame) -> DataFrame:
    """``(node, occr, seq)``: both strands of each read; a node is twice the read's id, and one more for its reverse complement."""
    both = F.array(F.struct(F.lit(0).alias("turned"), F.col("seq").alias("oriented")), F.struct(F.lit(1).alias("turned"), revcomp(F.col("seq")).alias("oriented")))
    return once.select("id", "occr", F.inline(both)).select((F.col("id") * 2 + F.col("turned")).alias("node"), "occr", F.col("oriented").alias("seq"))


def choices(nodes: DataFrame, k: int, by_letter: bool) -> DataFrame:
    """``(node, next, ovl, weight)``: how each strand goes on, and the number of reads that go that way.

    ``by_letter`` weighs the next letters against each other; otherwise all continuing reads are one way. Beginnings are
    added up by key, so an end meets one row for each next letter, and a key that a third of all ends share is
    split by the adaptive join without copying more than these. No key is heavy on the added-up side, which is hashed.
    """
    letter = F.col("base") if by_letter else F.lit(0).cast("smallint")
    firsts, lasts = end_sieves(nodes, k)
    index = beginnings(nodes, k, lasts).groupBy("h", "g", "n", letter.alias("base")).agg(F.sum("occr").alias("reads"), F.min("node").alias("low"), F.max("node").alias("high"))
    other = F.when(~same_read(F.col("node"), F.col("low")), F.col("low")).when(~same_read(F.col("node"), F.col("high")), F.col("high"))
    met = tails(nodes, k, firsts).join(index.hint("shuffle_hash"), ["h", "g", "n"]).withColumn("next", other).where(F.col("next").isNotNull())
    ways = met.groupBy("node", "base").agg(F.sum("reads").alias("weight"), F.max("n").alias("ovl"), F.max_by("next", "n").alias("next"))
    best = ways.groupBy("node").agg(F.max(F.struct("weight", (-F.col("base")).alias("order"), "ovl", "next")).alias("b"))
    return best.select("node", "b.next", "b.ovl", "b.weight")


def mutual(chosen: DataFrame) -> DataFrame:
    """The choices that the other strand makes as well: at most one into and one out of each node."""
    back = chosen.select(F.col("next").bitwiseXOR(1).alias("node"), F.col("node").bitwiseXOR(1).alias("next"), "ovl")
    return chosen.join(back, ["node", "next", "ovl"], "left_semi")


def ranked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, head, place)``: the first node of each node's path and the steps from it; closed paths begin at their least node.

    Pointer doubling: a path of n nodes takes log n rounds, in which only unfinished nodes look anything up. A round that
    finishes no node and lowers no minimum has left closed paths alone, which are opened and ranked in the same way.
    """
    before = edges.select(F.col("next").alias("node"), F.col("node").alias("head"))
    first = F.col("head").isNull()
    at = checkpoint(nodes.select("node").join(before, "node", "left").select(
        "node", F.coalesce("head", "node").alias("head"), F.when(first, 0).otherwise(1).cast("bigint").alias("place"), F.least("node", "head").alias("low"), first.alias("done"),
    ))
    state = None
    while True:
        waiting = at.where("not done")
        now = waiting.agg(F.count(F.lit(1)), F.sum(F.col("low").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        up = at.select(F.col("node").alias("head"), F.col("head").alias("head_2"), F.col("place").alias("place_2"), F.col("low").alias("low_2"), F.col("done").alias("done_2"))
        moved = waiting.join(up, "head").select("node", F.col("head_2").alias("head"), (F.col("place") + F.col("place_2")).alias("place"), F.least("low", "low_2").alias("low"), F.col("done_2").alias("done"))
        at = checkpoint(at.where("done").unionByName(moved))
    open_paths = at.where("done").select("node", "head", "place")
    if now[0] == 0:
        return open_paths
    ring = waiting.select("node", "low")
    cut = edges.join(ring.select("node").where("node = low"), edges["next"] == ring["node"], "left_anti")
    return open_paths.unionByName(ranked(ring, cut.join(ring.select("node"), "node", "left_semi")))


def assembled(once: DataFrame, k: int, by_letter: bool) -> DataFrame:
    """``(seed_id, len, cov, stdev, seed, reads, seq)`` of the paths of distinct reads; ``reads`` counts those on the path, copies included.

    Of the two strands of a path the one on which its lowest read, the seed, stands as stored is kept. The letters that a step
    adds weigh as many reads as go that way, those of the first read as many as its copies; coverage is the mean of
    the weights over the letters, with its population deviation (C7 to C9).
    """
    nodes = strands(spread(once))
    edges = checkpoint(mutual(choices(nodes, k, by_letter)))
    at = checkpoint(ranked(nodes, edges))
    seeds = at.groupBy("head").agg(F.min("node").alias("seed_node")).where(F.col("seed_node") % 2 == 0)
    into = edges.select(F.col("next").alias("node"), "ovl", "weight")
    kept = at.join(seeds, "head").join(into, "node", "left").join(nodes, "node")
    added = kept.select(
        "head", "seed_node", "place", F.substr("seq", F.when(F.col("place") > 0, F.col("ovl")).otherwise(0) + 1, F.length("seq")).alias("letters"),
        F.when(F.col("place") > 0, F.col("weight")).otherwise(F.col("occr")).cast("double").alias("w"), "occr",
    )
    n = F.length("letters")
    paths = added.groupBy("head").agg(  # the letters of one path are one contig
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letters"))), lambda p: p["letters"]), "").alias("seq"),
        F.sum(n * F.col("w")).alias("w"), F.sum(n * F.col("w") * F.col("w")).alias("w2"), F.min("seed_node").alias("seed_node"), F.sum("occr").alias("reads"),
    )
    mean = F.col("w") / F.length("seq")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("w2") / F.length("seq") - mean * mean))
    rows = paths.select(F.shiftright("seed_node", 1).alias("id"), F.length("seq").alias("len"), mean.alias("cov"), deviation.alias("stdev"), "reads", "seq")
    return rows.join(once.select("id", F.col("read_id").alias("seed_id"), F.col("name").alias("seed")), "id").select(*CONTIG)


def contigs(reads: DataFrame, k: int = 25, min_length: int = MIN_LENGTH) -> DataFrame:
    """``(seed_id, len, cov, stdev, gc, seed, seq)`` of contigs longer than ``min_length``, from ``(read_id, name, seq)``
    reads of one length (A1 to A13, V27, C7 to C9, T4, F4).

    Reads with N, shorter than ``k`` or null, and those without an id are left out; each other read stands in one contig. ``read_id`` may be a
    struct; its order is that of the file. An empty table gives no rows, and other columns play no part.
    """
    found = assembled(distinct_reads(usable(reads, k)), k, by_letter=True)
    return with_gc(found.where(F.col("len") > min_length)).select("seed_id", "len", "cov", "stdev", "gc", "seed", "seq")


def unitigs(reads: DataFrame, k: int) -> DataFrame:
    """Contigs of any length along longest overlaps, in the columns of ``contigs`` without ``gc``."""
    return assembled(distinct_reads(usable(reads, k)), k, by_letter=False).drop("reads")


def until_depleted(reads: DataFrame, k: int, share: float) -> DataFrame:
    """Contigs of any length in the order of their seeds, until ``share`` of the usable reads stands in them (A2); columns as
    ``contigs`` without ``gc``, and ``reads``.

    The last one may exceed the share. Reads used before a contig are added up in ranges, not in one task.
    """
    found = number_rows(assembled(distinct_reads(usable(reads, k)), k, by_letter=True), "seed_id")
    parts = found.withColumn("part", F.floor(F.col("i") / PART))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    sums = parts.groupBy("part").agg(F.sum("reads").alias("sum")).select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("part").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    used = parts.join(F.broadcast(sums), "part").withColumn("used", F.col("earlier") + F.coalesce(F.sum("reads").over(within), F.lit(0)))
    total = found.agg(F.coalesce(F.sum("reads"), F.lit(0)).alias("n")).scalar()
    return used.where(F.col("used") < total * F.lit(share)).select(*CONTIG)


def numbered(contigs: DataFrame, rank: int = 0) -> DataFrame:
    """Adds ``contig_id``, ``Contig_<rank>_<i>`` with ``i`` counting from 0 in the order of the seeds (O1)."""
    rows = number_rows(contigs, "seed_id")
    return rows.select(F.format_string(f"Contig_{rank}_%d", "i").alias("contig_id"), *contigs.columns)
