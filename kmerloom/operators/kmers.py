"""Row generators: k-mers of both strands, prefixes, split reads, translated frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import INDEX_ORDER, PROFILE_ORDER, ceil_div, digits, partial_revcomp, revcomp, translate_dna, upcase

#: Offsets of a sequence that are slid over at a time.
CHUNK = 1024


def normalised(reads: DataFrame) -> DataFrame:
    """``(read_id, name, seq)`` of a read table, ``seq`` in A, C, G, T, N; rows with null sequence are left out."""
    return reads.where(F.col("seq").isNotNull()).select("read_id", "name", upcase(F.col("seq")).alias("seq"))


def indexable(reads: DataFrame) -> DataFrame:
    """Reads without N: no others are ever indexed (F1)."""
    return reads.where(~F.col("seq").contains("N"))


def offsets(last: Column) -> Column:
    """0 to ``last`` inclusive; empty if ``last`` is negative, where a plain sequence would count down."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def slide(df: DataFrame, k: int, last: Column | None = None, seq: str = "seq") -> DataFrame:
    """Every k-mer of ``seq`` with its ``pos``, other columns kept. ``last`` is the last offset (default: inclusive).

    A sequence is first cut into stretches of CHUNK offsets, so that neither the whole of a long one is copied for each of its
    k-mers nor its letters are counted from the beginning every time; columns that nobody asks for are not copied at all.
    """
    last = F.length(seq) - k if last is None else last
    begins = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    parts = df.select("*", last.alias("_last"), F.explode(begins).alias("_begin")).withColumn("_part", F.substr(F.col(seq), F.col("_begin") + 1, F.lit(CHUNK + k - 1)))
    inside = parts.select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("_last") - F.col("_begin"), F.lit(CHUNK - 1)))).alias("_i"))
    return inside.select("*", (F.col("_begin") + F.col("_i")).alias("pos"), F.substr("_part", F.col("_i") + 1, F.lit(k)).alias("kmer")).drop("_last", "_begin", "_part", "_i")


def both_strands(reads: DataFrame) -> DataFrame:
    """Each read once as it is ('+') and once reversed ('-'); ``oriented`` is the sequence on that strand."""
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("oriented")), F.struct(F.lit("-").alias("strand"), revcomp(F.col("seq")).alias("oriented")))
    return reads.select("*", F.inline(strands))


def kmers(reads: DataFrame, k: int) -> DataFrame:
    """``(read_id, strand, pos, kmer)``, COMPLETE mode: all k-mers of both strands of reads without N."""
    return slide(both_strands(indexable(reads)), k, seq="oriented").select("read_id", "strand", "pos", "kmer")


def end_kmers(reads: DataFrame, k: int) -> DataFrame:
    """``(read_id, strand, kmer, oriented)``, ENDS mode: the prefix of both strands of reads without N."""
    long = both_strands(indexable(reads).where(F.length("seq") >= k))
    return long.select("read_id", "strand", F.substring("oriented", 1, k).alias("kmer"), "oriented")


def query_kmers(reads: DataFrame, k: int, min_overlap: int, inclusive: bool = True) -> DataFrame:
    """K-mers of the reads as queries; offsets end where less than the overlap would remain.

    Inclusive to ``len - max(k, min_overlap)`` for overlaps (X4), before ``len - min_overlap`` for prefixes (X5).
    """
    last = F.length("seq") - max(k, min_overlap) if inclusive else F.least(F.length("seq") - min_overlap - 1, F.length("seq") - k)
    return slide(reads, k, last)


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """``(kmer, n)``: how often each k-mer occurs on either strand of reads without N.

    The forward strand is counted first; only distinct k-mers are reversed and added.
    """
    forward = slide(indexable(reads).select("seq"), k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    turned = forward.select(F.inline(F.array(F.struct(F.col("kmer"), F.col("n")), F.struct(revcomp(F.col("kmer")).alias("kmer"), F.col("n")))))
    return turned.groupBy("kmer").agg(F.sum("n").alias("n"))


def split_reads(reads: DataFrame, cutoff: int = 75, min_overlap: int = 25) -> DataFrame:
    """Reads cut to windows of ``cutoff`` letters that overlap by ``min_overlap`` at least.

    Shorter reads are dropped, reads of that length kept; longer ones give ``ceil((len-o)/(cutoff-o))`` windows at equal
    steps, the last one flush right, named ``name_j/n``. ``read_id`` and ``part`` identify a row.
    """
    if not cutoff > min_overlap >= 0:
        raise ValueError("cutoff must exceed the overlap")
    n = ceil_div(F.length("seq") - min_overlap, cutoff - min_overlap).cast("int")
    step = ceil_div(F.length("seq") - cutoff, F.greatest(F.col("parts") - 1, F.lit(1))).cast("int")
    begin = F.least(F.col("part") * F.col("step"), F.length("seq") - cutoff)
    return (
        reads.where(F.length("seq") >= cutoff)
        .withColumn("parts", n).withColumn("step", step)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("beg", begin.cast("int"))
        .select(
            "read_id", "part", "beg",
            F.when(F.col("parts") > 1, F.concat("name", F.lit("_"), "part", F.lit("/"), "parts")).otherwise(F.col("name")).alias("name"),
            F.substr("seq", F.col("beg") + 1, F.lit(cutoff)).alias("seq"),
        )
    )


def fixed_length(reads: DataFrame) -> DataFrame:
    """Reads cut to the length of the shortest one (F7, K7, K8); the length is one scalar of an aggregate."""
    shortest = reads.agg(F.min(F.length("seq")).alias("n")).scalar()
    return reads.withColumn("seq", F.substr("seq", F.lit(1), shortest))


def six_frames(reads: DataFrame) -> DataFrame:
    """``(read_id, name, seq, frame, aa)``: the six translations of each read."""
    frames = F.array(*[F.struct(F.lit(f).alias("frame"), translate_dna(F.col("seq"), f).alias("aa")) for f in range(1, 7)])
    return reads.select("read_id", "name", "seq", F.inline(frames))


def profile_codes(df: DataFrame, k: int, n_policy: str = "as_a") -> DataFrame:
    """Codes of the k-mers of both strands in profile order, other columns kept.

    N counts as A on either strand (``as_a``), or k-mers with N are left out (``skip``).
    """
    if n_policy == "skip":
        plain = F.when(~F.substr("seq", F.col("pos") + 1, F.lit(k)).contains("N"), True)
    elif n_policy == "as_a":
        plain = None
    else:
        raise ValueError("n_policy is 'as_a' or 'skip'")
    seq, at = F.col("seq"), F.col("pos") + 1
    both = df.select("*", digits(seq, PROFILE_ORDER).alias("d1"), digits(seq, PROFILE_ORDER, turned=True).alias("d2"))
    words = both.select("*", F.explode(offsets(F.length("seq") - k)).alias("pos"))
    if plain is not None:
        words = words.where(plain)
    back = F.substr("d2", F.length("seq") - k - F.col("pos") + 1, F.lit(k))  # the same letters on the other strand
    code = lambda d: F.conv(d, 4, 10).cast("bigint")
    return words.withColumn("code", F.explode(F.array(code(F.substr("d1", at, F.lit(k))), code(back)))).drop("pos", "d1", "d2")


__all__ = ["INDEX_ORDER", "both_strands", "end_kmers", "fixed_length", "indexable", "kmer_counts", "kmers", "normalised", "partial_revcomp", "profile_codes", "query_kmers", "six_frames", "slide", "split_reads"]
