"""Column expressions over DNA and protein sequences.

All of them stay in the JVM, give null for null and an empty result for an empty sequence, and take
sequences of any length. Functions that expect letters A, C, G, T, N say so; ``upcase`` makes them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases in the order of k-mer and codon codes, and in the order of profile vectors.
INDEX_ORDER = "ACGT"
PROFILE_ORDER = "AGCT"
#: The standard genetic code, codons counted in the order T, C, A, G.
CODON_ORDER = "TCAG"
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Statistics of gapped alignment scores.
LAMBDA, KAPPA = 0.267, 0.041


def upcase(seq: Column) -> Column:
    """A, C, G, T of either case in upper case, every other character N (V1); most sequences need no change."""
    return F.when(seq.rlike("[^ACGTN]"), F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", "N")).otherwise(seq)


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters other than A, C, G, T stay (V2, V5)."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def revcomp_prefix(seq: Column, n: Column | int) -> Column:
    """Reverse complement of the first ``n`` letters (V3)."""
    return revcomp(F.substring(seq, 1, n))


def partial_revcomp(seq: Column, beg: Column | int) -> Column:
    """Reverse complement without its first ``beg`` letters (V4)."""
    return F.substr(revcomp(seq), F.lit(beg) + 1)


def base_index(base: Column) -> Column:
    """0 to 3 for A, C, G, T; others count as A (V6)."""
    return F.greatest(F.translate(F.regexp_replace(base, "[^ACGT]", "A"), INDEX_ORDER, "0123").cast("int"), F.lit(0))


def gc_content(seq: Column) -> Column:
    """Percentage of G and C among all letters; null for an empty sequence."""
    return F.when(F.length(seq) > 0, F.lit(100.0) * F.length(F.regexp_replace(seq, "[^GCgc]", "")) / F.length(seq))


def is_protein(seq: Column) -> Column:
    """Whether a letter occurs that no DNA sequence has (V8 of molecules, F8)."""
    return seq.rlike("[BD-FH-MO-SU-Z]")


def hamming(a: Column, b: Column) -> Column:
    """Share of differing letters over the shorter of two sequences; null if that is empty (V8)."""
    n = F.least(F.length(a), F.length(b))
    left, right = F.split(F.substring(a, 1, n), ""), F.split(F.substring(b, 1, n), "")
    differ = F.size(F.filter(F.zip_with(left, right, lambda x, y: x != y), lambda d: d))
    return F.when(n > 0, differ / n)


def hamming_prefix(a: Column, b: Column, n: int) -> Column:
    """``hamming`` over the first ``n`` letters (V9)."""
    return hamming(F.substring(a, 1, n), F.substring(b, 1, n))


def first_mismatch(a: Column, b: Column) -> Column:
    """Offset of the first differing letter over the shorter sequence, -1 if none differs."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(F.substring(a, 1, n), ""), F.split(F.substring(b, 1, n), ""), lambda x, y: x == y)
    return F.array_position(same, F.lit(False)).cast("int") - 1


def read_of(seqid: Column) -> Column:
    """Read of a strand-signed id: the id itself, or ``-id-1`` for a reverse complement."""
    return F.when(seqid >= 0, seqid).otherwise(-seqid - 1)


def ceil_div(x: Column, d: Column | int) -> Column:
    """Quotient rounded up, 0 for ``x`` up to 0."""
    return F.greatest(F.ceil(x / F.lit(d)), F.lit(0).cast("bigint"))


def translate_dna(seq: Column, frame: int) -> Column:
    """Protein of one of six frames, 4 to 6 on the reverse strand, ended by the first codon with N."""
    if frame not in range(1, 7):
        raise ValueError("frames are 1 to 6")
    strand = seq if frame <= 3 else revcomp(seq)
    start = (frame - 1) % 3
    digits = F.translate(F.substr(strand, F.lit(start + 1), F.length(seq)), CODON_ORDER + "N", "0123n")

    def amino(codon: Column) -> Column:
        return F.when(codon.contains("n"), "\n").otherwise(F.substr(F.lit(GENETIC_CODE), F.conv(codon, 4, 10).cast("int") + 1, F.lit(1)))

    # the codons are taken out once; a lambda that looked into the sequence would rebuild it for each of them
    acids = F.transform(F.regexp_extract_all(digits, F.lit("(?s)..."), 0), amino)
    return F.substring_index(F.array_join(acids, ""), "\n", 1)


def bit_score(raw: Column) -> Column:
    """Bits of a raw alignment score."""
    return (F.lit(LAMBDA) * raw - math.log(KAPPA)) / math.log(2.0)


def e_value(bits: Column, m: Column, n: Column) -> Column:
    """Expected number of hits as good in a search space of ``m * n``."""
    return m * n * F.pow(F.lit(2.0), -bits)


def digits(seq: Column, order: str = INDEX_ORDER, turned: bool = False) -> Column:
    """Base-4 digits of a sequence in A, C, G, T, N, or of its reverse complement; N counts as A on either strand."""
    if not turned:
        return F.translate(seq, order + "N", "0123" + str(order.index("A")))
    pairs = dict(zip(order, order.translate(str.maketrans("ACGT", "TGCA"))))
    return F.reverse(F.translate(seq, order + "N", "".join(str(order.index(pairs[b])) for b in order) + str(order.index("A"))))


def pack(kmer: Column, order: str = INDEX_ORDER) -> Column:
    """Number of a k-mer (k up to 31), its bases being digits in ``order``; N counts as A."""
    return F.conv(digits(kmer, order), 4, 10).cast("bigint")


def seconds_text(seconds: Column) -> Column:
    """"x.xx s", or "x.xx m" beyond 180 seconds."""
    return F.when(seconds > 180, F.format_string("%.2f m", seconds / 60.0)).otherwise(F.format_string("%.2f s", seconds))


def is_power_of_two(x: Column) -> Column:
    """Whether an integer has at most one bit set."""
    return x.bitwiseAND(x - 1) == 0
