"""Joins of reads by exact or near-exact overlap, and lookups in the k-mer index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import hamming, hamming_prefix, revcomp
from ..session import spread, stored
from .ends import beginnings, end_sieves, first_keys, tails, word_keys
from .hot_keys import hot_keys
from .kmers import both_strands, end_kmers, indexable, slide
from .sieve import sieves


#: Share of the queries in which hot k-mers are looked for, and the parts into which one is cut.
PROBE, SALTS = 0.02, 16
#: Words of 64 letters that keys carry, to be compared where they meet.
WORDS = 4
#: Letters beyond the query by which its exact matches meet each other.
HEAD = 8


def point_lookup(reads: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """``(kmer, n)``: postings of each asked k-mer in the prefix index of both strands, 0 if absent.

    The asked words are a semi-join filter on the scan, so that only their postings are counted.
    """
    counts = end_kmers(reads, k).join(words, "kmer", "left_semi").groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return words.join(counts, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def postings(reads: DataFrame, k: int) -> DataFrame:
    """``(kmer, n, first_read, last_read)`` of the prefix index; states only, no posting lists are gathered."""
    return end_kmers(reads, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min("read_id").alias("first_read"), F.max("read_id").alias("last_read"))


def index_skew(reads: DataFrame, k: int) -> DataFrame:
    """One row of index metrics: postings, distinct k-mers, the longest list, and postings that share a k-mer."""
    lists = end_kmers(reads, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return lists.agg(
        F.sum("n").alias("postings"), F.count(F.lit(1)).alias("kmers"), F.max("n").alias("longest"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared"),
    )


def _differ(words: int) -> list[Column]:
    """Bits in which both sides differ, one for each letter that both have, in words of 64 (see ``ends.word_keys``)."""
    low, high, mask = ([(F.col(f"q{i}"), F.col(f"r{i}")) for i in range(p, 3 * words, 3)] for p in range(3))
    return [a.bitwiseXOR(b).bitwiseOR(c.bitwiseXOR(d)).bitwiseAND(e).bitwiseAND(f) for (a, b), (c, d), (e, f) in zip(low, high, mask)]


def _ones(n: int) -> int:
    """The lowest ``n`` bits of a word, as a signed number."""
    return (1 << n) - 1 if n < 64 else -1


def _matches(queries: DataFrame, reads: DataFrame, k: int, less: int, n: Column, words: int, accept: Column, max_mismatch: float = 0.0, fits: Column | None = None, most: int | None = None) -> DataFrame:
    """Hashes of the reads' first k-mers meet those of the queries' k-mers, hot ones spread; sieves of either keep those of the other that
    meet nothing, or only their own read, in their task.

    Both carry their next ``64 * words`` letters as bits, and pairs are compared by these inside the join: what differs too much leaves no row.
    ``n`` letters count, of ``rest`` in the query and ``size`` in the read, bits of the first ``most`` only. Where they exceed the bits, or a letter isn't one of
    four, both sequences are fetched, once for each pair that is left, and ``accept`` decides on ``rest`` and ``oriented``.
    """
    asked = queries.select(F.col("read_id").alias("query_id"), "seq")
    both = both_strands(indexable(reads).where(F.length("seq") >= k)).select("read_id", "strand", F.length("oriented").alias("size"), "oriented")
    begun = first_keys(both.select("oriented"), k).groupBy("x").agg((F.count(F.lit(1)) > 1).alias("again"))
    sieve, again = sieves(begun.select(F.explode(F.when(F.col("again"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("kind"), "x"), 2)
    several = again if queries is reads else None
    keys = word_keys(asked, k, less, sieve, words, most, several)
    (asked_for,) = sieves(word_keys(asked, k, less, sieve, 0, None, several).select("x").distinct().select(F.lit(0).alias("kind"), "x"))
    first = first_keys(both, k, words, most, asked_for)
    hot = [r["x"] for r in hot_keys(word_keys(asked.sample(PROBE, 1), k, less, sieve, 0, None, several), "x").select("x").collect()]  # fewer than HOT_KEYS
    is_hot = F.col("x").isin(hot) if hot else F.lit(False)
    keys = keys.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("query_id", "offset"), F.lit(SALTS)).cast("int")).otherwise(0))
    first = first.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    bits, other = _differ(words), F.col("query_id") != F.col("read_id")
    if max_mismatch == 0:
        near = (bits[0] == 0) & (reduce(Column.bitwiseOR, bits) == 0)
    else:  # the first word alone leaves few; the condition stays small, or the JVM doesn't compile it
        word = reduce(Column.__and__, [b.bitwiseAND(F.lit(_ones(k - 64 * j))) == 0 for j, b in enumerate(bits) if k > 64 * j])
        near = (F.bit_count(bits[0]) / n <= max_mismatch) & (reduce(Column.__add__, map(F.bit_count, bits)) / n <= max_mismatch) & word
    sure, near = F.greatest(n, F.lit(k)) <= F.least("q_fit", "r_fit"), near if fits is None else fits & near
    met = keys.join(first, ["x", "salt"])
    found = met.where(other & near & sure).select("query_id", "read_id", "strand", "offset", "oriented", "rest")
    if max_mismatch == 0:  # sequences that are equal are both long, or have both other letters, where their bits don't do
        wide = 64 * words
        far = F.col("q_fit") < wide, F.col("r_fit") < wide
        if most is None or max(most, k) > wide:
            far = far[0] | (F.col("rest") > wide), far[1] | (F.col("size") > wide)
        met = keys.where(far[0]).join(first.where(far[1]), ["x", "salt"])
    return found.unionByName(_fetched(met.where(~sure & other & near).select("query_id", "read_id", "strand", "offset"), asked, reads, k, accept))


def _fetched(met: DataFrame, asked: DataFrame, reads: DataFrame, k: int, accept: Column) -> DataFrame:
    """Those of ``met`` whose whole sequences agree."""
    pairs = met.groupBy("query_id", "read_id", "strand").agg(F.collect_list("offset").alias("offsets"))
    texts = reads.select("read_id", F.col("seq").alias("plain"))
    both = pairs.join(asked.withColumnRenamed("seq", "query"), "query_id").join(texts, "read_id").withColumn("oriented", F.when(F.col("strand") == "-", revcomp(F.col("plain"))).otherwise(F.col("plain")))
    placed = both.select("query_id", "read_id", "strand", "oriented", "query", F.explode("offsets").alias("offset")).withColumn("rest", F.substr("query", F.col("offset") + 1, F.length("query")))
    same = F.substring("rest", 1, k) == F.substring("oriented", 1, k)
    return placed.where(same & accept).select("query_id", "read_id", "strand", "offset", "oriented", F.length("rest").alias("rest"))


def overlaps(queries: DataFrame, reads: DataFrame, k: int, min_overlap: int, max_mismatch: float = 0.0) -> DataFrame:
    """``(query_id, read_id, strand, offset, oriented, rest)``: reads of either strand whose prefix k-mer stands in the query at
    ``offset`` and whose share of mismatches over what both cover is at most ``max_mismatch`` (J1, J3, F6). ``rest`` letters of the query follow.

    An equi-join by the hash of a k-mer with the comparison as residual condition; a read never matches itself. Nothing is consumed.
    The size of the result is that of the matches; a k-mer that dominates the queries is spread.
    """
    n = F.least(F.length("rest"), F.length("oriented"))
    exact = F.substring("rest", 1, n) == F.substring("oriented", 1, n)
    accept = exact if max_mismatch == 0 else hamming(F.col("rest"), F.col("oriented")) <= max_mismatch
    return _matches(queries, reads, k, max(k, min_overlap), F.least("rest", "size"), WORDS, accept, max_mismatch)


def prefix_overlaps(queries: DataFrame, reads: DataFrame, k: int, min_overlap: int, max_mismatch: float = 0.0) -> DataFrame:
    """As ``overlaps``, comparing only the first ``min_overlap`` letters, at offsets before ``len - min_overlap``."""
    exact = F.substring("rest", 1, min_overlap) == F.substring("oriented", 1, min_overlap)
    accept = exact if max_mismatch == 0 else hamming_prefix(F.col("rest"), F.col("oriented"), min_overlap) <= max_mismatch
    n, words = F.least(F.lit(min_overlap), F.col("size")), min(WORDS, -(-max(k, min_overlap) // 64))
    return _matches(queries, reads, k, max(k, min_overlap + 1), n, words, accept, max_mismatch, F.col("size") >= min_overlap if max_mismatch == 0 else None, max(k, min_overlap))


def within(reads: DataFrame, k: int) -> DataFrame:
    """Matches, as of ``overlaps``, of distinct reads that lie within a longer one, on either strand."""
    whole = F.substring("rest", 1, F.length("oriented")) == F.col("oriented")
    longer = (F.col("rest") >= F.col("size")) & (F.col("offset") + F.col("rest") > F.col("size"))
    return _matches(reads, reads, k, k, F.col("size"), WORDS, whole & (F.length("query") > F.length("oriented")), fits=longer)


def matching_suffix(matches: DataFrame, span: Column) -> DataFrame:
    """Adds ``suffix``: what a match has beyond the ``span`` letters that it shares with the query."""
    return matches.withColumn("suffix", F.substr("oriented", span + 1, F.length("oriented")))


def with_match(queries: DataFrame, reads: DataFrame, k: int, matching: bool = True) -> DataFrame:
    """Queries that hold the prefix k-mer of some other or same read on either strand, or those that don't."""
    prefixes = end_kmers(reads, k).select("kmer").distinct()
    hit = slide(queries.select("read_id", "seq"), k).select("read_id", "kmer").join(prefixes, "kmer", "left_semi").select("read_id")
    return queries.join(hit, "read_id", "left_semi" if matching else "left_anti")


def best_successor(reads: DataFrame, min_overlap: int) -> DataFrame:
    """``(read_id, next_id, overlap)``: of each read without N the longest exact overlap of its end with the beginning
    of another, ties to the lower id (T4).

    Ends meet beginnings by key (see ``ends``); of the reads that begin alike only the two lowest can be chosen, so that each task
    hands on two rows of a key. Equal reads and reads within the query extend nothing.
    """
    plain = spread(reads.select("read_id", "seq")).where(F.col("read_id").isNotNull() & (F.length("seq") >= min_overlap))
    rows = indexable(plain).select(F.col("read_id").cast("bigint").alias("node"), F.lit(1).cast("bigint").alias("occr"), "seq")
    lowest = Window.partitionBy("h", "g", "n").orderBy("next_id")
    firsts, lasts = end_sieves(rows, min_overlap)
    index = beginnings(rows, min_overlap, lasts).select("h", "g", "n", F.col("node").alias("next_id")).withColumn("nth", F.row_number().over(lowest)).where("nth <= 2")
    met = tails(rows, min_overlap, firsts).join(index, ["h", "g", "n"]).where("node <> next_id")
    best = met.groupBy("node").agg(F.max(F.struct(F.col("n").alias("overlap"), (-F.col("next_id")).alias("neg"))).alias("b"))
    return best.select(F.col("node").alias("read_id"), (-F.col("b.neg")).alias("next_id"), "b.overlap")


def match_order(matches: DataFrame) -> DataFrame:
    """Adds ``place``: matches of a query by rising offset, within one offset later reads first, their reverse strand before the other."""
    order = Window.partitionBy("query_id").orderBy("offset", F.desc("read_id"), F.desc("strand"))
    return matches.withColumn("place", F.row_number().over(order))


def ancestors(matches: DataFrame, min_overlap: int, exact: bool = False) -> DataFrame:
    """``(query_id, read_id, strand, offset, before_id, before_strand, before_offset)``: for each match of a query the other ones that begin at or before it,
    reach ``min_overlap`` letters into it, and agree with it there: a range join within the query (J7).

    ``exact`` matches, with ``rest`` (see ``overlaps``), agree within the query. Of these only what reaches beyond it is kept, and those that
    reach ``HEAD`` letters beyond meet by these first.
    """
    ahead = F.col("offset") - F.col("before_offset")
    near = (ahead >= 0) & (F.col("before_size") - ahead >= min_overlap) & ((F.col("read_id") != F.col("before_id")) | (F.col("strand") != F.col("before_strand")) | (ahead > 0))
    names = ["read_id", "strand", "offset", "before_id", "before_strand", "before_offset"]
    text = F.substr("oriented", F.col("rest") + 1, F.length("oriented")) if exact else F.col("oriented")
    v = stored(matches.select("query_id", "read_id", "strand", "offset", F.length("oriented").alias("size"), text.alias("text")))  # they are looked for once
    renamed = {"read_id": "before_id", "strand": "before_strand", "offset": "before_offset", "size": "before_size", "text": "before_text"}
    u = v.withColumnsRenamed(renamed)
    if not exact:
        n = F.least(F.col("before_size") - ahead, F.col("size"))
        agree = F.substr("before_text", ahead + 1, n) == F.substr("text", F.lit(1), n)
        return v.join(u, "query_id").where(near & agree).select("query_id", *names)
    agree = F.startswith("text", F.col("before_text")) | F.startswith("before_text", F.col("text"))
    long, head = F.length("text") >= HEAD, F.substring("text", 1, HEAD)
    far = v.where(long).withColumn("head", head)
    met = [
        far.join(far.withColumnsRenamed(renamed), ["query_id", "head"]),
        v.where(~long).join(u, "query_id"),
        v.where(long).join(v.where(~long).withColumnsRenamed(renamed), "query_id"),
    ]
    return reduce(DataFrame.unionByName, [m.where(near & agree).select("query_id", *names) for m in met])


def contained_in(reads: DataFrame, k: int) -> DataFrame:
    """``(read_id, n)``: reads without N that occur within another, longer read, and within how many (J7 as an equi-join)."""
    plain = indexable(reads).where(F.length("seq") >= k).select("read_id", "seq")
    host = slide(plain.withColumn("size", F.length("seq")), k).select(F.col("read_id").alias("host"), "kmer", "pos", "size")
    inner = plain.select("read_id", F.substring("seq", 1, k).alias("kmer"), F.length("seq").alias("n"))
    met = inner.join(host, "kmer").where((F.col("host") != F.col("read_id")) & (F.col("size") > F.col("n")) & (F.col("pos") + F.col("n") <= F.col("size")))
    outer = met.join(plain.select(F.col("read_id").alias("host"), F.col("seq").alias("outer_seq")), "host").select("read_id", "host", F.substr("outer_seq", F.col("pos") + 1, F.col("n")).alias("part"))
    hits = outer.join(plain, "read_id").where(F.col("part") == F.col("seq"))
    return hits.select("read_id", "host").distinct().groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))


def duplicates(reads: DataFrame) -> DataFrame:
    """``(seq, occr, first_id)``: identical reads collapsed (C6). Copies are added up in each task before the shuffle."""
    return reads.groupBy("seq").agg(F.count(F.lit(1)).alias("occr"), F.min("read_id").alias("first_id"))


__all__ = ["ancestors", "best_successor", "contained_in", "duplicates", "index_skew", "match_order", "matching_suffix", "overlaps", "point_lookup", "postings", "prefix_overlaps", "revcomp", "with_match", "within"]
