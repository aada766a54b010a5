"""Queries over the read table: scalars, row generators, counts, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import kmers, overlap, state
from ..session import spread, table
from ..streaming import progress as file_progress

K = 25
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The normalised reads in SQL, as ``r``.
READS = """WITH r AS (
  SELECT read_id, name, file_ord, flag, regexp_replace(translate(seq, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq FROM reads WHERE seq IS NOT NULL
)"""
#: Both strands of the indexable reads, as ``s``.
STRANDS = READS + """, s AS (
  SELECT read_id, '+' AS strand, seq AS o FROM r WHERE NOT contains(seq, 'N')
  UNION ALL SELECT read_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM r WHERE NOT contains(seq, 'N')
)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.normalised(spread(table(spark, sf_dir, "reads").select("read_id", "name", "seq")))


@query(READS + " SELECT read_id, seq FROM r")
def upcase_n(spark, sf_dir):
    return reads(spark, sf_dir).select("read_id", "seq")


@query(READS + " SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM r")
def revcomp(spark, sf_dir):
    return reads(spark, sf_dir).select("read_id", S.revcomp(F.col("seq")).alias("rc"))


@query(READS + """ SELECT read_id, substr(reverse(translate(seq, 'ACGT', 'TGCA')), 11) AS tail,
  reverse(translate(substr(seq, 1, 20), 'ACGT', 'TGCA')) AS head FROM r""")
def partial_revcomp(spark, sf_dir):
    seq = F.col("seq")
    return reads(spark, sf_dir).select("read_id", S.partial_revcomp(seq, 10).alias("tail"), S.revcomp_prefix(seq, 20).alias("head"))


@query(READS + " SELECT read_id, CASE WHEN length(seq) > 0 THEN round(100.0 * length(regexp_replace(seq, '[^GCgc]', '', 'g')) / length(seq), 4) END AS gc FROM r")
def gc_content(spark, sf_dir):
    return reads(spark, sf_dir).select("read_id", F.round(S.gc_content(F.col("seq")), 4).alias("gc"))


@query("SELECT read_id, regexp_matches(upper(seq), '[BD-FH-MO-SU-Z]') AS protein FROM reads")
def is_protein(spark, sf_dir):
    return table(spark, sf_dir, "reads").select("read_id", S.is_protein(F.upper("seq")).alias("protein"))


@query(READS + """, p AS (
  SELECT a.read_id, b.read_id AS other, a.seq AS x, b.seq AS y, least(length(a.seq), length(b.seq)) AS n
  FROM r a JOIN r b ON b.read_id = a.read_id + 1
), d AS (
  SELECT read_id, other, n, list_filter(range(1, n + 1), lambda i: x[i] <> y[i]) AS miss FROM p
)
SELECT read_id, other, CASE WHEN n > 0 THEN round(CAST(len(miss) AS DOUBLE) / n, 6) END AS diff,
  CASE WHEN n > 0 THEN round(CAST(len(list_filter(miss, lambda i: i <= 20)) AS DOUBLE) / least(n, 20), 6) END AS diff20,
  CASE WHEN n > 0 THEN CAST(coalesce(miss[1], 0) - 1 AS INT) ELSE -1 END AS first FROM d""")
def hamming_pair(spark, sf_dir):
    a = reads(spark, sf_dir).select("read_id", F.col("seq").alias("x"))
    b = a.select((F.col("read_id") - 1).alias("read_id"), F.col("read_id").alias("other"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "read_id").select(
        "read_id", "other", F.round(S.hamming(x, y), 6).alias("diff"), F.round(S.hamming_prefix(x, y, 20), 6).alias("diff20"), S.first_mismatch(x, y).alias("first")
    )


def _frame_sql(frame: int) -> str:
    strand = "seq" if frame <= 3 else "reverse(translate(seq, 'ACGT', 'TGCA'))"
    start = (frame - 1) % 3
    codon = f"substr(d, CAST(i * 3 + {start + 1} AS INT), 3)"
    code = " + ".join(f"{m} * CAST({codon}[{j}] AS INT)" for m, j in ((16, 1), (4, 2), (1, 3)))
    return f"""SELECT read_id, {frame} AS frame, split_part(array_to_string(list_transform(range(0, greatest(0, (length(d) - {start}) // 3)),
  lambda i: CASE WHEN contains({codon}, 'N') THEN '!' ELSE '{S.GENETIC_CODE}'[{code} + 1] END), ''), '!', 1) AS aa
FROM (SELECT read_id, translate({strand}, '{S.CODON_ORDER}', '0123') AS d FROM r)"""


def _translated(frame: int):
    def f(spark, sf_dir):
        return reads(spark, sf_dir).select("read_id", F.lit(frame).alias("frame"), S.translate_dna(F.col("seq"), frame).alias("aa"))

    f.__name__ = f"translate_f{frame}"
    return f


for _f in range(1, 7):
    query(f"{READS} {_frame_sql(_f)}")(_translated(_f))


@query(READS + f", t AS ({' UNION ALL '.join(_frame_sql(f) for f in range(1, 7))}) SELECT read_id, frame, aa FROM t")
def six_frame(spark, sf_dir):
    return kmers.six_frames(reads(spark, sf_dir)).select("read_id", "frame", "aa")


@query("""SELECT bucket_id, len(list_distinct(list_transform(origins, lambda o: CASE WHEN o.seqid >= 0 THEN o.seqid ELSE -o.seqid - 1 END))) AS n_reads,
  len(list_filter(origins, lambda o: o.seqid < 0)) AS n_reverse FROM hashbuckets WHERE len(origins) > 0""")
def origin_reads(spark, sf_dir):
    rows = table(spark, sf_dir, "hashbuckets").where(F.size("origins") > 0)
    return rows.select(
        "bucket_id", F.size(F.array_distinct(F.transform("origins", lambda o: S.read_of(o["seqid"])))).cast("bigint").alias("n_reads"),
        F.size(F.filter("origins", lambda o: o["seqid"] < 0)).cast("bigint").alias("n_reverse"),
    )


@query("""SELECT contig_ord, round((0.267 * len - ln(0.041)) / ln(2), 6) AS bits FROM contigs""")
def bit_score(spark, sf_dir):
    return table(spark, sf_dir, "contigs").select("contig_ord", F.round(S.bit_score(F.col("len")), 6).alias("bits"))


def _packed_sql(order: str) -> str:
    digit = f"CAST(translate(w[i], '{order}', '0123') AS BIGINT)"
    return f"CAST(list_sum(list_transform(range(1, 13), lambda i: {digit} * CAST(power(4, 12 - i) AS BIGINT))) AS BIGINT)"


@query(STRANDS + f", p AS (SELECT read_id, strand, substr(o, 1, 12) AS w FROM s WHERE length(o) >= 12) SELECT read_id, strand, {_packed_sql(S.INDEX_ORDER)} AS code, {_packed_sql(S.PROFILE_ORDER)} AS profile_code FROM p")
def kmer_pack(spark, sf_dir):
    ends = kmers.end_kmers(reads(spark, sf_dir), 12)
    return ends.select("read_id", "strand", S.pack(F.col("kmer")).alias("code"), S.pack(F.col("kmer"), S.PROFILE_ORDER).alias("profile_code"))


@query(STRANDS + """, k AS (SELECT read_id, strand, i, substr(o, CAST(i + 1 AS INT), 25) AS kmer FROM s, unnest(range(0, greatest(length(o) - 24, 0))) AS t(i))
SELECT read_id, strand, count(*) AS n, count(DISTINCT kmer) AS n_distinct, min(kmer) AS least, max(kmer) AS greatest FROM k GROUP BY read_id, strand""")
def kmers_complete(spark, sf_dir):
    found = kmers.kmers(reads(spark, sf_dir), K)
    return found.groupBy("read_id", "strand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kmer").alias("n_distinct"), F.min("kmer").alias("least"), F.max("kmer").alias("greatest"))


@query(STRANDS + " SELECT read_id, strand, substr(o, 1, 25) AS kmer FROM s WHERE length(o) >= 25")
def kmers_ends(spark, sf_dir):
    return kmers.end_kmers(reads(spark, sf_dir), K).select("read_id", "strand", "kmer")


@query(READS + " SELECT read_id, CAST(greatest(length(seq) - 30 + 1, 0) AS BIGINT) AS n_overlap, CAST(greatest(length(seq) - 30, 0) AS BIGINT) AS n_prefix FROM r WHERE length(seq) >= 31")
def query_offsets(spark, sf_dir):
    rows = reads(spark, sf_dir)
    a = kmers.query_kmers(rows, K, 30).groupBy("read_id").agg(F.count(F.lit(1)).alias("n_overlap"))
    b = kmers.query_kmers(rows, K, 30, inclusive=False).groupBy("read_id").agg(F.count(F.lit(1)).alias("n_prefix"))
    return a.join(b, "read_id")


@query(READS + """, n AS (
  SELECT *, CAST(ceil((length(seq) - 25) / 50.0) AS INT) AS parts FROM r WHERE length(seq) >= 75
), p AS (
  SELECT *, CAST(ceil((length(seq) - 75) / greatest(parts - 1, 1.0)) AS INT) AS step FROM n
), w AS (
  SELECT *, CAST(least(j * step, length(seq) - 75) AS INT) AS beg FROM p, unnest(range(0, parts)) AS t(j)
)
SELECT read_id, CAST(j AS INT) AS part, beg, CASE WHEN parts > 1 THEN name || '_' || j || '/' || parts ELSE name END AS name, substr(seq, beg + 1, 75) AS seq FROM w""")
def split_varlen(spark, sf_dir):
    return kmers.split_reads(reads(spark, sf_dir), 75, 25)


_COUNTS = STRANDS + """, k AS (SELECT substr(o, CAST(i + 1 AS INT), 25) AS kmer FROM s, unnest(range(0, greatest(length(o) - 24, 0))) AS t(i)),
c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer)"""


@query(_COUNTS + " SELECT kmer, n FROM c ORDER BY n DESC, kmer LIMIT 20")
def kmer_topk(spark, sf_dir):
    return kmers.kmer_counts(reads(spark, sf_dir), K).orderBy(F.desc("n"), "kmer").limit(20)


@query(_COUNTS + " SELECT n AS multiplicity, count(*) AS kmers FROM c GROUP BY n")
def kmer_spectrum(spark, sf_dir):
    return kmers.kmer_counts(reads(spark, sf_dir), K).groupBy(F.col("n").alias("multiplicity")).agg(F.count(F.lit(1)).alias("kmers"))


@query("SELECT file_ord, count(*) AS n_reads, CAST(coalesce(sum(length(seq)), 0) AS BIGINT) AS n_letters, count(*) FILTER (flag = 2) AS n_used FROM reads GROUP BY file_ord")
def progress(spark, sf_dir):
    return file_progress(table(spark, sf_dir, "reads"))


@query(READS + " SELECT count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS letters FROM r")
def read_count(spark, sf_dir):
    return reads(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("letters"))


@query(READS + " SELECT CAST(min(length(seq)) AS INT) AS min_len, CAST(max(length(seq)) AS INT) AS max_len FROM r")
def minmax_readlen(spark, sf_dir):
    return reads(spark, sf_dir).agg(F.min(F.length("seq")).alias("min_len"), F.max(F.length("seq")).alias("max_len"))


@query(READS + " SELECT count(*) FILTER (length(seq) >= 75) AS kept, count(*) FILTER (length(seq) < 75) AS dropped, CAST(sum(length(seq)) FILTER (length(seq) >= 75) AS BIGINT) AS kept_letters FROM r")
def length_filter(spark, sf_dir):
    n = F.length("seq")
    return reads(spark, sf_dir).agg(F.count_if(n >= 75).alias("kept"), F.count_if(n < 75).alias("dropped"), F.sum(F.when(n >= 75, n)).alias("kept_letters"))


@query(READS + ", m AS (SELECT min(length(seq)) AS n FROM r WHERE length(seq) >= 25) SELECT read_id, substr(seq, 1, CAST(n AS INT)) AS seq FROM r, m WHERE length(seq) >= 25")
def fixed_length(spark, sf_dir):
    return kmers.fixed_length(reads(spark, sf_dir).where(F.length("seq") >= K)).select("read_id", "seq")


@query(READS + " SELECT read_id, seq FROM r WHERE NOT contains(seq, 'N')")
def drop_n_reads(spark, sf_dir):
    return kmers.indexable(reads(spark, sf_dir)).select("read_id", "seq")


@query(STRANDS + """, e AS (SELECT substr(o, 1, 25) AS kmer, count(*) AS n FROM s WHERE length(o) >= 25 GROUP BY 1)
SELECT w.kmer, coalesce(e.n, 0) AS n FROM (SELECT DISTINCT kmer FROM hashbuckets WHERE kmer IS NOT NULL) w LEFT JOIN e USING (kmer)""")
def kmer_lookup(spark, sf_dir):
    words = table(spark, sf_dir, "hashbuckets").where("kmer is not null").select("kmer").distinct()
    return overlap.point_lookup(reads(spark, sf_dir), words, K)


@query(STRANDS + " SELECT substr(o, 1, 25) AS kmer, count(*) AS n, min(read_id) AS first_read, max(read_id) AS last_read FROM s WHERE length(o) >= 25 GROUP BY 1")
def kmer_postings(spark, sf_dir):
    return overlap.postings(reads(spark, sf_dir), K)


@query(STRANDS + """, e AS (SELECT substr(o, 1, 25) AS kmer, count(*) AS n FROM s WHERE length(o) >= 25 GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS postings, count(*) AS kmers, max(n) AS longest, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS shared FROM e""")
def index_skew(spark, sf_dir):
    return overlap.index_skew(reads(spark, sf_dir), K)


_JOIN = STRANDS + """, e AS (SELECT read_id, strand, substr(o, 1, 25) AS kmer, o FROM s WHERE length(o) >= 25),
q AS (SELECT read_id AS query_id, CAST(i AS INT) AS offset_, substr(seq, CAST(i + 1 AS INT), 25) AS kmer, substr(seq, CAST(i + 1 AS INT)) AS rest, length(seq) AS size
  FROM r, unnest(range(0, greatest(length(seq) - 24, 0))) AS t(i)),
c AS (SELECT *, least(length(rest), length(o)) AS n FROM q JOIN e USING (kmer) WHERE query_id <> read_id)
"""
_EXACT = "substr(rest, 1, CAST(n AS INT)) = substr(o, 1, CAST(n AS INT))"


@query(_JOIN + f' SELECT query_id, read_id, strand, offset_ AS "offset" FROM c WHERE {_EXACT}')
def overlap_exact(spark, sf_dir):
    rows = reads(spark, sf_dir)
    return overlap.overlaps(rows, rows, K, K).select("query_id", "read_id", "strand", "offset")


@query(_JOIN + ' SELECT query_id, read_id, strand, offset_ AS "offset" FROM c WHERE len(list_filter(range(1, n + 1), lambda i: rest[i] <> o[i])) <= 0.05 * n')
def overlap_mismatch(spark, sf_dir):
    rows = reads(spark, sf_dir)
    return overlap.overlaps(rows, rows, K, K, 0.05).select("query_id", "read_id", "strand", "offset")


@query(_JOIN + ' SELECT query_id, read_id, strand, offset_ AS "offset", substr(o, CAST(size - offset_ + 1 AS INT)) AS suffix FROM c WHERE offset_ < size - 30 AND substr(rest, 1, 30) = substr(o, 1, 30)')
def prefix_overlap(spark, sf_dir):
    rows = reads(spark, sf_dir)
    return overlap.matching_suffix(overlap.prefix_overlaps(rows, rows, K, 30), F.col("rest")).select("query_id", "read_id", "strand", "offset", "suffix")


@query(READS + " SELECT read_id FROM r WHERE read_id NOT IN (SELECT CASE WHEN first_id >= 0 THEN first_id ELSE -first_id - 1 END FROM hashbuckets WHERE first_id IS NOT NULL)")
def unused_reads_anti(spark, sf_dir):
    used = table(spark, sf_dir, "hashbuckets").select(S.read_of(F.col("first_id")).alias("read_id"))
    return state.unused(reads(spark, sf_dir), used).select("read_id")


_HELD = STRANDS + """, e AS (SELECT DISTINCT substr(o, 1, 25) AS kmer FROM s WHERE length(o) >= 25),
q AS (SELECT DISTINCT read_id FROM (SELECT read_id, substr(seq, CAST(i + 1 AS INT), 25) AS kmer FROM r, unnest(range(0, greatest(length(seq) - 24, 0))) AS t(i)) JOIN e USING (kmer))"""


@query(_HELD + " SELECT read_id FROM r WHERE read_id IN (SELECT read_id FROM q)")
def reads_with_match_semi(spark, sf_dir):
    rows = reads(spark, sf_dir)
    return overlap.with_match(rows, rows, K).select("read_id")


@query(_HELD + " SELECT read_id FROM r WHERE read_id NOT IN (SELECT read_id FROM q)")
def reads_without_match_anti(spark, sf_dir):
    rows = reads(spark, sf_dir)
    return overlap.with_match(rows, rows, K, matching=False).select("read_id")


@query(READS + """, p AS (SELECT read_id, seq FROM r WHERE length(seq) >= 25 AND NOT contains(seq, 'N')),
l AS (SELECT read_id, substr(seq, CAST(i + 1 AS INT), 25) AS kmer, substr(seq, CAST(i + 1 AS INT)) AS tail FROM p, unnest(range(1, length(seq) - 24)) AS t(i)),
c AS (SELECT l.read_id, p.read_id AS next_id, CAST(length(tail) AS INT) AS overlap FROM l JOIN p ON substr(p.seq, 1, 25) = l.kmer
  WHERE l.read_id <> p.read_id AND length(p.seq) > length(tail) AND starts_with(p.seq, tail)),
n AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY overlap DESC, next_id) AS n FROM c)
SELECT read_id, next_id, overlap FROM n WHERE n = 1""")
def best_successor(spark, sf_dir):
    return overlap.best_successor(reads(spark, sf_dir), K)


@query(READS + """, p AS (SELECT read_id, seq FROM r WHERE length(seq) >= 25 AND NOT contains(seq, 'N')),
h AS (SELECT read_id AS host, substr(seq, CAST(i + 1 AS INT), 25) AS kmer, substr(seq, CAST(i + 1 AS INT)) AS rest, length(seq) AS size FROM p, unnest(range(0, length(seq) - 24)) AS t(i))
SELECT p.read_id, count(DISTINCT host) AS n FROM p JOIN h ON substr(p.seq, 1, 25) = h.kmer WHERE host <> p.read_id AND size > length(p.seq) AND starts_with(rest, p.seq) GROUP BY p.read_id""")
def contained_reads(spark, sf_dir):
    return overlap.contained_in(reads(spark, sf_dir), K)


@query(READS + " SELECT seq, count(*) AS occr, min(read_id) AS first_id FROM r GROUP BY seq")
def dup_collapse(spark, sf_dir):
    return overlap.duplicates(reads(spark, sf_dir))


@query("SELECT file_ord, min(read_id) AS read_id FROM reads WHERE flag = 0 GROUP BY file_ord")
def seed_pick(spark, sf_dir):
    return state.next_seeds(table(spark, sf_dir, "reads"))


@query("SELECT file_ord, count(*) AS n FROM reads WHERE flag = 0 AND file_ord IS NOT NULL GROUP BY file_ord ORDER BY n DESC, file_ord LIMIT 1")
def maxloc_source(spark, sf_dir):
    return state.fullest(table(spark, sf_dir, "reads"))


@query("SELECT count(*) AS total, count(*) FILTER (flag = 2) AS used, CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (flag = 2) AS DOUBLE) / count(*) END AS share FROM reads")
def depletion(spark, sf_dir):
    return state.depleted(table(spark, sf_dir, "reads"))


@query("""SELECT read_id, name, CAST(row_number() OVER (PARTITION BY name ORDER BY loaded_at, read_id) AS INT) AS load FROM reads WHERE name IS NOT NULL""")
def load_order(spark, sf_dir):
    """Reads loaded again, in the order of loading."""
    order = Window.partitionBy("name").orderBy("loaded_at", "read_id")
    return table(spark, sf_dir, "reads").where("name is not null").select("read_id", "name", F.row_number().over(order).alias("load"))


@query(_JOIN + f""", e2 AS (SELECT query_id, read_id, strand, offset_ FROM c WHERE {_EXACT})
SELECT query_id, read_id, strand, offset_ AS "offset", CAST(row_number() OVER (PARTITION BY query_id ORDER BY offset_, read_id DESC, strand DESC) AS INT) AS place FROM e2""")
def match_order(spark, sf_dir):
    rows = reads(spark, sf_dir)
    return overlap.match_order(overlap.overlaps(rows, rows, K, K)).select("query_id", "read_id", "strand", "offset", "place")


@query(_JOIN + f""", m AS (SELECT query_id, read_id, strand, offset_, o FROM c WHERE {_EXACT} AND length(o) >= 75),
p AS (SELECT v.query_id, v.read_id, v.strand, v.offset_ AS "offset", u.read_id AS before_id, u.strand AS before_strand, u.offset_ AS before_offset, v.offset_ - u.offset_ AS d, u.o AS uo, v.o AS vo
  FROM m v JOIN m u ON u.query_id = v.query_id AND u.offset_ <= v.offset_ AND length(u.o) - (v.offset_ - u.offset_) >= 25 AND (u.read_id <> v.read_id OR u.strand <> v.strand OR u.offset_ < v.offset_))
SELECT query_id, read_id, strand, "offset", before_id, before_strand, before_offset FROM p
WHERE substr(uo, CAST(d + 1 AS INT), CAST(least(length(uo) - d, length(vo)) AS INT)) = substr(vo, 1, CAST(least(length(uo) - d, length(vo)) AS INT))""")
def match_ancestors(spark, sf_dir):
    """Ancestors among the matches of reads of 75 letters and more."""
    rows = reads(spark, sf_dir)
    found = overlap.overlaps(rows, rows.where(F.length("seq") >= 75), K, K)
    return overlap.ancestors(found, K, exact=True)
