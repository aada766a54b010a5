"""Queries over contigs and index edges: filters, text forms, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sequence import gc_content
from ..operators import contigs as C
from ..session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_TEXT = "coalesce(printf('%.1f', {}), '')"
_HEADER = "'>' || coalesce(contig_id, '') || '{}' || coalesce(CAST(len AS VARCHAR), '') || '_cov_' || " + " || ".join(
    (_TEXT.format("cov"), "'_stdev_'", _TEXT.format("stdev"), "'_GC_'", _TEXT.format("gc"), "'_seed_'", "coalesce(seed, '')")
)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def contigs(spark, sf_dir):
    return table(spark, sf_dir, "contigs")


@query("SELECT contig_ord, contig_id FROM contigs WHERE len >= 300 AND cov >= 2.0")
def contig_filter(spark, sf_dir):
    return C.filtered(contigs(spark, sf_dir), 300, 2.0).select("contig_ord", "contig_id")


@query("SELECT contig_ord, length(seq) AS n FROM contigs WHERE length(seq) > 125")
def contig_emitted(spark, sf_dir):
    return C.emitted(contigs(spark, sf_dir)).select("contig_ord", F.length("seq").cast("bigint").alias("n"))


@query("SELECT contig_id, len, cov FROM contigs WHERE len >= 300 AND cov >= 2.0")
def contig_sorted(spark, sf_dir):
    return C.longest_first(C.filtered(contigs(spark, sf_dir), 300, 2.0)).select("contig_id", "len", "cov")


@query(f"SELECT {_HEADER.format('_len_')} || chr(10) || coalesce(seq, '') AS value FROM contigs")
def contig_fasta_format(spark, sf_dir):
    return C.as_fasta(contigs(spark, sf_dir))


@query(f"SELECT coalesce(contig_id, '') || chr(9) || coalesce(CAST(len AS VARCHAR), '') || chr(9) || {' || chr(9) || '.join(_TEXT.format(c) for c in ('cov', 'stdev', 'gc'))} || chr(9) || coalesce(seed, '') || chr(9) || coalesce(seq, '') AS value FROM contigs")
def contig_table_format(spark, sf_dir):
    return C.as_table(contigs(spark, sf_dir))


@query("""SELECT contig_id, len, CAST(printf('%.1f', cov) AS DOUBLE) AS cov, CAST(printf('%.1f', stdev) AS DOUBLE) AS stdev, CAST(printf('%.1f', gc) AS DOUBLE) AS gc, seed, coalesce(seq, '') AS seq
FROM contigs WHERE len >= 200 AND cov IS NOT NULL AND stdev IS NOT NULL AND gc IS NOT NULL AND seed IS NOT NULL AND contig_id IS NOT NULL""")
def fasta_to_table(spark, sf_dir):
    rows = contigs(spark, sf_dir).select(C.fasta_header(spaced=True).alias("header"), F.coalesce("seq", F.lit("")).alias("seq"))
    return C.from_fasta(rows, 200)


@query("""SELECT contig_ord, CASE WHEN length(seq) >= 2000 THEN 'long' WHEN length(seq) >= 600 THEN 'medium' ELSE 'short' END AS tier FROM contigs WHERE length(seq) >= 300""")
def length_tier(spark, sf_dir):
    return contigs(spark, sf_dir).select("contig_ord", C.tier(F.length("seq")).alias("tier")).where("tier is not null")


@query("""SELECT contig_ord, CASE WHEN length(seq) > 0 THEN round(100.0 * length(regexp_replace(seq, '[^GCgc]', '', 'g')) / length(seq), 3) END AS gc_now FROM contigs""")
def contig_gc(spark, sf_dir):
    return contigs(spark, sf_dir).select("contig_ord", F.round(gc_content(F.col("seq")), 3).alias("gc_now"))


@query("""WITH s AS (SELECT cpu AS contig, sum(CAST(length(kmer) AS DOUBLE) * n_count) AS w, sum(CAST(length(kmer) AS DOUBLE) * n_count * n_count) AS w2, sum(length(kmer)) AS n
  FROM hashbuckets WHERE kmer IS NOT NULL AND n_count IS NOT NULL GROUP BY cpu)
SELECT contig, round(w / n, 4) AS cov, round(sqrt(greatest(0, w2 / n - (w / n) * (w / n))), 4) AS stdev FROM s""")
def coverage(spark, sf_dir):
    """Coverage statistics of the index shards, each flush being a stretch of its k-mer's length."""
    rows = table(spark, sf_dir, "hashbuckets").where("kmer is not null and n_count is not null")
    edges = rows.groupBy(F.col("cpu").alias("contig")).agg(F.sum(F.length("kmer")).alias("length"))
    spans = rows.select(F.col("cpu").alias("contig"), F.length("kmer").alias("span"), F.col("n_count").cast("double").alias("weight"))
    found = C.coverage(spans.join(F.broadcast(edges), "contig"))  # one row for each shard
    return found.select("contig", F.round("cov", 4).alias("cov"), F.round("stdev", 4).alias("stdev"))


@query("""WITH e AS (SELECT substr(kmer, 1, 24) AS src, substr(kmer, 25, 1) AS base, sum(coalesce(n_count, 0)) AS weight FROM hashbuckets
  WHERE kmer IS NOT NULL AND NOT contains(kmer, 'N') GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, base) AS n FROM e)
SELECT src, base, CAST(weight AS BIGINT) AS weight FROM n WHERE n = 1""")
def best_edge(spark, sf_dir):
    """Heaviest way on from each (k-1)-mer, ties in base order."""
    rows = table(spark, sf_dir, "hashbuckets").where("kmer is not null and not contains(kmer, 'N')")
    edges = rows.groupBy(F.substring("kmer", 1, 24).alias("src"), F.substring("kmer", 25, 1).alias("base")).agg(F.sum(F.coalesce("n_count", F.lit(0))).alias("weight"))
    best = Window.partitionBy("src").orderBy(F.desc("weight"), "base")
    return edges.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


@query("""WITH e AS (SELECT substr(kmer, 1, 24) AS src, substr(kmer, 2, 24) AS dst, CAST(sum(n_count) AS BIGINT) AS weight FROM hashbuckets
  WHERE kmer IS NOT NULL AND n_count IS NOT NULL AND NOT contains(kmer, 'N') GROUP BY 1, 2)
SELECT '"' || src || '" -> "' || dst || '" [label="' || weight || '"];' AS value FROM e""")
def graph_dot(spark, sf_dir):
    """All edges of the index as a drawing."""
    rows = table(spark, sf_dir, "hashbuckets").where("kmer is not null and n_count is not null and not contains(kmer, 'N')")
    edges = rows.groupBy(F.substring("kmer", 1, 24).alias("src"), F.substring("kmer", 2, 24).alias("dst")).agg(F.sum("n_count").alias("weight"))
    return C.as_dot(edges)
