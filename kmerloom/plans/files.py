"""Queries over files: tables written as FASTA and FASTQ in a scratch folder and scanned again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kmers
from ..session import scratch, spread, table
from ..sources import fastx

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_NAMED = "coalesce(regexp_replace(name, '[ ,\t\r\n]', '_', 'g'), '')"


def _written(rows, value):
    path = scratch(rows.sparkSession)
    rows.select(value.alias("value")).write.text(path)
    return path


def _name():
    return F.coalesce(F.regexp_replace("name", "[ ,\t\r\n]", "_"), F.lit(""))


@query(f"SELECT {_NAMED} || '_' || read_id AS name, regexp_replace(coalesce(seq, ''), '\\s', '', 'g') AS seq FROM reads")
def fasta_scan(spark, sf_dir):
    """All reads as FASTA in lines of 60 letters, scanned in ranges of 64 KB."""
    rows = spread(table(spark, sf_dir, "reads").select("read_id", "name", "seq"))
    lines = F.array_join(F.regexp_extract_all(F.coalesce("seq", F.lit("")), F.lit(".{1,60}"), 0), "\n")
    path = _written(rows, F.concat(F.lit(">"), _name(), F.lit("_"), "read_id", F.lit(" len "), F.length(F.coalesce("seq", F.lit(""))), F.lit("\n"), lines))
    return fastx.read_fastx(spark, path, split_bytes=1 << 16).select("name", "seq")


@query(f"SELECT {_NAMED} || '_' || read_id AS name, seq, qual FROM reads WHERE qual IS NOT NULL AND length(qual) > 0 AND length(qual) = length(seq)")
def fastq_scan(spark, sf_dir):
    """The reads that have qualities as FASTQ, scanned in ranges of 64 KB."""
    rows = spread(table(spark, sf_dir, "reads").select("read_id", "name", "seq", "qual")).where("length(qual) > 0 and length(qual) = length(seq)")
    path = _written(rows, F.concat(F.lit("@"), _name(), F.lit("_"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual"))
    return fastx.read_fastx(spark, path, split_bytes=1 << 16).select("name", "seq", "qual")


@query("""WITH r AS (SELECT regexp_replace(translate(regexp_replace(seq, '\\s', '', 'g'), 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq FROM reads WHERE seq IS NOT NULL),
s AS (SELECT seq AS o FROM r WHERE NOT contains(seq, 'N') UNION ALL SELECT reverse(translate(seq, 'ACGT', 'TGCA')) FROM r WHERE NOT contains(seq, 'N'))
SELECT substr(o, 1, 25) AS kmer, count(*) AS n FROM s WHERE length(o) >= 25 GROUP BY 1""")
def load_and_index(spark, sf_dir):
    """Reads written as FASTA, loaded, and indexed by the beginnings of both strands."""
    rows = spread(table(spark, sf_dir, "reads").where("seq is not null").select("read_id", "seq"))
    loaded = fastx.load_reads(spark, _written(rows, F.concat(F.lit(">r"), "read_id", F.lit("\n"), "seq")))
    return kmers.end_kmers(loaded, 25).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT regexp_replace(regexp_replace(header, '^>', ''), '[\\t\\r\\n].*$', '', 's') AS name, regexp_replace(seq, '\\s', '', 'g') AS seq FROM fasta_records
WHERE seq IS NOT NULL AND header IS NOT NULL AND NOT contains(seq, '>')""")
def parsed_records(spark, sf_dir):
    """Records as they came in, each parsed from its text."""
    rows = spread(table(spark, sf_dir, "fasta_records").select("header", "seq")).where("seq is not null and header is not null and not contains(seq, '>')")
    head = F.regexp_replace(F.regexp_replace("header", "^>", ""), "[\r\n](?s).*$", "")
    return fastx.parse_text(rows.select(F.concat(F.lit(">"), head, F.lit("\n"), "seq").alias("value")))
