"""Queries over components and assembled contigs; the SQL follows paths by recursion where Spark doubles pointers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, components, exact, kmers
from .reads import ORACLE as READ_SQL
from .reads import READS, reads

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def windows(spark, sf_dir):
    """Reads cut to one length; a window is known by its read and its part."""
    parts = kmers.split_reads(reads(spark, sf_dir), 75, 25)
    return parts.select(F.struct("read_id", "part").alias("read_id"), F.coalesce("name", F.lit("?")).alias("name"), "seq")


#: The windows in SQL, and reads that assembly takes, as ``v``, numbered in file order.
_WINDOWS = f"y AS ({READ_SQL['split_varlen']}), v AS (SELECT row_number() OVER (ORDER BY read_id, part) AS id, read_id, part, coalesce(name, '?') AS name, seq FROM y WHERE NOT contains(seq, 'N'))"
_WHOLE = READS[len("WITH ") :] + ", v AS (SELECT row_number() OVER (ORDER BY read_id) AS id, read_id, 0 AS part, name, seq FROM r WHERE NOT contains(seq, 'N') AND length(seq) >= 25)"
_BACK = "reverse(translate({}, 'ACGT', 'TGCA'))"
#: Reads that are equal on either strand as one, as ``d``.
_DISTINCT = f"""f AS (SELECT *, row_number() OVER (PARTITION BY least(seq, {_BACK.format('seq')}) ORDER BY id) AS nth, count(*) OVER (PARTITION BY least(seq, {_BACK.format('seq')})) AS occr FROM v),
d AS (SELECT * EXCLUDE (nth) FROM f WHERE nth = 1)"""
#: Those that lie within no other.
_OUTER = f"""hp AS (SELECT id AS host, substr(seq, CAST(i + 1 AS INT), 25) AS kmer, substr(seq, CAST(i + 1 AS INT)) AS rest, length(seq) AS size FROM d, unnest(range(0, length(seq) - 24)) AS t(i)),
ip AS (SELECT id, seq FROM d UNION ALL SELECT id, {_BACK.format('seq')} FROM d),
e AS (SELECT * FROM d WHERE id NOT IN (SELECT ip.id FROM ip JOIN hp ON substr(ip.seq, 1, 25) = hp.kmer WHERE size > length(ip.seq) AND starts_with(rest, ip.seq)))"""


def _paths(source: str, taken: str, by_letter: bool) -> str:
    letter = "substr(o, CAST(i + 1 AS INT), 1)" if by_letter else "''"
    return f"""WITH RECURSIVE {source}, n AS (SELECT id * 2 AS node, occr, seq AS o FROM {taken} UNION ALL SELECT id * 2 + 1, occr, {_BACK.format('seq')} FROM {taken}),
t AS (SELECT node, i AS n, substr(o, CAST(length(o) - i + 1 AS INT)) AS s FROM n, unnest(range(25, length(o))) AS u(i)),
x AS (SELECT substr(o, 1, CAST(i AS INT)) AS s, {letter} AS base, sum(occr) AS w, min(node) AS lo, max(node) AS hi FROM n, unnest(range(25, length(o))) AS u(i) GROUP BY 1, 2),
c AS (SELECT node, base, n, w, CASE WHEN lo // 2 <> node // 2 THEN lo WHEN hi // 2 <> node // 2 THEN hi END AS nxt FROM t JOIN x USING (s)),
b AS (SELECT node, base, sum(w) AS w, max(n) AS ovl, arg_max(nxt, n) AS nxt FROM c WHERE nxt IS NOT NULL GROUP BY 1, 2),
g AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, base) = 1),
m AS (SELECT g.node, g.nxt, g.ovl, g.w FROM g JOIN g h ON h.node = xor(g.nxt, 1) AND h.nxt = xor(g.node, 1) AND h.ovl = g.ovl),
walk AS (SELECT node AS head, node, node AS low, 0 AS place, o, length(o) * occr AS w, length(o) * occr * occr AS w2, occr AS reads FROM n WHERE node NOT IN (SELECT nxt FROM m)
  UNION ALL SELECT head, m.nxt, least(low, m.nxt), place + 1, walk.o || substr(n.o, CAST(ovl + 1 AS INT)), walk.w + (length(n.o) - ovl) * m.w, walk.w2 + (length(n.o) - ovl) * m.w * m.w, reads + n.occr
  FROM walk JOIN m ON m.node = walk.node JOIN n ON n.node = m.nxt),
away AS (SELECT node, nxt FROM m WHERE node NOT IN (SELECT node FROM walk) UNION SELECT away.node, m.nxt FROM away JOIN m ON m.node = away.nxt),
low AS (SELECT min(nxt) AS head FROM away GROUP BY node),
ring AS (SELECT DISTINCT head, head AS node, head AS low, 0 AS place, o, length(o) * occr AS w, length(o) * occr * occr AS w2, occr AS reads FROM low JOIN n ON n.node = head
  UNION ALL SELECT head, m.nxt, least(low, m.nxt), place + 1, ring.o || substr(n.o, CAST(ovl + 1 AS INT)), ring.w + (length(n.o) - ovl) * m.w, ring.w2 + (length(n.o) - ovl) * m.w * m.w, reads + n.occr
  FROM ring JOIN m ON m.node = ring.node JOIN n ON n.node = m.nxt WHERE m.nxt <> head),
p AS (SELECT * FROM (SELECT * FROM walk UNION ALL SELECT * FROM ring) QUALIFY row_number() OVER (PARTITION BY head ORDER BY place DESC) = 1),
k AS (SELECT d.read_id AS seed_read, d.part AS seed_part, CAST(length(o) AS INT) AS len, w / length(o) AS cov, sqrt(greatest(0, w2 / length(o) - (w / length(o)) * (w / length(o)))) AS stdev, d.name AS seed, reads, o AS seq
  FROM p JOIN d ON d.id = p.low // 2 WHERE low % 2 = 0)"""


_CONTIGS = _paths(f"{_WINDOWS}, {_DISTINCT}", "d", True)
_GC = "100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq)"


@query(f"""WITH RECURSIVE {_WINDOWS},
s AS (SELECT id, seq AS o FROM v UNION ALL SELECT id, {_BACK.format('seq')} FROM v),
hub AS (SELECT substr(o, 1, 25) AS kmer, min(id) AS b FROM s GROUP BY 1),
held AS (SELECT id AS a, substr(o, CAST(i + 1 AS INT), 25) AS kmer FROM s, unnest(range(0, length(o) - 24)) AS t(i)),
e AS (SELECT DISTINCT a, b FROM held JOIN hub USING (kmer) WHERE a <> b), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT id, id AS comp FROM v UNION SELECT u.b, c.comp FROM c JOIN u ON u.a = c.id WHERE c.comp < u.b),
l AS (SELECT id, min(comp) AS comp FROM c GROUP BY id)
SELECT a.read_id, a.part, b.read_id AS comp_read, b.part AS comp_part FROM l JOIN v a ON a.id = l.id JOIN v b ON b.id = l.comp""")
def overlap_components(spark, sf_dir):
    found = components.overlap_components(windows(spark, sf_dir), 25)
    return found.select("id.read_id", "id.part", F.col("comp.read_id").alias("comp_read"), F.col("comp.part").alias("comp_part"))


def _contigs(spark, sf_dir):
    return assembly.contigs(windows(spark, sf_dir), 25)


@query(f"{_CONTIGS} SELECT seed_read, seed_part, len, round(cov, 4) AS cov, round(stdev, 4) AS stdev, round({_GC}, 4) AS gc, seed, seq FROM k WHERE len > 125")
def contigs(spark, sf_dir):
    return _contigs(spark, sf_dir).select(
        F.col("seed_id.read_id").alias("seed_read"), F.col("seed_id.part").alias("seed_part"), "len", F.round("cov", 4).alias("cov"), F.round("stdev", 4).alias("stdev"), F.round("gc", 4).alias("gc"), "seed", "seq"
    )


@query(f"""{_CONTIGS} SELECT 'Contig_0_' || (row_number() OVER (ORDER BY seed_read, seed_part) - 1) AS contig_id, seed_read, seed_part, len, seed FROM k WHERE len > 125""")
def contigs_numbered(spark, sf_dir):
    """The contigs with the names under which they are written."""
    found = assembly.numbered(_contigs(spark, sf_dir))
    return found.select("contig_id", F.col("seed_id.read_id").alias("seed_read"), F.col("seed_id.part").alias("seed_part"), "len", "seed")


@query(f"{_paths(f'{_WHOLE}, {_DISTINCT}, {_OUTER}', 'e', False)} SELECT seed_read AS seed_id, len, CASE WHEN len >= 2000 THEN 'long' WHEN len >= 600 THEN 'medium' ELSE 'short' END AS tier, seed, seq FROM k WHERE len >= 300")
def exact_contigs(spark, sf_dir):
    return exact.exact_contigs(reads(spark, sf_dir), 25)


@query(f"{_paths(f'{_WINDOWS}, {_DISTINCT}', 'd', False)} SELECT seed_read, seed_part, len, round(cov, 4) AS cov, round(stdev, 4) AS stdev, seed, seq FROM k")
def unitigs(spark, sf_dir):
    found = assembly.unitigs(windows(spark, sf_dir), 25)
    return found.select(F.col("seed_id.read_id").alias("seed_read"), F.col("seed_id.part").alias("seed_part"), "len", F.round("cov", 4).alias("cov"), F.round("stdev", 4).alias("stdev"), "seed", "seq")


@query(f"""{_CONTIGS}, u AS (SELECT seed_read, seed_part, len, reads, coalesce(sum(reads) OVER (ORDER BY seed_read, seed_part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(reads) OVER () AS total FROM k)
SELECT seed_read, seed_part, len, CAST(reads AS BIGINT) AS reads FROM u WHERE used < total * 0.5""")
def contigs_until_half(spark, sf_dir):
    """Contigs until half of the reads are used."""
    found = assembly.until_depleted(windows(spark, sf_dir), 25, 0.5)
    return found.select(F.col("seed_id.read_id").alias("seed_read"), F.col("seed_id.part").alias("seed_part"), "len", "reads")
