"""Queries over the training-data operators, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import canonical, encode, encoding, frequent, leaks, neighbors, pieces, spans

Query = Callable[[SparkSession, str], DataFrame]


def _frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.frequent_items(table(spark, sf_dir, "hashbuckets").select("kmer", "n_count"), "kmer", "n_count", 20)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).select(F.col("item").alias("kmer"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).select(F.col("item").alias("kmer"), F.col("total").cast("bigint").alias("total"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "reads"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(table(spark, sf_dir, "contigs"))


def p4_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of any length within the limit that keep the longest gaps as boundaries."""
    return pieces.split_oversized(table(spark, sf_dir, "contigs"), keep="gap")


def _neighbors(profiles: DataFrame) -> DataFrame:
    return neighbors.nearest(profiles.where("word_len = 3"), "vec_id", "vector", dim=64, k=5, min_cosine=0.9)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _neighbors(table(spark, sf_dir, "profiledb"))
    return found.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


def p5_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of at least 0.9 only; ``p5_nearest`` has all."""
    profiles = table(spark, sf_dir, "profiledb")
    return _named(_neighbors(profiles), profiles)


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "profiledb")
    return _named(neighbors.nearest_of_all(profiles.where("word_len = 3"), "vec_id", "vector", dim=64, k=5), profiles)


def _named(found: DataFrame, profiles: DataFrame) -> DataFrame:
    names = profiles.select("vec_id", "name")
    return (
        found
        .join(names.select(F.col("vec_id").alias("id"), "name"), "id")
        .join(names.select(F.col("vec_id").alias("other"), F.col("name").alias("other_name")), "other")
        .select(F.col("id").alias("vec_id"), "name", "place", F.col("other").alias("other_id"), "other_name", F.round("cosine", 4).alias("cosine"))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.copies(table(spark, sf_dir, "fasta_records"))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.records(table(spark, sf_dir, "fasta_records"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks.without_leaks(documents, table(spark, sf_dir, "eval_items"), remove="documents")


def p8_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks.without_leaks(documents, table(spark, sf_dir, "eval_items"), remove="spans")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_restored(spark, sf_dir).select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p2_found, p2_totals, p3_found, p4_found, p4_by_gap, p5_found, p5_neighbors, p5_nearest, p6_found, p6_records, p7_ids, p8_found, p8_clean, p8_cut, p9_found, p9_restored)
}

_TOTALS = """
SELECT kmer, CAST(sum(coalesce(n_count, 0)) AS BIGINT) AS total FROM hashbuckets
WHERE kmer IS NOT NULL GROUP BY kmer HAVING sum(coalesce(n_count, 0)) > 0 ORDER BY total DESC, kmer LIMIT 20
"""

_UNIT = """
WITH v AS (
  SELECT vec_id, name, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS u
  FROM profiledb
  WHERE word_len = 3 AND len(vector) = 64 AND list_sum(list_transform(vector, lambda y: y * y)) > 0
), pairs AS (
  SELECT a.vec_id AS id, a.name AS name, b.vec_id AS other, b.name AS other_name, round(list_inner_product(a.u, b.u), 9) AS cosine
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
), top AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS place FROM pairs
)
"""

_KEYS = "seed", "id", "len", "cov", "gc"
_SEP = "[^\\p{L}\\p{N}]"
_NAMES = "|".join(_KEYS)


def _field(name: str) -> str:
    # DuckDB's expressions look nowhere ahead: cut off what stands before the value, then everything from the next name on
    tail = f"regexp_extract(' ' || lower(header) || ' ', '{_SEP}{name}{_SEP}+(.*)$', 1, 's')"
    return f"regexp_replace(regexp_replace({tail}, '{_SEP}({_NAMES}){_SEP}.*$', '', 's'), '{_SEP}', '', 'g')"


_CANON = f"""
WITH c AS (
  SELECT rec_id, {", ".join(f"{_field(k)} AS f_{k}" for k in _KEYS)}, header, seq,
         lower(regexp_replace(seq, '\\P{{L}}', '', 'g')) AS letters
  FROM fasta_records WHERE seq IS NOT NULL
), g AS (
  SELECT rec_id, CASE WHEN {" AND ".join(f"f_{k} <> ''" for k in _KEYS)}
    THEN concat_ws('|', {", ".join(f"f_{k}" for k in _KEYS)}, letters)
    ELSE '#' || coalesce('h' || header, '') || '#' || seq END AS canon
  FROM c
)
"""

_GRAMS = """
WITH dw AS (
  SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL
), iw AS (
  SELECT item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL
), dg AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM dw, unnest(range(1, greatest(len(w) - 10, 1))) AS t(i)
), ig AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM iw, unnest(range(1, greatest(len(w) - 10, 1))) AS t(i)
)
"""

ORACLE: dict[str, str] = {
    "p2_found": f"SELECT kmer FROM ({_TOTALS})",
    "p2_totals": _TOTALS,
    "p3_found": """
WITH w AS (
  SELECT read_id, i AS beg, substr(seq, CAST(i + 1 AS INT), 72) AS s
  FROM reads, unnest(range(0, greatest(length(seq) - 71, 0))) AS t(i) WHERE seq IS NOT NULL
), shared AS (
  SELECT s FROM w GROUP BY s HAVING count(DISTINCT read_id) > 1
), hit AS (
  SELECT DISTINCT read_id, beg FROM w JOIN shared USING (s)
), mark AS (
  SELECT read_id, beg, CASE WHEN beg <= lag(beg) OVER (PARTITION BY read_id ORDER BY beg) + 72 THEN 0 ELSE 1 END AS new FROM hit
), run AS (
  SELECT read_id, beg, sum(new) OVER (PARTITION BY read_id ORDER BY beg) AS r FROM mark
)
SELECT read_id, CAST(min(beg) AS BIGINT) AS beg_pos, CAST(max(beg) + 72 AS BIGINT) AS end_pos FROM run GROUP BY read_id, r
""",
    "p4_found": """
WITH RECURSIVE parts AS (
  SELECT contig_ord, length(seq) AS n, string_split_regex(seq, '[^ACGTacgt]{10,}') AS p, regexp_extract_all(seq, '[^ACGTacgt]{10,}') AS g
  FROM contigs WHERE length(seq) > 2000
), gaps AS (
  SELECT contig_ord, n,
    list_transform(range(1, len(g) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(g[1:i], lambda x: length(x)))) AS ends
  FROM parts
), piece AS (
  SELECT contig_ord, n, ends, CAST(0 AS BIGINT) AS beg,
    CAST(coalesce(list_max(list_filter(ends, lambda e: e > 50 AND e <= 2000)), 2000) AS BIGINT) AS fin
  FROM gaps
  UNION ALL
  SELECT contig_ord, n, ends, fin - 50,
    CAST(CASE WHEN n - (fin - 50) <= 2000 THEN n ELSE coalesce(list_max(list_filter(ends, lambda e: e > fin AND e <= fin + 1950)), fin + 1950) END AS BIGINT)
  FROM piece WHERE fin < n
)
SELECT contig_ord, beg AS beg_pos, fin AS end_pos FROM piece
""",
    "p5_found": _UNIT + "SELECT DISTINCT least(id, other) AS vec_a, greatest(id, other) AS vec_b FROM top WHERE place <= 5 AND cosine >= 0.9",
    "p5_neighbors": _UNIT + "SELECT id AS vec_id, name, CAST(place AS INT) AS place, other AS other_id, other_name, round(cosine, 4) AS cosine FROM top WHERE place <= 5 AND cosine >= 0.9",
    "p5_nearest": _UNIT + "SELECT id AS vec_id, name, CAST(place AS INT) AS place, other AS other_id, other_name, round(cosine, 4) AS cosine FROM top WHERE place <= 5",
    "p6_found": _CANON + """, k AS (SELECT canon, min(rec_id) AS keep_id FROM g GROUP BY canon)
SELECT DISTINCT keep_id, rec_id FROM g JOIN k USING (canon) WHERE keep_id < rec_id""",
    "p6_records": _CANON + """SELECT min(rec_id) AS rec_id, count(*) AS n_copies FROM g GROUP BY canon
UNION ALL SELECT rec_id, 1 FROM fasta_records WHERE seq IS NULL""",
    "p8_found": _GRAMS + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p8_cut": _GRAMS.replace("SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g", "SELECT DISTINCT doc_id, i, array_to_string(w[i:i + 11], ' ') AS g") + """, gone AS (
  SELECT doc_id, flatten(list(range(i, i + 12))) AS gone_at FROM (SELECT DISTINCT doc_id, i FROM dg JOIN ig USING (g)) GROUP BY doc_id
), parts AS (
  SELECT doc_id, gone_at, regexp_extract(text, '^[^\\p{L}\\p{N}]*') AS lead, regexp_extract_all(text, '[\\p{L}\\p{N}]+[^\\p{L}\\p{N}]*') AS p, text FROM documents LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CASE WHEN gone_at IS NULL THEN text ELSE lead || array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda j: NOT list_contains(gone_at, j)), lambda j: p[j]), '') END AS text FROM parts""",
    "p8_clean": _GRAMS + "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dg JOIN ig USING (g))",
}
