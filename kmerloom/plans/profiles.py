"""Queries over composition profiles and translated search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.align import LETTERS, SCORES, alignment_bits
from ..functions.sequence import e_value, translate_dna, upcase
from ..operators import profiles, search
from ..session import scratch, spread, table
from ..sources.profiles import as_lines, bin_lines, read_db, write_db
from .reads import READS, _frame_sql, reads

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def by_file(spark, sf_dir):
    """Reads with their file as class."""
    rows = spread(table(spark, sf_dir, "reads").select("read_id", "name", "file_ord", "seq")).where("seq is not null and file_ord is not null")
    return rows.select("read_id", "name", "file_ord", upcase(F.col("seq")).alias("seq"))


def _codes(k: int) -> str:
    """Both-strand codes of all reads with a file, in SQL, as ``w``."""
    digit = "CAST(translate(replace(x[j], 'N', 'A'), 'AGCT', '0123') AS BIGINT)"
    code = f"CAST(list_sum(list_transform(range(1, {k} + 1), lambda j: {digit} * CAST(power(4, {k} - j) AS BIGINT))) AS BIGINT)"
    return f"""{READS}, g AS (SELECT read_id, name, file_ord, seq FROM r WHERE file_ord IS NOT NULL),
o AS (SELECT read_id, file_ord, seq AS s FROM g UNION ALL SELECT read_id, file_ord, reverse(translate(seq, 'ACGT', 'TGCA')) FROM g),
x AS (SELECT read_id, file_ord, substr(s, CAST(i + 1 AS INT), {k}) AS x FROM o, unnest(range(0, greatest(length(s) - {k - 1}, 0))) AS t(i)),
w AS (SELECT read_id, file_ord, {code} AS code FROM x)"""


@query(_codes(4) + """, f AS (SELECT code, count(*) AS n FROM w GROUP BY code), l AS (SELECT CAST(j AS INT) AS level, code // CAST(power(4, 4 - j) AS BIGINT) AS code, n FROM f, unnest(range(0, 5)) AS t(j))
SELECT level, code, CAST(sum(n) AS BIGINT) AS cnt FROM l GROUP BY level, code""")
def kmer_freq_levels(spark, sf_dir):
    return profiles.frequencies(by_file(spark, sf_dir), [], 4)


_FREQ = _codes(4) + ", c4 AS (SELECT file_ord, code, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY file_ord, code), " + ", ".join(
    f"c{j} AS (SELECT file_ord, code // {4 ** (4 - j)} AS code, sum(n) AS n FROM c4 GROUP BY 1, 2)" for j in range(4)
)
_WEIGHTS = _FREQ + """, d AS (SELECT DISTINCT file_ord FROM c4), a AS (SELECT file_ord, CAST(x AS BIGINT) AS code FROM d, unnest(range(0, 256)) AS t(x)),
v AS (SELECT a.file_ord, a.code, coalesce(11.0 * ln(c4.n / c3.n) + ln(c3.n / c2.n), -20.0) AS w FROM a
  LEFT JOIN c4 ON c4.file_ord = a.file_ord AND c4.code = a.code LEFT JOIN c3 ON c3.file_ord = a.file_ord AND c3.code = a.code // 4 LEFT JOIN c2 ON c2.file_ord = a.file_ord AND c2.code = a.code // 16)"""


def _trained(spark, sf_dir, k: int = 4):
    return profiles.densify(profiles.weights(profiles.frequencies(by_file(spark, sf_dir), ["file_ord"], k), ["file_ord"], k), ["file_ord"], k)


@query(_WEIGHTS + " SELECT file_ord, code, round(w, 6) AS w FROM v")
def profile_weights(spark, sf_dir):
    return _trained(spark, sf_dir).select("file_ord", "code", F.round("w", 6).alias("w"))


@query(_FREQ + """, d AS (SELECT DISTINCT file_ord FROM c4), a AS (SELECT file_ord, CAST(x AS BIGINT) AS code FROM d, unnest(range(0, 256)) AS t(x)),
b AS (SELECT a.file_ord, a.code, c4.n AS f, c3.n AS f1, g2.n AS ga, g1.n AS ga1, h3.n AS gb, h2.n AS gb1 FROM a
  LEFT JOIN c4 ON c4.file_ord = a.file_ord AND c4.code = a.code LEFT JOIN c3 ON c3.file_ord = a.file_ord AND c3.code = a.code // 4
  LEFT JOIN c2 g2 ON g2.file_ord = a.file_ord AND g2.code = a.code % 16 LEFT JOIN c1 g1 ON g1.file_ord = a.file_ord AND g1.code = (a.code % 16) // 4
  LEFT JOIN c3 h3 ON h3.file_ord = a.file_ord AND h3.code = a.code % 64 LEFT JOIN c2 h2 ON h2.file_ord = a.file_ord AND h2.code = (a.code % 64) // 4)
SELECT file_ord, code, round(CASE WHEN f1 > 0 AND ga1 > 0 THEN ln((coalesce(f, 0.1) / f1) / (coalesce(ga, 0.1) / ga1)) / ln(2) ELSE 0 END
  + CASE WHEN f1 > 0 AND gb1 > 0 THEN ln((coalesce(f, 0.1) / f1) / (coalesce(gb, 0.1) / gb1)) / ln(2) ELSE 0 END, 6) AS w FROM b""")
def profile_weights_smoothed(spark, sf_dir):
    freq = profiles.frequencies(by_file(spark, sf_dir), ["file_ord"], 4)
    return profiles.smoothed_weights(freq, ["file_ord"], 4).select("file_ord", "code", F.round("w", 6).alias("w"))


def _classified(spark, sf_dir):
    """Reads that are as many as the table holds; N counts as A, which is how their profiles count it."""
    weights = _trained(spark, sf_dir).select(F.col("file_ord").alias("class_ord"), F.concat(F.lit("file "), "file_ord").alias("class"), F.col("code"), F.round("w", 6).alias("w"))
    return profiles.classify(reads(spark, sf_dir), weights, 4)


@query(_WEIGHTS + """, n AS (SELECT read_id, code, count(*) AS n FROM w GROUP BY 1, 2), q AS (SELECT read_id, v.file_ord AS class_ord, sum(n * round(v.w, 6)) AS s FROM n JOIN v USING (code) GROUP BY 1, 2),
e AS (SELECT r.read_id, r.name, d.file_ord AS class_ord, round(coalesce(s, 0.0), 6) AS score FROM r CROSS JOIN d LEFT JOIN q ON q.read_id = r.read_id AND q.class_ord = d.file_ord),
k AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, class_ord) AS k, lead(score) OVER (PARTITION BY read_id ORDER BY score DESC, class_ord) AS second, max(score) OVER (PARTITION BY read_id ORDER BY class_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT read_id, name, CAST(class_ord AS BIGINT) AS class_ord, 'file ' || class_ord AS class, round(score, 3) AS score, round(score - second, 3) AS margin, round(score - coalesce(before, -1e10), 3) AS margin_seq FROM k WHERE k = 1""")
def classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("read_id", "name", "class_ord", "class", F.round("score", 3).alias("score"), F.round("margin", 3).alias("margin"), F.round("margin_seq", 3).alias("margin_seq"))


@query(f"SELECT '>' || name || chr(10) || class AS value FROM ({ORACLE['classify']}) WHERE name IS NOT NULL")
def classify_bins(spark, sf_dir):
    return bin_lines(_classified(spark, sf_dir).where("name is not null"))


def _training(spark, sf_dir):
    """Reads under the class whose number is that of their file; those without a path share one name."""
    classes = table(spark, sf_dir, "train_classes").select(F.col("class_ord").alias("ord"), F.when(F.col("path").isNotNull(), F.col("class_name")).otherwise("unnamed").alias("class"))
    return by_file(spark, sf_dir).select(F.col("file_ord").alias("ord"), "seq").join(F.broadcast(classes), "ord")  # one row for each class


_TRAINED = _codes(4) + """, j AS (SELECT w.file_ord AS ord, CASE WHEN path IS NOT NULL THEN class_name ELSE 'unnamed' END AS class, code FROM w JOIN train_classes ON class_ord = file_ord),
u AS (SELECT ord, class, {run} AS run FROM (SELECT DISTINCT ord, class FROM j)), z AS (SELECT j.class, run, j.ord, code FROM j JOIN u USING (ord)),
y AS (SELECT *, min(ord) OVER (PARTITION BY class, run) AS class_ord FROM z), n4 AS (SELECT class_ord, class, code, count(*) AS n FROM y GROUP BY 1, 2, 3),
n3 AS (SELECT class_ord, code // 4 AS code, sum(n) AS n FROM n4 GROUP BY 1, 2), n2 AS (SELECT class_ord, code // 16 AS code, sum(n) AS n FROM n4 GROUP BY 1, 2),
a AS (SELECT class_ord, class, CAST(x AS BIGINT) AS code FROM (SELECT DISTINCT class_ord, class FROM n4), unnest(range(0, 256)) AS t(x))
SELECT CAST(a.class_ord AS INT) AS class_ord, a.class, a.code, round(coalesce(11.0 * ln(n4.n / n3.n) + ln(n3.n / n2.n), -20.0), 6) AS w FROM a
  LEFT JOIN n4 ON n4.class_ord = a.class_ord AND n4.code = a.code LEFT JOIN n3 ON n3.class_ord = a.class_ord AND n3.code = a.code // 4 LEFT JOIN n2 ON n2.class_ord = a.class_ord AND n2.code = a.code // 16"""


@query(_TRAINED.format(run="0"))
def train_classes(spark, sf_dir):
    return profiles.train(_training(spark, sf_dir), 4).select("class_ord", "class", "code", F.round("w", 6).alias("w"))


@query(_TRAINED.replace("(SELECT DISTINCT ord, class FROM j)), z", "(SELECT *, CASE WHEN class = lag(class) OVER (ORDER BY ord) THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT ord, class FROM j))), z").format(run="sum(new) OVER (ORDER BY ord)"))
def train_adjacent(spark, sf_dir):
    """A class that returns after another one is a class of its own."""
    return profiles.train(_training(spark, sf_dir), 4, adjacent=True).select("class_ord", "class", "code", F.round("w", 6).alias("w"))


@query()
def train_and_classify(spark, sf_dir):
    """The whole job at the default word length, 16,384 words for each class."""
    weights = profiles.train(_training(spark, sf_dir))
    return profiles.classify(reads(spark, sf_dir), weights, 7)


@query("""WITH c AS (SELECT vec_id, regexp_replace(coalesce(name, ''), '[:\\n]', ' ', 'g') AS name, vector FROM profiledb WHERE word_len = 3 AND len(vector) = 64),
n AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS line FROM c)
SELECT line AS class_ord, name AS class, CAST(i - 1 AS BIGINT) AS code, CAST(CASE WHEN abs(vector[i] - trunc(vector[i])) < 0.00001 THEN printf('%.0f', vector[i]) ELSE printf('%7.5f', vector[i]) END AS DOUBLE) AS w FROM n, unnest(range(1, 65)) AS t(i)""")
def profile_db_round(spark, sf_dir):
    """The profiles of three letters, written as a text database and read again."""
    rows = table(spark, sf_dir, "profiledb").where("word_len = 3 and size(vector) = 64")
    dense = rows.select(F.col("vec_id").alias("class_ord"), F.regexp_replace(F.coalesce("name", F.lit("")), "[:\n]", " ").alias("class"), F.posexplode("vector").alias("code", "w"))
    path = scratch(spark)
    write_db(dense, 3, path)
    return read_db(spark, path)[0]


@query("""SELECT vec_id, concat_ws(':', coalesce(name, ''), array_to_string(list_transform(vector, lambda v: CASE WHEN abs(v - trunc(v)) < 0.00001 THEN printf('%.0f', v) ELSE printf('%7.5f', v) END), ':')) AS value
FROM profiledb WHERE vector IS NOT NULL""")
def profile_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "profiledb").where("vector is not null").select(F.col("vec_id").alias("class_ord"), F.col("name").alias("class"), "vector")
    return as_lines(rows).withColumnRenamed("class_ord", "vec_id")


def _proteins(spark, sf_dir):
    """First-frame proteins of the used reads, as a profile set."""
    rows = table(spark, sf_dir, "reads").where("seq is not null and flag = 2")
    return rows.select(F.col("read_id").alias("profile_id"), F.col("name").alias("profile"), translate_dna(upcase(F.col("seq")), 1).alias("pseq"))


def _aligned_sql(simple: bool, border: int) -> str:
    """Tables of the pairs ``q(id, a, b)``, filled by anti-diagonals of ``{h, x, y}`` cells, as ``done(id, best, final)``.

    ``x`` and ``y`` tell whether a cell ends in a gap (``simple``), or what it scores if it does.
    """
    v = "(h2[i] + m[a[i] * 24 + b[e - i] + 1])"
    if simple:
        x, y, edge = "c1[i].h - CASE c1[i].x WHEN 1 THEN 1 ELSE 11 END", "c1[i + 1].h - CASE c1[i + 1].y WHEN 1 THEN 1 ELSE 11 END", "1"
        cell = f"{{'h': greatest({v}, {x}, {y}), 'x': CASE WHEN ({v} <= {x} OR {v} <= {y}) AND {x} >= {y} THEN 1 ELSE 0 END, 'y': CASE WHEN ({v} <= {x} OR {v} <= {y}) AND {x} < {y} THEN 1 ELSE 0 END}}"
    else:
        x, y, edge = "CASE WHEN i = 1 THEN -1000000 ELSE greatest(c1[i].x - 1, c1[i].h - 11) END", "CASE WHEN e - i = 1 THEN -1000000 ELSE greatest(c1[i + 1].y - 1, c1[i + 1].h - 11) END", "-1000000"
        cell = f"{{'h': greatest({v}, {x}, {y}), 'x': {x}, 'y': {y}}}"
    border_cell = f"{{'h': -e * {border}, 'x': {edge}, 'y': {edge}}}"
    row = f"list_transform(range(0, n + 1), lambda i: CASE WHEN i > e OR e - i > k THEN NULL WHEN i = 0 OR i = e THEN {border_cell} ELSE {cell} END)"
    start = f"{{'h': -{border}, 'x': {edge}, 'y': {edge}}}"
    cells = "STRUCT(h BIGINT, x BIGINT, y BIGINT)[]"
    return f"""codes AS (SELECT id, list_transform(regexp_extract_all(a, '.'), lambda c: instr('{LETTERS}', c) - 1) AS a, list_transform(regexp_extract_all(b, '.'), lambda c: instr('{LETTERS}', c) - 1) AS b FROM q),
mat AS (SELECT CAST([{", ".join(str(x) for x in SCORES.ravel().tolist())}] AS BIGINT[]) AS m),
dp AS (SELECT id, a, b, len(a) AS n, len(b) AS k, CAST(1 AS BIGINT) AS d, CAST([0] AS BIGINT[]) AS h2, CAST([{start}, {start}] AS {cells}) AS c1, CAST(0 AS BIGINT) AS best FROM codes WHERE len(a) > 0 AND len(b) > 0
  UNION ALL SELECT id, a, b, n, k, e, CAST(list_transform(c1, lambda c: c.h) AS BIGINT[]), c2, CAST(greatest(best, list_max(list_transform(c2, lambda c: c.h))) AS BIGINT)
  FROM (SELECT id, a, b, n, k, e, c1, best, CAST({row} AS {cells}) AS c2 FROM (SELECT *, d + 1 AS e FROM dp WHERE d < n + k), mat)),
done AS (SELECT id, best, c1[n + 1].h AS final FROM dp WHERE d = n + k)"""


_CANDIDATES = READS + f""", t AS ({" UNION ALL ".join(_frame_sql(f) for f in range(1, 7))}),
p AS (SELECT t.read_id AS profile_id, r.name AS profile, aa AS pseq FROM t JOIN r USING (read_id) WHERE frame = 1 AND flag = 2),
x AS (SELECT profile_id, profile, CAST(i AS INT) AS p_pos, substr(pseq, CAST(i + 1 AS INT), 8) AS kmer, substr(pseq, CAST(i + 1 AS INT)) AS suffix FROM p, unnest(range(0, greatest(length(pseq) - 7, 0))) AS u(i)),
y AS (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY profile_id DESC, p_pos DESC) AS k FROM x),
s AS (SELECT read_id, frame, aa, CAST(i AS INT) AS pos, substr(aa, CAST(i + 1 AS INT), 8) AS kmer FROM t, unnest(range(0, greatest(length(aa) - 8, 0))) AS u(i)),
h AS (SELECT *, row_number() OVER (PARTITION BY read_id, frame ORDER BY pos) AS n FROM s JOIN y USING (kmer) WHERE k = 1), h1 AS (SELECT * FROM h WHERE n = 1)"""


@query(_CANDIDATES + " SELECT read_id, frame, pos, kmer, profile_id, CAST(length(suffix) AS INT) AS suffix_len FROM h1")
def search_candidates(spark, sf_dir):
    return search.candidates(reads(spark, sf_dir), _proteins(spark, sf_dir), 8).select("read_id", "frame", "pos", "kmer", "profile_id", F.length("suffix").alias("suffix_len"))


_BITS = "(0.267 * {} - ln(0.041)) / ln(2)"
_HITS = _CANDIDATES.replace("WITH", "WITH RECURSIVE", 1) + ", q AS (SELECT read_id * 8 + frame AS id, aa AS a, suffix AS b FROM h1), " + _aligned_sql(True, 0) + f""",
z AS (SELECT h1.*, r.name, r.seq, {_BITS.format('best')} AS bits FROM h1 JOIN done ON id = read_id * 8 + frame JOIN r USING (read_id) WHERE {_BITS.format('best')} > 50)"""


def _hits(spark, sf_dir):
    return search.hits(reads(spark, sf_dir), _proteins(spark, sf_dir), 8, 50.0)


@query(_HITS + " SELECT read_id, frame, profile_id, kmer, round(bits, 2) AS bits FROM z")
def search_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select("read_id", "frame", "profile_id", "kmer", F.round("bits", 2).alias("bits"))


@query(_HITS + " SELECT name || chr(9) || coalesce(profile, 'null') || chr(9) || printf('%.2f', bits) || chr(9) || frame || chr(9) || kmer AS value FROM z WHERE name IS NOT NULL")
def search_matches(spark, sf_dir):
    return search.outputs(_hits(spark, sf_dir).where("name is not null"))["matches"]


@query(_HITS + " SELECT '>' || name || ' | frame ' || frame || ' | kmer ' || kmer || ' | score ' || printf('%.2f', bits) || chr(10) || aa AS value FROM z WHERE name IS NOT NULL")
def search_proteins(spark, sf_dir):
    return search.outputs(_hits(spark, sf_dir).where("name is not null"))["candidates"]


@query(_HITS + " SELECT '>' || name || chr(10) || seq AS value FROM z WHERE name IS NOT NULL")
def search_focus(spark, sf_dir):
    return search.outputs(_hits(spark, sf_dir).where("name is not null"))["focus"]


def _pairs_sql(kind: str) -> str:
    score = "final" if kind == "global" else "best"
    bits = _BITS.format(score)
    return f"""{READS.replace("WITH", "WITH RECURSIVE", 1)}, t AS ({_frame_sql(1)}), q AS (SELECT u.read_id AS id, u.aa AS a, v.aa AS b FROM t u JOIN t v ON v.read_id = u.read_id + 1 WHERE u.aa <> '' AND v.aa <> ''),
{_aligned_sql(kind == "simple", 1 if kind == "global" else 0)}
SELECT id AS read_id, round({bits}, 4) AS bits, round(log10(length(a) * length(b)) - ({bits}) * log10(2), 4) AS log_e FROM done JOIN q USING (id)"""


def _pairs(kind: str):
    def f(spark, sf_dir):
        """Proteins of neighbouring reads aligned, with the logarithm of the E-value."""
        rows = reads(spark, sf_dir).select("read_id", translate_dna(F.col("seq"), 1).alias("a")).where("a <> ''")
        pairs = rows.join(rows.select((F.col("read_id") - 1).alias("read_id"), F.col("a").alias("b")), "read_id")
        scored = pairs.withColumn("bits", alignment_bits(kind)("a", "b"))
        return scored.select("read_id", F.round("bits", 4).alias("bits"), F.round(F.log10(e_value(F.col("bits"), F.length("a"), F.length("b"))), 4).alias("log_e"))

    f.__name__ = f"align_{kind}"
    return f


for _kind in ("local", "global", "simple"):
    query(_pairs_sql(_kind))(_pairs(_kind))
