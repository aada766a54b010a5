"""K-mer composition profiles: frequencies, weights, training and classification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import PROFILE_ORDER
from ..session import numbered
from .kmers import profile_codes

#: Weight of words that a class never shows, and the count that stands for an absent one in smoothed weights.
ABSENT, SMOOTH = -20.0, 0.1
#: Weights that are sent to the tasks at a time; 64 MB or so.
ENTRIES = 8_000_000


def frequencies(df: DataFrame, by: list[str], k: int, n_policy: str = "as_a") -> DataFrame:
    """``(<by>, level, code, cnt)``: both-strand counts of the j-letter beginnings of all k-mers, for j = k to 0.

    The k-mers are counted once; the shorter levels add up those counts (a rollup over the digits of the code).
    Sequences shorter than ``k`` count nothing.
    """
    full = profile_codes(df.select(*by, "seq"), k, n_policy).groupBy(*by, "code").agg(F.count(F.lit(1)).alias("cnt"))
    levels = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: F.struct(j.alias("level"), F.call_function("shiftright", F.col("code"), (F.lit(k) - j) * 2).alias("code")))
    return full.select(*by, "cnt", F.inline(levels)).groupBy(*by, "level", "code").agg(F.sum("cnt").alias("cnt"))


def weights(freq: DataFrame, by: list[str], k: int) -> DataFrame:
    """``(<by>, code, w)`` of the words that occur: ``11 ln(c/c1) + ln(c1/c2)``, c1 and c2 being the counts of their
    beginnings shorter by one and two (V22). All other words weigh ABSENT; see ``densify``."""
    if k < 3:
        raise ValueError("k must be 3 at least")
    level = lambda j, name: freq.where(F.col("level") == j).select(*by, F.col("code").alias(f"code{j}"), F.col("cnt").alias(name))
    words = level(k, "c").withColumnRenamed(f"code{k}", "code").withColumn(f"code{k - 1}", F.shiftright("code", 2)).withColumn(f"code{k - 2}", F.shiftright("code", 4))
    joined = words.join(level(k - 1, "c1"), [*by, f"code{k - 1}"]).join(level(k - 2, "c2"), [*by, f"code{k - 2}"])
    return joined.select(*by, "code", (11.0 * F.log(F.col("c") / F.col("c1")) + F.log(F.col("c1") / F.col("c2"))).alias("w"))


def smoothed_weights(freq: DataFrame, by: list[str], k: int) -> DataFrame:
    """``(<by>, code, w)`` of all 4^k words: the sum over j of ``log2((f/f1)/(g/g1))``, g and g1 being counts of the word's
    last j+1 and the j letters before its last; absent f or g count SMOOTH, terms without f1 or g1 nothing (V23)."""
    if k < 3:
        raise ValueError("k must be 3 at least")
    spark = freq.sparkSession
    level = freq.select(*by, "level", F.col("code").alias("lcode"), "cnt")
    words = freq.select(*by).distinct().join(F.broadcast(spark.range(4**k).withColumnRenamed("id", "code")))
    at = lambda df, j, code, name: df.join(level.where(F.col("level") == j).select(*by, F.col("lcode").alias("at"), F.col("cnt").alias(name)).withColumnRenamed("at", code), [*by, code], "left")
    base = at(words, k, "code", "f").withColumn("c1", F.shiftright("code", 2))
    base = at(base, k - 1, "c1", "f1").select(*by, "code", "f", "f1")
    terms = None
    for j in range(1, k - 1):
        part = base.withColumn("g_code", F.col("code").bitwiseAND((1 << (2 * j + 2)) - 1)).withColumn("g1_code", F.shiftright("g_code", 2))
        part = at(at(part, j + 1, "g_code", "g"), j, "g1_code", "g1")
        ratio = F.log((F.coalesce("f", F.lit(SMOOTH)) / F.col("f1")) / (F.coalesce("g", F.lit(SMOOTH)) / F.col("g1"))) / math.log(2.0)
        part = part.select(*by, "code", F.when((F.col("f1") > 0) & (F.col("g1") > 0), ratio).otherwise(0.0).alias("t"))
        terms = part if terms is None else terms.unionByName(part)
    return terms.groupBy(*by, "code").agg(F.sum("t").alias("w"))


def densify(sparse: DataFrame, by: list[str], k: int, absent: float = ABSENT) -> DataFrame:
    """All 4^k words of each class, those without a row at weight ``absent``. The word list has a fixed size."""
    words = F.broadcast(sparse.sparkSession.range(4**k).withColumnRenamed("id", "code"))
    return sparse.select(*by).distinct().join(words).join(sparse, [*by, "code"], "left").select(*by, "code", F.coalesce("w", F.lit(absent)).alias("w"))


def train(sequences: DataFrame, k: int = 7, mode: str = "default", adjacent: bool = False) -> DataFrame:
    """``(class_ord, class, code, w)`` from ``(ord, class, seq)`` (H6, C11).

    Rows of a class are put together wherever they stand; with ``adjacent`` only neighbours in ``ord`` are, so that a
    class that returns later becomes another one. ``class_ord`` follows the first row. k outside 3 to 10 becomes 7.
    """
    k = k if 3 <= k <= 10 else 7
    rows = sequences
    if adjacent:
        listed = numbered(rows.select("ord", "class").distinct(), "ord")
        before = listed.select((F.col("i") + 1).alias("i"), F.col("class").alias("class_before"))
        starts = listed.join(before, "i", "left").where(~F.col("class").eqNullSafe(F.col("class_before"))).select("i", "ord")
        within = Window.partitionBy("class").orderBy("ord")  # the files of one class
        runs = listed.join(starts.select("ord", F.col("i").alias("start")), "ord", "left").withColumn("run", F.max("start").over(within)).select("ord", "run")
        rows = rows.join(runs, "ord")
    else:
        rows = rows.withColumn("run", F.lit(0))
    firsts = rows.groupBy("class", "run").agg(F.min("ord").alias("class_ord"))
    freq = frequencies(rows.join(firsts, ["class", "run"]).select("class_ord", "class", "seq"), ["class_ord", "class"], k)
    by = ["class_ord", "class"]
    return smoothed_weights(freq, by, k) if mode == "smoothed" else densify(weights(freq, by, k), by, k)


def _window_codes(seqs: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, code)`` of the k-mers of both strands in profile order, rows ascending; N counts as A on either strand."""
    text = np.frombuffer("".join(seqs).encode("latin_1", "replace"), np.uint8)
    size = np.array([len(s) for s in seqs], np.int64)
    many = np.maximum(size - k + 1, 0)
    row = np.repeat(np.arange(len(seqs)), many)
    begin = np.repeat(size.cumsum() - size, many) + np.arange(len(row)) - np.repeat(many.cumsum() - many, many)
    forward, back = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    for j in range(k):
        letter = text[begin + j]
        forward = forward * 4 + _digit[letter]
        back += _other_digit[letter].astype(np.int64) << (2 * j)
    return np.repeat(row, 2), np.stack([forward, back], axis=1).ravel()


_digit, _other_digit = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_digit[[ord(c) for c in PROFILE_ORDER]] = range(4)
_other_digit[[ord(c) for c in PROFILE_ORDER.translate(str.maketrans("ACGT", "TGCA"))]] = range(4)

SCORED = "read_id bigint, best double, class_ord bigint, second double, before double"


def _score(weights, ords, k: int):
    """Best class of each read among those of one block, the best of its others, and of those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, order = weights.value, np.asarray(ords)
        step = max(1, ENTRIES // len(order))
        for batch in batches:
            ids, seqs = batch.column(0), batch.column(1).to_pylist()
            scores = np.zeros((len(seqs), len(order)))
            row, code = _window_codes(seqs, k)
            for at in range(0, len(row), step):
                part = row[at : at + step]
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                scores[part[first]] += np.add.reduceat(table[code[at : at + step]], first)
            scores = np.round(scores, 6)
            best = scores.argmax(axis=1)  # the first of equal classes
            every, column = np.arange(len(seqs)), np.arange(len(order))
            top = scores[every, best]
            second = np.where(column == best[:, None], -np.inf, scores).max(axis=1, initial=-np.inf)
            before = np.where(column < best[:, None], scores, -np.inf).max(axis=1, initial=-np.inf)
            yield pa.record_batch([ids, pa.array(top), pa.array(order[best]), pa.array(second), pa.array(before)], ["read_id", "best", "class_ord", "second", "before"])

    return run


def classify(reads: DataFrame, profiles: DataFrame, k: int, entries: int = ENTRIES) -> DataFrame:
    """``(read_id, name, class_ord, class, score, margin, margin_seq)``: the best class of each read.

    The score of a class is the sum of counts times weights over the read's both-strand words, rounded to six digits; words that
    ``profiles`` lacks weigh nothing. The first of equal classes wins. ``margin`` is the distance to the true runner-up (null with one class),
    ``margin_seq`` to the best of the classes before the winner (1e10 below, if it is the first). Reads shorter than ``k`` score 0
    for every class. Null sequences and ids are left out, of rows with one id one is taken. Without classes there are no rows.

    ``profiles`` has ``(class_ord, class, code, w)``. Weights are sent to the tasks as tables of ``entries`` numbers at most; more classes
    than that holds are scored in blocks over the same reads, whose winners meet by read. Reads are never multiplied by classes or words.
    """
    spark = reads.sparkSession
    named = reads.where(F.col("read_id").isNotNull() & F.col("seq").isNotNull()).select("read_id", "name", "seq").dropDuplicates(["read_id"])
    classes = profiles.groupBy(F.col("class_ord").cast("bigint").alias("class_ord")).agg(F.min("class").alias("class"))
    ords = sorted(r[0] for r in classes.select("class_ord").collect())
    size, found = max(1, entries // 4**k), None
    for at in range(0, len(ords), size):
        block = ords[at : at + size]
        rows = profiles.where(F.col("class_ord").between(block[0], block[-1])).select("class_ord", "code", F.col("w").cast("double").alias("w")).toArrow()  # ``entries`` rows at most
        table = np.zeros((4**k, len(block)))
        table[rows["code"].to_numpy(), np.searchsorted(block, rows["class_ord"].to_numpy())] = rows["w"].to_numpy()
        part = named.select("read_id", "seq").mapInArrow(_score(spark.sparkContext.broadcast(table), block, k), SCORED)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "read_id bigint, name string, class_ord bigint, class string, score double, margin double, margin_seq double")
    if len(ords) > size:  # one row for each block
        best = F.max(F.struct("best", (-F.col("class_ord")).alias("neg"), "second", "before")).alias("b")
        met = found.groupBy("read_id").agg(best, F.collect_list(F.struct("best", "class_ord")).alias("all"))
        others = F.filter("all", lambda x: x["class_ord"] != -F.col("b.neg"))
        earlier = F.filter(others, lambda x: x["class_ord"] < -F.col("b.neg"))
        most = lambda xs: F.coalesce(F.array_max(F.transform(xs, lambda x: x["best"])), F.lit(float("-inf")))
        found = met.select("read_id", "b.best", (-F.col("b.neg")).alias("class_ord"), F.greatest("b.second", most(others)).alias("second"), F.greatest("b.before", most(earlier)).alias("before"))
    finite = lambda c: F.when(F.col(c) > float("-inf"), F.col(c))
    joined = named.select("read_id", "name").join(found, "read_id").join(classes, "class_ord")
    return joined.select(
        "read_id", "name", "class_ord", "class", F.col("best").alias("score"),
        (F.col("best") - finite("second")).alias("margin"), (F.col("best") - F.coalesce(finite("before"), F.lit(-1e10))).alias("margin_seq"),
    )


__all__ = ["classify", "densify", "frequencies", "smoothed_weights", "train", "weights"]
