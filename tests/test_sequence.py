"""Scalar functions against hand-made values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import align
from kmerloom.functions import sequence as S

LONG_A = "MSVMYKKILYPTDFSETAEIALKHVKAFKTLKAEEVILLHVIDEREIKKRDIFSLLLGVAGLNKSVEEFENELKNKLTEEAKNKMENIKKELEDVGFKVKDIIVVGIPHEEIVKIAEDEGVDIIIMGSHGKTNLKEILLGSVTENVIKKSNKPVLVVKRKNS"
LONG_B = "MYRKILLATDGSECSMQAAGYAIETAAQNRAELLALTVTETYPLDNLPVEELTRKVTELFRKESEEALQKVEDLAVSLDTPVKVRKMMVDGSPAETILKVADEENVDLIVVGASGKHALERFLLGSVSEKIVRHARVPVLVVHSK"


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("make", "expected"),
    [
        (lambda: S.upcase(F.lit("acgtXn-ß")), "ACGTNNNN"), (lambda: S.revcomp(F.lit("ACGGTT")), "AACCGT"), (lambda: S.partial_revcomp(F.lit("ACGGTT"), 2), "CCGT"),
        (lambda: S.revcomp_prefix(F.lit("ACGGTT"), 2), "GT"), (lambda: S.gc_content(F.lit("GGCCAATT")), 50.0), (lambda: S.gc_content(F.lit("GCNN")), 50.0), (lambda: S.gc_content(F.lit("")), None),
        (lambda: S.hamming(F.lit("ACGT"), F.lit("ACCTTT")), 0.25), (lambda: S.first_mismatch(F.lit("ACGT"), F.lit("ACCTTT")), 2), (lambda: S.first_mismatch(F.lit("AC"), F.lit("ACC")), -1),
        (lambda: S.is_protein(F.lit("ACGTN")), False), (lambda: S.is_protein(F.lit("MKV")), True), (lambda: S.translate_dna(F.lit("ATGAAATAG"), 1), "MK*"),
        (lambda: S.translate_dna(F.lit("ATGNAATAG"), 1), "M"), (lambda: S.translate_dna(F.lit(""), 1), ""), (lambda: S.translate_dna(F.lit("CTATTTCAT"), 4), "MK*"),
        (lambda: S.read_of(F.lit(-1)), 0), (lambda: S.ceil_div(F.lit(0), 5), 0), (lambda: S.ceil_div(F.lit(1), 5), 1), (lambda: S.ceil_div(F.lit(10), 5), 2),
        (lambda: S.pack(F.lit("ACGT")), 27), (lambda: S.pack(F.lit("AGCT"), S.PROFILE_ORDER), 27), (lambda: S.seconds_text(F.lit(181.0)), "3.02 m"), (lambda: S.is_power_of_two(F.lit(8)), True),
        (lambda: S.base_index(F.lit("G")), 2), (lambda: S.revcomp(F.lit(None).cast("string")), None), (lambda: S.translate_dna(F.lit(None).cast("string"), 2), None),
    ],
)
def test_scalars(spark, make, expected):
    assert value(spark, make()) == expected


def test_translation_is_linear_and_complete(spark):
    seq = "ACGTTGCA" * 5000
    assert len(value(spark, S.translate_dna(F.lit(seq), 2))) == (len(seq) - 1) // 3


def test_scores():
    assert math.isclose(align.bits(100), 43.12818987, abs_tol=1e-6)
    first, second = ["FRKVLFPTDFSEGAY", LONG_A, "", ""], ["FRKILIPPDFSQALH", LONG_B, "A", ""]
    got = {kind: align.raw_scores(first, second, kind).tolist() for kind in ("local", "global", "simple")}
    assert got == {"local": [48, 200, 0, 0], "global": [48, 185, -1, 0], "simple": [48, 195, 0, 0]}
    assert align.raw_scores([LONG_A], [LONG_B], "classical")[0] >= 200
    assert align.raw_scores(["MK", LONG_A], ["MK", LONG_B], "simple", 50).tolist()[1] == 195 and math.isnan(align.raw_scores(["MK"], ["MK"], "simple", 50)[0])


def plain_affine(a, b, border, floor):
    """Every gap of every length from every inner cell."""
    h = {(i, 0): -border * i for i in range(len(a) + 1)} | {(0, j): -border * j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            gaps = [h[i - g, j] - 10 - g for g in range(1, i)] + [h[i, j - g] - 10 - g for g in range(1, j)]
            h[i, j] = max([h[i - 1, j - 1] + int(align.SCORES[align.LETTERS.index(a[i - 1]), align.LETTERS.index(b[j - 1])]), *gaps, *([0] if floor else [])])
    return h


def test_batches_equal_single_tables(monkeypatch):
    monkeypatch.setattr(align, "CELLS", 200)
    rng = random.Random(1)
    first = ["".join(rng.choice(align.LETTERS) for _ in range(rng.randrange(1, 20))) for _ in range(60)]
    second = [x[2:12] + "".join(rng.choice(align.LETTERS) for _ in range(rng.randrange(1, 9))) for x in first]
    tables = [(plain_affine(a, b, 0, False), plain_affine(a, b, 1, False), plain_affine(a, b, 0, True)) for a, b in zip(first, second)]
    assert align.raw_scores(first, second, "local").tolist() == [max(0, *t[0].values()) for t in tables]
    assert align.raw_scores(first, second, "global").tolist() == [t[1][len(a), len(b)] for t, a, b in zip(tables, first, second)]
    assert align.raw_scores(first, second, "classical").tolist() == [max(t[2].values()) for t in tables]


def test_matrix_is_symmetric():
    at = align.LETTERS.index
    m = align.SCORES
    assert m.shape == (24, 24) and (m == m.T).all() and m[at("W"), at("W")] == 11 and m[at("B"), at("K")] == 0 and m[at("*"), at("*")] == 1
    assert align.raw_scores(["J"], ["a"], "global")[0] == m[at("X"), at("A")]


def test_score_of_nulls(spark):
    df = spark.createDataFrame([("MKV", "MKV"), (None, "M"), ("", "M")], "a string, b string")
    got = [r[0] for r in df.select(align.alignment_bits("simple")("a", "b")).collect()]
    assert got[1] is None and got[0] > got[2]
    assert [r[0] for r in df.select(align.alignment_bits("simple", 50.0)("a", "b")).collect()][:2] == [None, None]
