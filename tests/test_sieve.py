import random

import numpy as np
from pyspark.sql import functions as F

from kmerloom.operators import assembly, ends, overlap, sieve

K = 12


def reads_of(rng, n, size=80):
    return ["".join(rng.choice("ACGT") for _ in range(size)) for _ in range(n)]


def rows_of(spark, seqs):
    return spark.createDataFrame([(i, 1, s) for i, s in enumerate(seqs)], "node bigint, occr bigint, seq string")


def test_kmer_hashes_know_equal_words():
    seqs = ["ACGTACGTACGTTT", "", "TTACGTACGTACG", "ACG"]
    row, pos, x = ends.kmer_hashes(seqs, K)
    words = [seqs[r][p : p + K] for r, p in zip(row, pos)]
    assert len(words) == 3 + 2 and all(len(w) == K for w in words)
    assert [[a == b for b in words] for a in words] == [[a == b for b in x] for a in x]


def test_sieve_keeps_all_keys_and_few_others(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 63), 1 << 63, 20_000)
    (own,) = sieve.sieves(spark.createDataFrame([(0, int(v)) for v in x], "kind int, x bigint"))
    assert sieve.passes(own.value, x.view(np.uint64)).all()
    assert sieve.passes(own.value, rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2)).mean() < 0.02


def test_ends_that_meet_nothing_stay_in_their_task(spark):
    seqs = reads_of(random.Random(1), 60)
    seqs += [seqs[0][-30:] + "ACGTTGCA" * 4, seqs[1][-12:] + seqs[2][:20]]
    rows = rows_of(spark, seqs)
    firsts, lasts = ends.end_sieves(rows, K)
    keys = ["n", "h", "g"]
    all_met = ends.tails(rows, K).join(ends.beginnings(rows, K).withColumnRenamed("node", "next"), keys).select("node", "next", "n")
    tails, beginnings = ends.tails(rows, K, firsts), ends.beginnings(rows, K, lasts)
    met = tails.join(beginnings.withColumnRenamed("node", "next"), keys).select("node", "next", "n")
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, all_met.collect())) and met.count() >= 2
    assert tails.count() + beginnings.count() < 0.02 * (ends.tails(rows, K).count() + ends.beginnings(rows, K).count()) + 10


def test_best_successor_shuffles_only_what_can_meet(spark, monkeypatch):
    made = []
    whole = ends._made
    monkeypatch.setattr(ends, "_made", lambda *a: made.append(whole(*a)) or made[-1])
    seqs = reads_of(random.Random(2), 40)
    seqs.append(seqs[7][-40:] + "GATTACA")
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id bigint, seq string")
    assert [tuple(r) for r in overlap.best_successor(rows, K).collect()] == [(7, 40, 40)]
    assert sum(x.agg(F.count(F.lit(1))).first()[0] for x in made) < 60


def test_matches_shuffle_only_words_that_can_meet(spark, monkeypatch):
    rng, made = random.Random(4), []
    whole = overlap.word_keys
    monkeypatch.setattr(overlap, "word_keys", lambda *a: made.append(whole(*a)) or made[-1])
    seqs = reads_of(rng, 30) + ["A" * 40, "C" * 5 + "A" * 30, "ACGTN" * 10, "ACG", ""]
    seqs += [seqs[3][-30:] + "GATTACA", seqs[5][20:50], seqs[6][:-1].translate(str.maketrans("ACGT", "TGCA"))[::-1], seqs[8][30:48] + "ACGTACGTAC"]
    rows = spark.createDataFrame([*enumerate(seqs), (99, None)], "read_id bigint, seq string")
    turned = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]

    def expected(limit, most, fits):
        return sorted(
            (q, r, strand, i) for q, a in enumerate(seqs) for r, b in enumerate(seqs) if q != r and "N" not in b and len(b) >= K for strand, o in (("+", b), ("-", turned(b)))
            for i in range(len(a)) if limit(len(a), i) and a[i : i + K] == o[:K] and fits(a[i:], o, most)
        )

    near = lambda a, o, most: sum(x != y for x, y in zip(a, o)) <= most * min(len(a), len(o))
    ids = lambda df: sorted(tuple(r)[:4] for r in df.collect())
    inside = lambda n, i: i <= n - K
    exact = ids(overlap.overlaps(rows, rows, K, K))
    assert exact == expected(inside, 0, near) and len(exact) > 20
    assert made[0].count() < 0.15 * sum(max(len(s) - K + 1, 0) for s in seqs)
    assert ids(overlap.overlaps(rows, rows, K, K, 0.3)) == expected(inside, 0.3, near)
    assert ids(overlap.prefix_overlaps(rows, rows, K, 15)) == expected(lambda n, i: i < n - 15, 0, lambda a, o, _: a[:15] == o[:15])


def test_choices_shuffle_only_what_can_meet(spark, monkeypatch):
    made = []
    whole = ends._made
    monkeypatch.setattr(ends, "_made", lambda *a: made.append(whole(*a)) or made[-1])
    seqs = reads_of(random.Random(5), 40)
    seqs.append(seqs[7][-40:] + "GATTACA")
    once = spark.createDataFrame([(i, 1, s) for i, s in enumerate(seqs)], "id bigint, occr bigint, seq string")
    found = sorted(tuple(r) for r in assembly.choices(assembly.strands(once), K, True).collect())
    assert found == [(14, 80, 40, 1), (81, 15, 40, 1)]
    assert sum(x.agg(F.count(F.lit(1))).first()[0] for x in made) < 120
