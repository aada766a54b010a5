"""Row generators against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import kmers, overlap, profiles

TURN = str.maketrans("ACGT", "TGCA")
SCHEMA = "read_id bigint, name string, seq string"


def turned(s):
    return s.translate(TURN)[::-1]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    rows = [(i, f"r{i}", genome[p : p + 60]) for i, p in enumerate(rng.randrange(340) for _ in range(40))]
    return [*rows, (100, None, "ACGTN" * 10), (101, "short", "ACG"), (102, "empty", ""), (103, "again", rows[0][2])]


@pytest.fixture(scope="module")
def reads(spark, texts):
    return spark.createDataFrame([*texts, (104, "null", None)], SCHEMA).where("seq is not null").cache()


def test_kmers_and_counts(reads, texts, rows):
    expected = [(i, st, p, o[p : p + 9]) for i, _, s in texts if "N" not in s for st, o in (("+", s), ("-", turned(s))) for p in range(len(o) - 8)]
    assert rows(kmers.kmers(reads, 9)) == sorted(expected, key=repr)
    assert rows(kmers.kmer_counts(reads, 9)) == sorted(Counter(w for *_, w in expected).items(), key=repr)
    ends = [(i, st, o[:9]) for i, _, s in texts if "N" not in s and len(s) >= 9 for st, o in (("+", s), ("-", turned(s)))]
    assert rows(kmers.end_kmers(reads, 9).select("read_id", "strand", "kmer")) == sorted(ends, key=repr)


@pytest.mark.parametrize(("length", "starts"), [(75, [0]), (100, [0, 25]), (150, [0, 38, 75]), (200, [0, 42, 84, 125]), (251, [0, 44, 88, 132, 176]), (74, [])])
def test_split(spark, length, starts):
    df = spark.createDataFrame([(1, "x", "ACGTA" * 60)], SCHEMA).withColumn("seq", F.substring("seq", 1, length))
    got = kmers.split_reads(df).orderBy("part").collect()
    assert [r.beg for r in got] == starts and all(len(r.seq) == 75 for r in got)
    assert [r.name for r in got] == (["x"] if len(starts) == 1 else [f"x_{j}/{len(starts)}" for j in range(len(starts))])


def test_overlaps(reads, texts, rows):
    index = [(i, st, o) for i, _, s in texts if "N" not in s and len(s) >= 12 for st, o in (("+", s), ("-", turned(s)))]
    exact = [(q, i, st, p) for q, _, s in texts for p in range(len(s) - 11) for i, st, o in index if q != i and s[p : p + 12] == o[:12] and s[p:][: len(o)] == o[: len(s) - p]]
    assert rows(overlap.overlaps(reads, reads, 12, 12).select("query_id", "read_id", "strand", "offset")) == sorted(exact, key=repr)
    prefix = [(q, i, st, p) for q, _, s in texts for p in range(len(s) - 20) for i, st, o in index if q != i and s[p : p + 20] == o[:20]]
    assert rows(overlap.prefix_overlaps(reads, reads, 12, 20).select("query_id", "read_id", "strand", "offset")) == sorted(prefix, key=repr)


def test_lookup_of_absent(spark, reads):
    words = spark.createDataFrame([("ATTGCAACCGACCCG",), ("TGCAACCGACCCGCT",), ("TGGTTTTCTTTCGGG",)], "kmer string")
    two = spark.createDataFrame([(1, "a", "ATTGCAACCGACCCGCTCG"), (2, "b", "TGCAACCGACCCGCTCGCA")], SCHEMA)
    assert {r.kmer: r.n for r in overlap.point_lookup(two, words, 15).collect()} == {"ATTGCAACCGACCCG": 1, "TGCAACCGACCCGCT": 1, "TGGTTTTCTTTCGGG": 0}


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert rows(kmers.kmer_counts(none, 9)) == rows(kmers.split_reads(none)) == rows(overlap.overlaps(none, none, 9, 9)) == rows(overlap.best_successor(none, 9)) == []


def test_weights_by_hand(spark):
    freq = spark.createDataFrame([("c", 3, 27, 2), ("c", 2, 6, 5), ("c", 1, 1, 9)], "class string, level int, code bigint, cnt bigint")
    got = profiles.weights(freq, ["class"], 3).collect()
    assert [(r.code, round(r.w, 5)) for r in got] == [(27, -10.66698)]
    assert {r.w for r in profiles.densify(profiles.weights(freq, ["class"], 3), ["class"], 3).collect()} == {got[0].w, -20.0}


def test_frequencies_and_classes(spark, reads, texts):
    levels = profiles.frequencies(reads, [], 3)
    n = sum(2 * max(0, len(s) - 2) for _, _, s in texts)
    assert {r.level: r.n for r in levels.groupBy("level").agg(F.sum("cnt").alias("n")).collect()} == dict.fromkeys(range(4), n)
    assert profiles.frequencies(reads, [], 3, "skip").where("level = 0").first().cnt < n
    sequences = spark.createDataFrame([(0, "a", "AAAAAAAA"), (1, "b", "GCGCGCGC"), (2, "a", "AAAATAAA")], "ord int, class string, seq string")
    db = profiles.train(sequences, 3)
    assert db.select("class_ord", "class").distinct().count() == 2 and db.count() == 128
    assert profiles.train(sequences, 3, adjacent=True).select("class_ord").distinct().count() == 3
    asked = spark.createDataFrame([(1, "x", "AAAAA"), (2, None, "GCGCG"), (3, "y", "A"), (4, "z", "")], SCHEMA)
    got = {r.read_id: r for r in profiles.classify(asked, db, 3).collect()}
    assert [got[i]["class"] for i in (1, 2, 3, 4)] == ["a", "b", "a", "a"] and got[3].score == 0 and got[1].margin > 0


def plain_scores(seq, weights, k):
    """Score of each class over both strands, N counting as A."""
    strands = [seq.replace("N", "A"), turned(seq).replace("N", "A")]
    codes = [sum("AGCT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(s[p : p + k])) for s in strands for p in range(len(s) - k + 1)]
    return {c: round(sum(w.get(x, 0.0) for x in codes), 6) for c, w in weights.items()}


@pytest.mark.parametrize(("classes", "entries"), [(7, 1 << 20), (7, 128), (7, 1), (5000, 64_000)])
def test_classes_in_blocks(spark, texts, classes, entries):
    rng = random.Random(classes)
    weights = {c * 3: {x: round(rng.uniform(-3, 3), 3) for x in rng.sample(range(64), 3)} for c in range(classes)}
    weights[6] = dict(weights[3])  # equal classes: the first wins
    db = spark.createDataFrame([(c, f"c{c}", x, w) for c, ws in weights.items() for x, w in ws.items()], "class_ord int, class string, code bigint, w double")
    asked = [(i, n, s) for i, n, s in texts if s is not None][:20] + [(997, "short", "AC"), (998, None, ""), (999, "null", None)]
    got = {r.read_id: r for r in profiles.classify(spark.createDataFrame(asked, SCHEMA), db, 3, entries).collect()}
    assert len(got) == len(asked) - 1
    for i, _, s in asked[:-1]:
        scores = plain_scores(s, weights, 3)
        best = min(scores, key=lambda c: (-scores[c], c))
        others = [v for c, v in scores.items() if c != best]
        earlier = max((v for c, v in scores.items() if c < best), default=-1e10)
        want = (best, scores[best], scores[best] - max(others), scores[best] - earlier)
        assert (got[i].class_ord, got[i].score, got[i].margin, got[i].margin_seq) == pytest.approx(want, abs=2e-6)
    assert profiles.classify(spark.createDataFrame(asked, SCHEMA), db.limit(0), 3).count() == 0


def test_a_kmer_in_a_third_of_the_reads(spark, rows):
    rng = random.Random(5)
    random_letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    hub = random_letters(20)
    texts = [(i, "r", random_letters(15) + hub + random_letters(5) if i % 3 == 0 else hub + random_letters(20) if i % 97 == 1 else random_letters(40)) for i in range(4000)]
    df = spark.createDataFrame(texts, SCHEMA)
    index = [(i, o) for i, _, s in texts for o in (s, turned(s)) if o.startswith(hub)]
    want = sorted({(q, i, s.find(hub)) for q, _, s in texts if hub in s for i, o in index if q != i and s[s.find(hub) :].startswith(o[: len(s) - s.find(hub)])})
    got = overlap.overlaps(df, df, 20, 20).where("offset = 15 or offset = 0").select("query_id", "read_id", "offset")
    assert sorted(map(tuple, got.collect())) == want
    tails = [(q, i) for q, _, s in texts if s[15:35] == hub for i, _, t in texts if t[:25] == s[15:]]
    assert {(r.read_id, r.next_id) for r in overlap.best_successor(df, 20).collect()} >= {(q, min(i for p, i in tails if p == q)) for q, _ in tails}


def test_long_sequences_slide(spark):
    rng = random.Random(6)
    seq = "".join(rng.choice("ACGT") for _ in range(20_000))
    df = spark.createDataFrame([(1, "x", seq), (2, "y", seq[:1048]), (3, "z", seq[:24])], SCHEMA)
    got = kmers.slide(df, 25).select("read_id", "pos", "kmer").collect()
    assert sorted(map(tuple, got)) == [(i, p, seq[p : p + 25]) for i, n in ((1, 20_000), (2, 1048)) for p in range(n - 24)]


def test_matches_in_order(spark, rows):
    m = spark.createDataFrame([(1, 5, "+", 0, "ACGTACGTAC"), (1, 7, "+", 0, "ACGTACGTAC"), (1, 7, "-", 0, "ACGTAC"), (1, 3, "+", 4, "ACGTACGG"), (2, 9, "+", 1, "A")], "query_id bigint, read_id bigint, strand string, offset int, oriented string")
    got = overlap.match_order(m).where("query_id = 1").orderBy("place").collect()
    assert [(r.read_id, r.strand) for r in got] == [(7, "-"), (7, "+"), (5, "+"), (3, "+")]
    before = overlap.ancestors(m, 6).where("read_id = 3")
    assert {(r.before_id, r.before_strand) for r in before.collect()} == {(5, "+"), (7, "+")}
