import random

from pyspark.sql import functions as F

from kmerloom.operators import search, sieve
from kmerloom.operators.kmers import six_frames


def test_first_hits_of_frames(spark, monkeypatch):
    """As a plain search in Python, whatever passes the sieves; few rows leave their tasks."""
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in [0, 1, 2, 23, 27, 30, 31, *[90] * 30]]
    seqs += [seqs[9][:40] + "N" + seqs[9][41:], seqs[10][5:70], seqs[11][::-1].translate(str.maketrans("ACGT", "TGCA")), "N" * 40]
    reads = spark.createDataFrame([*((i, f"r{i}", s) for i, s in enumerate(seqs)), (77, "null", None)], "read_id bigint, name string, seq string").repartition(3)
    frames = [(r.read_id, r.frame, r.aa) for r in six_frames(reads.where("seq is not null")).collect()]
    own = [(i, aa) for i, f, aa in frames if f == 1 and i % 3 == 0] + [(200, "MK" + frames[70][2] + frames[70][2])]
    prof = spark.createDataFrame([*((i, f"p{i}", aa) for i, aa in own), (300, "none", None)], "profile_id bigint, profile string, pseq string")
    last = {}
    for i, aa in sorted(own):
        for p in range(len(aa) - 8 + 1):
            last[aa[p : p + 8]] = (i, aa[p:])
    want = {}
    for i, f, aa in frames:
        for p in range(len(aa) - 8):
            if aa[p : p + 8] in last:
                want[i, f] = (p, aa[p : p + 8], *last[aa[p : p + 8]], aa)
                break

    def got():
        return {(r.read_id, r.frame): (r.pos, r.kmer, r.profile_id, r.suffix, r.aa) for r in search.candidates(reads, prof, 8).collect()}

    assert got() == want and len(want) > 12
    (known,) = sieve.sieves(search._keys(prof, "pseq", 8))
    assert search._seed_rows(reads, 8, known, True).agg(F.count(F.lit(1))).first()[0] < len(want) + 10
    (every,) = sieve.sieves(search._keys(six_frames(reads.where("seq is not null")), "aa", 8))  # lets all words through
    monkeypatch.setattr(search, "sieves", lambda keys, kinds=1: [every])
    assert got() == want
