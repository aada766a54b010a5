"""Components and assembly: golden contigs, joins against plain Python, closed paths, clashing columns, odd inputs."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import assembly, components, ends, exact, overlap

SCHEMA = "read_id bigint, name string, seq string"


def turned(seq):
    return seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def letters(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def simulated(seed, genomes=4, size=700, n=250, length=60, errors=0.05):
    rng = random.Random(seed)
    reads = []
    for g in range(genomes):
        genome = letters(rng, size)
        if g % 2:
            genome += genome[100:250] + letters(rng, 100)
        for _ in range(n // genomes):
            p = rng.randrange(len(genome) - length)
            s = genome[p : p + length]
            if rng.random() < errors:
                s = s[:30] + rng.choice("ACGT") + s[31:]
            reads.append(turned(s) if rng.random() < 0.5 else s)
    rng.shuffle(reads)
    return [(i, f"r{i}", s) for i, s in enumerate(reads)]


def plain_contigs(reads, k, by_letter):
    """``(seed_id, len, cov, stdev, seq)`` by looking at all pairs of strands, and by walking along mutual choices."""
    occr = Counter(min(s, turned(s)) for *_, s in reads)
    firsts = {}
    for i, _, s in reads:
        firsts.setdefault(min(s, turned(s)), (i, s))
    nodes = {(i, t): turned(s) if t else s for i, s in firsts.values() for t in (0, 1)}
    copies = {i: occr[min(s, turned(s))] for i, s in firsts.values()}
    begins = defaultdict(list)
    for v, s in sorted(nodes.items()):
        for n in range(k, len(s)):
            begins[s[:n], s[n] if by_letter else ""].append(v)
    best = {}
    for u, s in nodes.items():
        ways = {}
        for base in "ACGT" if by_letter else [""]:
            for n in range(k, len(s)):
                if found := begins.get((s[-n:], base)):
                    v = found[0] if found[0][0] != u[0] else found[-1]
                    if v[0] != u[0]:
                        weight = ways.get(base, (0,))[0] + sum(copies[i] for i, _ in found)
                        ways[base] = (weight, n, v)
        if ways:
            base = min(ways, key=lambda b: (-ways[b][0], b))
            best[u] = ways[base]
    other = lambda v: (v[0], 1 - v[1])
    step = {u: b for u, b in best.items() if (c := best.get(other(b[2]))) and c[2] == other(u) and c[1] == b[1]}
    into = {b[2] for b in step.values()}
    out, left = [], set(nodes)
    for u in [*sorted(set(nodes) - into), *sorted(into)]:
        if u not in left:
            continue
        path, seq, w, w2, at = [], nodes[u], copies[u[0]] * len(nodes[u]), copies[u[0]] ** 2 * len(nodes[u]), u
        while at in left:
            left.discard(at)
            path.append(at)
            if at in step and step[at][2] in left:
                weight, n, v = step[at]
                seq += nodes[v][n:]
                w, w2 = w + weight * (len(nodes[v]) - n), w2 + weight**2 * (len(nodes[v]) - n)
                at = v
        if min(path)[1] == 0:
            out.append((min(path)[0], len(seq), round(w / len(seq), 6), round(math.sqrt(max(0, w2 / len(seq) - (w / len(seq)) ** 2)), 6), seq))
    return sorted(out)


def found(df):
    return sorted((r.seed_id, r.len, round(r.cov, 6), round(r.stdev, 6), r.seq) for r in df.collect())


def brute_components(reads, k):
    parent = {i: i for i, _, _ in reads}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    prefix, held = defaultdict(list), defaultdict(list)
    for i, _, s in reads:
        for o in (s, turned(s)):
            prefix[o[:k]].append(i)
            for p in range(len(o) - k + 1):
                held[o[p : p + k]].append(i)
    for w, owners in prefix.items():
        for i in held[w]:
            a, b = find(i), find(owners[0])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_contigs_equal_plain_python(spark, seed):
    reads = simulated(seed)
    reads += [(1000 + i, "again", turned(s) if i % 2 else s) for i, (_, _, s) in enumerate(reads[:40])]
    df = spark.createDataFrame(reads, SCHEMA)
    want = plain_contigs(reads, 15, True)
    assert found(assembly.contigs(df, 15, min_length=0)) == want and max(c[3] for c in want) > 0
    assert found(assembly.unitigs(df, 15)) == plain_contigs(reads, 15, False)
    comps = {r.id: r.comp for r in components.overlap_components(df, 15).collect()}
    assert comps == brute_components(reads, 15) and len(set(comps.values())) > 1
    words = {o[p : p + 15] for _, _, s in reads for o in (s, turned(s)) for p in range(len(s) - 14)}
    assert all(c[4][p : p + 15] in words for c in want for p in range(len(c[4]) - 14))


def test_partitions_change_nothing(spark):
    reads = simulated(3)
    df = spark.createDataFrame(reads, SCHEMA)
    want = found(assembly.contigs(df, 15, min_length=0))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found(assembly.contigs(df.repartition(7), 15, min_length=0)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


#: Nine reads of two sources and their contigs; two reads of the first source overlap by a letter too few.
FIRST = "ACCGAAGTCTATACCATCAGCGGCAGCACAAAATCCGGCGCAAAATCCGCTTCCAAATCCGGCAGGGTCAGCGTCGTTATCCAGCCTTCGAGTACGCAAAAATCCGAATAATCCCAAAATGCCGTCTGAAATATAAACCCGGTTCGGACGGCATATGCCGACCGAAGATATTGAAGAGATATTTATGAGTGCAAACGTCAGCC"
BROKEN = "TATTTATGAGTGCAAACGTCAGCCGCCTTGTTGTTCAAAACCTGCAAAAAAGTTTCAAAAAACGCCAAGTCGTTAAAAGCTTCTCCCTCGAAATCGAAAGC"
SECOND = "ACTGCTCGGGCCCAACGGTGCGGGTAAAACCACCAGCTTCTACATGATTGTCGGACTCATCGCCGCCGACGCAGGCAGCGTAACCCTAGACGGACAAGAATTGCGCCACCTGCCCATACACGAACGCGCCCGCCTCGGTGTCGGCTACCTGCCGCAGGAAGCCTCG"


def test_golden(spark):
    starts = [("1", FIRST, (0, 48, 92, 123)), ("1", BROKEN, (0, 21)), ("2", SECOND, (0, 40, 86))]
    named, reads = Counter(), []
    for source, text, places in starts:
        for p in places:
            named[source] += 1
            reads.append((len(reads), f"{source}_{named[source]}", text[p : p + 80]))
    got = assembly.numbered(assembly.contigs(spark.createDataFrame(reads, SCHEMA), 25)).orderBy("contig_id").collect()
    assert [(r.contig_id, r.len, r.cov, r.stdev, round(r.gc, 1), r.seed, r.seq) for r in got] == [
        ("Contig_0_0", 203, 1.0, 0.0, 48.8, "1_1", FIRST), ("Contig_0_1", 166, 1.0, 0.0, 63.3, "2_1", SECOND),
    ]
    short = assembly.contigs(spark.createDataFrame(reads, SCHEMA), 25, min_length=0).where("len <= 125").collect()
    assert [(r.seed, r.seq) for r in short] == [("1_5", BROKEN)]


def test_ways_are_weighed(spark):
    """Two reads go one way, one with a longer overlap the other; equal ways go in the order of letters."""
    rng = random.Random(4)
    stem, heavy, light = letters(rng, 60), "T" + letters(rng, 59), "C" + letters(rng, 59)
    reads = [stem, (stem + light)[5:65], (stem + heavy)[20:80], (stem + heavy)[30:90]]
    df = spark.createDataFrame([(i, "r", s) for i, s in enumerate(reads)], SCHEMA)
    assert {r.seq for r in assembly.contigs(df, 20, min_length=0).collect()} == {stem + heavy[:30], reads[1]}
    assert {r.seq for r in assembly.unitigs(df, 20).collect()} >= {stem + light[:5]}
    tied = df.where("read_id < 3")
    assert stem + light[:5] in {r.seq for r in assembly.contigs(tied, 20, min_length=0).collect()}


def test_closed_path(spark):
    rng = random.Random(6)
    ring = letters(rng, 200)
    rows = [(i, f"r{i}", (ring + ring)[p : p + 60]) for i, p in enumerate(range(0, 200, 20))]
    lone = letters(rng, 60)
    df = spark.createDataFrame([*rows, (99, "lone", lone)], SCHEMA)
    for got in (assembly.unitigs(df, 30).collect(), assembly.contigs(df, 30, min_length=0).collect()):
        assert sorted((r.seed_id, r.seq) for r in got) == [(0, (ring + ring)[:240]), (99, lone)]


def test_reads_that_overlap_themselves(spark):
    reads = [(i, "r", s) for i, s in enumerate(["A" * 60, "A" * 60, "T" * 60, "AC" * 30, "CA" * 30, "ACGT" * 15])]
    assert found(assembly.contigs(spark.createDataFrame(reads, SCHEMA), 20, min_length=0)) == plain_contigs(reads, 20, True)


def test_a_third_of_all_reads_share_an_end(spark):
    rng = random.Random(8)
    hub = letters(rng, 30)
    reads = [(i, "r", hub + letters(rng, 30) if i % 3 == 0 else letters(rng, 30) + hub if i % 3 == 1 else letters(rng, 60)) for i in range(900)]
    assert found(assembly.contigs(spark.createDataFrame(reads, SCHEMA), 20, min_length=0)) == plain_contigs(reads, 20, True)


def test_clashing_columns_and_ids_of_two_parts(spark):
    reads = simulated(9, n=80)
    df = spark.createDataFrame(reads, SCHEMA)
    want = found(assembly.contigs(df, 15, min_length=0))
    clashing = df.selectExpr("struct(read_id div 3 AS a, read_id % 3 AS b) AS read_id", "name", "seq", "1 AS node", "2 AS head", "3 AS id", "4 AS n", "5 AS base")
    got = assembly.contigs(clashing, 15, min_length=0).withColumn("seed_id", F.expr("seed_id.a * 3 + seed_id.b"))
    assert found(got) == want


def test_assembly_ends_at_a_share(spark, monkeypatch):
    monkeypatch.setattr(assembly, "PART", 3)
    reads = simulated(16, n=120)
    df = spark.createDataFrame(reads, SCHEMA)
    every = assembly.until_depleted(df, 15, 1.0).orderBy("seed_id").collect()
    assert sum(r.reads for r in every) == len(reads) and [r.seq for r in every] == [r.seq for r in assembly.contigs(df, 15, min_length=0).orderBy("seed_id").collect()]
    half = assembly.until_depleted(df, 15, 0.5).orderBy("seed_id").collect()
    assert half == every[: len(half)] and sum(r.reads for r in half[:-1]) < 60 <= sum(r.reads for r in half)
    assert assembly.until_depleted(df, 15, 0.0).count() == 0


def test_nothing_to_assemble(spark):
    none = spark.createDataFrame([(1, "n", "N" * 60), (2, "s", "ACG"), (3, None, ""), (None, "i", "ACGT" * 20), (5, "x", None)], SCHEMA)
    assert assembly.contigs(none, 20).count() == assembly.unitigs(none.limit(0), 20).count() == exact.exact_contigs(none, 20).count() == 0
    assert assembly.numbered(assembly.contigs(none, 20)).count() == 0 and components.overlap_components(none, 20).count() == 0
    with pytest.raises(ValueError, match="exceed 8"):
        assembly.contigs(none, 8)


@pytest.mark.parametrize("k", [14, 15])
def test_exact_contigs(spark, k):
    """Reads of many lengths: those within others are dropped, however they lie, the rest are joined."""
    rng = random.Random(k)
    reads = [(i, n, s[: 40 + i % 21]) for i, n, s in simulated(11)]
    reads += [(500 + i, "in", turned(s[4:30]) if i % 2 else s[:22]) for i, (_, _, s) in enumerate(rng.sample(reads, 60))]
    reads += [(900 + i, "a", "A" * (30 + i)) for i in range(5)] + [(950, "p", "ACGCGCGCGT" * 4), (951, "p", "GCGCGCGTACGCGCGC")]
    whole = {min(s, turned(s)) for *_, s in reads}
    inner = {s for s in whole if any(len(h) > len(s) and (s in h or turned(s) in h) for h in whole)}
    outer = [r for r in reads if min(r[2], turned(r[2])) not in inner]
    df = spark.createDataFrame(reads, SCHEMA)
    once = assembly.distinct_reads(assembly.usable(df, k))
    assert {min(r.seq, turned(r.seq)) for r in exact.outermost(once, k).collect()} == whole - inner
    want = [(c[0], c[1], c[4]) for c in plain_contigs(outer, k, False)]
    assert sorted((r.seed_id, r.len, r.seq) for r in exact.exact_contigs(df, k, min_length=0).collect()) == want and max(c[1] for c in want) > 200


def test_long_reads(spark):
    """Reads of 20,000 letters."""
    rng = random.Random(14)
    genome = letters(rng, 80_000)
    reads = [(i, "r", turned(genome[p : p + 20_000]) if i % 2 else genome[p : p + 20_000]) for i, p in enumerate(range(0, 60_001, 15_000))]
    df = spark.createDataFrame(reads, SCHEMA)
    (got,) = exact.exact_contigs(df, 25).collect()
    assert got.seq == genome and got.tier == "long" and got.seed_id == 0
    assert [tuple(r) for r in overlap.best_successor(df.where("read_id in (0, 2, 4)"), 25).collect()] == []


def test_keys_are_those_of_equal_letters():
    rng = random.Random(15)
    seqs = [letters(rng, rng.randrange(8, 60)) for _ in range(40)] + ["A" * 50, "AC" * 20, ""]
    keys = defaultdict(set)
    for at_end in (False, True):
        row, n, h, g, base = ends._hashed(seqs, 8, at_end)
        for r, m, a, b, c in zip(row.tolist(), n.tolist(), h.tolist(), g.tolist(), base.tolist()):
            keys[m, a, b].add(seqs[r][-m:] if at_end else seqs[r][:m])
            assert at_end or chr(c) == seqs[r][m]
    assert all(len(v) == 1 for v in keys.values()) and len(keys) == len({s for v in keys.values() for s in v})
