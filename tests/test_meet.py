"""Pairs of reads are compared where their words meet; what does not match leaves no row."""

import random

import numpy as np
import pytest

from kmerloom.operators import ends, exact, overlap

K = 12
turned = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def texts():
    rng = random.Random(21)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    changed = lambda s, n: "".join(rng.choice("ACGTN") if i > K and rng.random() < n else c for i, c in enumerate(s))
    seqs = ["A" * (K + i) + some(60) for i in range(12)] + [some(20) + "A" * 30 + some(i) for i in range(12)]
    base = some(700)
    seqs += [base, base[100:500], base[100:] + some(40), changed(base, 0.03), changed(base[100:400], 0.02), base[90:180] + "R" + base[181:400], base[90:300], base[64:128], base[636:] + "T", turned(base[20:420])]
    return seqs + [changed(base[p : p + n], 0.04) for p, n in ((0, 64), (0, 128), (128, 63), (300, 192), (10, 256), (11, 257))] + ["", "ACG", "N" * 40]


def plain(seqs, inside, fits):
    return sorted(
        (q, r, strand, i) for q, a in enumerate(seqs) for r, b in enumerate(seqs) if q != r and "N" not in b and len(b) >= K for strand, o in (("+", b), ("-", turned(b)))
        for i in range(len(a) - K + 1) if a[i : i + K] == o[:K] and inside(len(a), i) and fits(a[i:], o)
    )


def test_bits_are_the_letters():
    seqs = [s for s in texts() if s]
    text, first, size = ends._text(seqs)
    row = np.repeat(np.arange(len(seqs)), size)
    at = np.arange(len(text))
    pos = at - first[row]
    fit, *bits = ends._planes(text, at, size[row] - pos, 2)
    for i in range(0, len(text), 7):
        want = seqs[row[i]][pos[i] :][:128]
        value = lambda j: sum((int(bits[p + j][i]) & (1 << 64) - 1) << 64 * p // 3 for p in (0, 3))  # noqa: E731, B023
        low, high, mask = value(0), value(1), value(2)
        assert mask == (1 << len(want)) - 1
        assert "".join("ACGT"[(low >> j & 1) + 2 * (high >> j & 1)] for j in range(len(want))) == "".join(c if c in "ACGT" else "A" for c in want)
        odd = [j for j, c in enumerate(want) if c not in "ACGT"]
        assert fit[i] == odd[0] if odd else fit[i] >= len(want)


@pytest.mark.parametrize("hot", [1000, 2])
def test_matches_are_decided_where_words_meet(spark, monkeypatch, hot):
    """Before, every pair that shared a word was shuffled, and its sequences with it."""
    made, seqs = [], texts()
    whole = overlap._fetched
    monkeypatch.setattr(overlap, "_fetched", lambda met, *a: made.append(met) or whole(met, *a))
    monkeypatch.setattr("kmerloom.operators.hot_keys.HOT_KEYS", hot)
    monkeypatch.setattr(overlap, "PROBE", 1.0)
    rows = spark.createDataFrame([*enumerate(seqs)], "read_id bigint, seq string")
    ids = lambda df: sorted(tuple(r) for r in df.select("query_id", "read_id", "strand", "offset").collect())
    far = lambda a, o: sum(x != y for x, y in zip(a, o)) / min(len(a), len(o))
    every = lambda *_: True
    for most in (0.0, 0.05, 0.2):
        got = overlap.overlaps(rows, rows, K, K, most).select("query_id", "read_id", "strand", "offset", "oriented", "rest").collect()
        want = plain(seqs, every, lambda a, o: far(a, o) <= most)  # noqa: B023
        assert sorted(tuple(r)[:4] for r in got) == want and len(want) > 20
        assert all(r.rest == len(seqs[r.query_id]) - r.offset and r.oriented == (seqs[r.read_id] if r.strand == "+" else turned(seqs[r.read_id])) for r in got)
        assert made[-1].count() < 0.5 * len(plain(seqs, every, every))
    short = rows.where("length(seq) < 200 and not seq rlike '[^ACGT]'")
    assert overlap.overlaps(short, short, K, K).count() > 5 and made[-1].isEmpty()
    assert ids(overlap.prefix_overlaps(rows, rows, K, 30)) == plain(seqs, lambda n, i: i < n - 30, lambda a, o: a[:30] == o[:30])
    assert made[-1].isEmpty()
    assert ids(overlap.prefix_overlaps(rows, rows, K, 70, 0.1)) == plain(seqs, lambda n, i: i < n - 70, lambda a, o: far(a[:70], o[:70]) <= 0.1)
    assert ids(overlap.prefix_overlaps(rows, rows, K, 9)) == plain(seqs, lambda n, i: i < n - 9, every)


def test_reads_within_others_are_found_by_their_beginnings(spark, monkeypatch):
    """Before, all k-mers of all reads were shuffled, twice."""
    seqs, made = sorted({min(s, turned(s)) for s in texts() if "N" not in s and "R" not in s and len(s) >= K}), []
    whole = overlap.word_keys
    monkeypatch.setattr(overlap, "word_keys", lambda *a: made.append(whole(*a)) or made[-1])
    once = spark.createDataFrame([*enumerate(seqs)], "id bigint, seq string")
    inner = {i for i, s in enumerate(seqs) if any(len(h) > len(s) and (s in h or turned(s) in h) for h in seqs)}
    assert {r.id for r in exact.outermost(once, K).collect()} == set(range(len(seqs))) - inner and len(inner) > 3
    assert made[0].count() < 0.2 * sum(len(s) - K + 1 for s in seqs)


@pytest.mark.parametrize("head", [8, 2])
def test_ancestors_meet_by_what_reaches_beyond_the_query(spark, monkeypatch, head):
    """Before, all pairs of matches of a query were compared, letter by letter."""
    monkeypatch.setattr(overlap, "HEAD", head)
    rng, seqs = random.Random(5), texts()
    seqs += ["A" * (K + i) + "".join(rng.choice("AC") for _ in range(i % 5)) for i in range(12)] + ["CC" + "A" * 30]
    rows = spark.createDataFrame([*enumerate(seqs)], "read_id bigint, seq string")
    found = overlap.overlaps(rows, rows, K, K).cache()
    m = [tuple(r) for r in found.select("query_id", "read_id", "strand", "offset", "oriented").collect()]
    want = sorted(
        (*v[:4], *u[1:4]) for v in m for u in m if u[0] == v[0] and u[1:4] != v[1:4] and (d := v[3] - u[3]) >= 0 and (n := len(u[4]) - d) >= K
        and u[4][d:][: len(v[4])] == v[4][:n]
    )
    assert sorted(map(tuple, overlap.ancestors(found, K, exact=True).collect())) == want and len(want) > 100
    assert sorted(map(tuple, overlap.ancestors(found, K).collect())) == want
