"""Training-data operators against brute force, round trips and hand-made cases."""

import importlib.util
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kmerloom.llm import canonical, encode, encoding, frequent, leaks, neighbors, pieces, spans

READS = "read_id bigint, seq string, seq_ string"
RECORDS = "rec_id bigint, header string, seq string, text string"
DOCS = "doc_id bigint, source string, text string, w string"


# ---- frequent values


@pytest.mark.parametrize("groups", [16, 1 << 16])
def test_frequent_is_exact(spark, groups):
    rng = random.Random(groups)
    data = [(f"v{int(rng.paretovariate(0.7)) % 5000}", rng.choice([None, 0, 1, 2, 9])) for _ in range(20000)] + [(None, 10**6), ("", 7)]
    df = spark.createDataFrame(data, "v string, n int")
    sums = Counter()
    for v, n in data:
        if v is not None:
            sums[v] += n or 0
    expected = sorted(((v, n) for v, n in sums.items() if n), key=lambda x: (-x[1], x[0]))[:25]
    assert [tuple(r) for r in frequent.frequent_items(df, "v", "n", 25, groups).collect()] == expected


def test_flat_weights_are_refined_to_the_end(spark):
    """No bound prunes these; every round's survivors are too many to broadcast."""
    data = [(f"v{i}", 5 + (i % 997 == 0)) for i in range(6000)]
    got = frequent.frequent_items(spark.createDataFrame(data, "v string, n int"), "v", "n", 9, 64).collect()
    assert [tuple(r) for r in got] == sorted(data, key=lambda x: (-x[1], x[0]))[:9]


def test_frequent_edges(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 0), (None, 5)], "v string, n int")
    assert [r.item for r in frequent.frequent_items(df, "v", "n", 2).collect()] == ["a", "b"]
    assert frequent.frequent_items(df, "v", "n", 9).count() == 3
    assert frequent.frequent_items(df.limit(0), "v", "n", 3).count() == 0
    assert [tuple(r) for r in frequent.frequent_items(df, "v", None, 1).collect()] == [("a", 1)]
    with pytest.raises(ValueError, match="negative"):
        frequent.frequent_items(df.selectExpr("v", "-n as n"), "v", "n", 2)


# ---- shared spans


def brute_spans(rows, span):
    owners = defaultdict(set)
    for i, s in rows:
        for p in range(len(s or "") - span + 1):
            owners[s[p : p + span]].add(i)
    out = set()
    for i, s in rows:
        shared = {q for p in range(len(s or "") - span + 1) if len(owners[s[p : p + span]]) > 1 for q in range(p, p + span)}
        out |= {(i, b, next(e for e in range(b, 10**6) if e not in shared)) for b in shared if b - 1 not in shared}
    return sorted(out)


@pytest.mark.parametrize(("alphabet", "block"), [("ACGT", 256), ("ACGT", 2), ("AC", 3)])
def test_spans_equal_brute_force(spark, alphabet, block):
    rng = random.Random(block)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 60))) for _ in range(25)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    texts += [texts[0], texts[0], "A" * 90, "A" * 91, "Aé漢\n\0" * 9, "xAé漢\n\0" + "Aé漢\n\0" * 8, "", None]
    rows = [*enumerate(texts), (0, texts[0])]
    df = spark.createDataFrame([(i, s, s) for i, s in rows], READS)
    got = spans.shared_spans(df, span=24, levels=(8, 16), block_rows=block)
    assert sorted(map(tuple, got.collect())) == brute_spans(rows, 24)


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "A" * 80, ""), (None, "A" * 80, "")], READS)
    assert spans.shared_spans(df).count() == 0 and spans.shared_spans(df.limit(0)).count() == 0


def test_long_sequences_are_cut_into_slices(monkeypatch):
    monkeypatch.setattr(spans, "SLICE", 100)
    rng = random.Random(1)
    text = "".join(rng.choice("ACGT") for _ in range(1000))
    windows = Counter(w for _, b, e, _ in spans.stretches([text, "AC"], 8, 24) for w in range(b, e - 23))
    assert windows == Counter(range(1000 - 23))


def test_a_hot_window(spark):
    """A third of all rows share a window that no minimizer can split."""
    rng = random.Random(9)
    shared = "".join(rng.choice("ACGT") for _ in range(30))
    texts = [(shared if i % 3 == 0 else "") + "".join(rng.choice("ACGT") for _ in range(40)) for i in range(600)]
    df = spark.createDataFrame([(i, s, s) for i, s in enumerate(texts)], READS)
    assert sorted(map(tuple, spans.shared_spans(df, span=24, levels=(8, 16), block_rows=20).collect())) == brute_spans([*enumerate(texts)], 24)


# ---- pieces


def plain_pieces(s, limit=2000, overlap=50, gap=10):
    ends, b, out = [m.end() for m in re.finditer(f"[^ACGTacgt]{{{gap},}}", s)], 0, []
    while len(s) - b > limit:
        fit = [e for e in ends if b + overlap < e <= b + limit]
        e = fit[-1] if fit else b + limit
        out.append((b, e))
        b = e - overlap
    return [*out, (b, len(s))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 130), st.integers(0, 25)), max_size=12), st.integers(20, 90), st.integers(0, 19))
def test_pieces_follow_the_rule(parts, limit, overlap):
    s = "".join("A" * a + "N" * n for a, n in parts)
    if len(s) > limit:
        assert pieces.merged_pieces(len(s), [m.end() for m in re.finditer("N{10,}", s)], limit, overlap) == plain_pieces(s, limit, overlap)


def test_pieces_keep_long_gaps():
    rng = random.Random(5)
    for _ in range(300):
        s = "".join("A" * rng.randrange(1, 130) + "N" * rng.randrange(10, 40) for _ in range(rng.randrange(2, 12)))
        gaps = {m.end(): len(m[0]) for m in re.finditer("N{10,}", s)}
        got = pieces.merged_pieces(len(s), [*gaps], 150, 10, gaps)
        assert got[0][0] == 0 and got[-1][1] == len(s) and all(e - b <= 150 for b, e in got) and all(b == e - 10 for (_, e), (b, _) in zip(got, got[1:]))
        # what stays would not fit together, and no weaker boundary was kept beside a stronger one that both pieces would have allowed to merge
        assert all(e2 - b > 150 for (b, _), (_, e2) in zip(got, got[1:]))


def test_pieces_of_tables(spark):
    texts = {1: "A" * 2000, 2: "A" * 1500 + "N" * 10 + "c" * 1500, 3: None, 4: "", None: "ACGT" * 2000, 5: "-" * 5000}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "contig_ord bigint, seq string, beg_pos int")
    got = defaultdict(list)
    for k, b, e in map(tuple, pieces.split_oversized(df).collect()):
        got[k].append((b, e))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_pieces(v) for k, v in texts.items() if v and len(v) > 2000}
    assert pieces.split_oversized(df.limit(0)).count() == 0


# ---- neighbours


def brute_neighbors(vectors, k, floor):
    ids, x = zip(*sorted(vectors.items()))
    x = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    c = np.round(x @ x.T, 9)
    np.fill_diagonal(c, -9)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-c[i], kind="stable")[:k] if c[i, j] >= floor}


def clustered(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    return {i: (centres[i % len(centres)] + rng.normal(size=dim) * rng.choice([0.02, 0.1])).tolist() for i in range(n)}


@pytest.mark.parametrize("bucket", [2048, 4])
def test_neighbors_recall(spark, bucket):
    vectors = clustered(bucket, 400)
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "vec_id bigint, v array<double>, other string")
    got = {(r.id, r.other) for r in neighbors.nearest(df, "vec_id", "v", 16, 5, 0.9, bucket_rows=bucket).collect()}
    expected = brute_neighbors(vectors, 5, 0.9)
    assert len(got & expected) >= 0.9 * len(expected) and len(got & expected) >= 0.9 * len(got)


def test_neighbors_of_copies_and_bad_vectors(spark):
    base = np.random.default_rng(0).normal(size=16)
    rows = [(i, (base * (1 + i % 3)).tolist()) for i in range(40)]
    rows += [(100, None), (101, [0.0] * 16), (102, [1.0] * 15), (103, [float("nan")] * 16), (104, [None] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>")
    got = defaultdict(list)
    for r in neighbors.nearest(df, "vec_id", "v", 16, 5).orderBy("id", "place").collect():
        got[r.id].append(r.other)
    assert got == {i: [j for j in range(40) if j != i][:5] for i in range(40)}
    assert neighbors.nearest(df.limit(0), "vec_id", "v", 16).count() == 0


@pytest.mark.parametrize("block", [50, 2048])
def test_neighbors_however_far(spark, block):
    rng = np.random.default_rng(3)
    vectors = dict(enumerate([*rng.normal(size=(150, 16)).tolist(), *[[1.0] * 16] * 9]))
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "vec_id bigint, v array<double>, other string")
    got = {(r.id, r.other) for r in neighbors.nearest_of_all(df, "vec_id", "v", 16, 5, block_rows=block).collect()}
    assert got == brute_neighbors(vectors, 5, -1) and len(got) == 5 * len(vectors)
    few = neighbors.nearest_of_all(df.limit(3), "vec_id", "v", 16, 5)
    assert few.count() == 6 and neighbors.nearest_of_all(df.limit(0), "vec_id", "v", 16).count() == 0


def test_probe_order():
    sets = neighbors.probe_sets(4, 12)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == 12
    assert not any({7 - r for r in s} & set(s) for s in sets)


# ---- canonical records

SEQ = "ACGTTGCANN"
FORMS = [
    (">id_c1_len_10_cov_2.5_gc_40.0_seed_3.17", SEQ), ('seed: "3.17" | GC: 40.0 | cov: 2,5 | ID: C1 | len: 10;', "acgt-tgc\nANN"),
    ("; len=10\tcov=2.5\tseed=3_17\tid=c1\tgc=40.0.", '"ACGTT GCANN"'), ("> Id_C1  Len_10  Cov_2.5  Gc_40.0  Seed_3.17 ", "A|C|G|T|T|G|C|A|N|N"),
]
OTHERS = [(">id_c1_len_10_cov_2.5_gc_40.0_seed_3.18", SEQ), (">id_c1_len_10_cov_2.5_gc_40.0_seed_3.17", SEQ[:-1]), ("no fields", SEQ), ("no  fields", SEQ), (None, SEQ), (FORMS[0][0], None), (FORMS[0][0], None), ("", "")]


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_canonical_records(spark, bucket):
    rows = [(i, h, s, "clash") for i, (h, s) in enumerate([*FORMS, *OTHERS, *OTHERS[:5], FORMS[0]])]
    df = spark.createDataFrame(rows, RECORDS)
    groups = defaultdict(list)
    for i, h, s, _ in rows:
        if s is not None:
            groups["form" if (h, s) in FORMS else (h, s)].append(i)
    assert sorted(map(tuple, canonical.copies(df, bucket).collect())) == sorted((v[0], x) for v in groups.values() for x in v[1:])
    expected = [(v[0], len(v)) for v in groups.values()] + [(i, 1) for i, _, s, _ in rows if s is None]
    assert sorted(map(tuple, canonical.records(df, bucket).collect())) == sorted(expected)
    assert canonical.copies(df.limit(0)).count() == canonical.records(df.limit(0)).count() == 0


def test_a_heavy_record(spark):
    rows = [(i, FORMS[i % 4][0], FORMS[i % 4][1], "") if i % 3 == 0 else (i, f"id {i} len 1 cov 1 gc 1 seed 1", "ACGT" * 9, "") for i in range(3000)]
    df = spark.createDataFrame(rows, RECORDS)
    assert sorted(map(tuple, canonical.copies(df, 100).collect())) == [(0, i) for i in range(3, 3000, 3)]
    assert {r.n_copies for r in canonical.records(df, 100).collect()} == {1, 1000}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"", b"a", b"a" * 16, b"a" * 17, b"a" * 32, b"a" * 40, b"b" * 16 + b"c", b"b" * 16 + b"d" * 20]), max_size=30))
def test_trie_counts(texts):
    trie = canonical.Trie()
    for i, t in enumerate(texts):
        trie.add(t, i)
    firsts = {t: texts.index(t) for t in texts}
    assert sorted(map(tuple, trie.terminals())) == sorted((firsts[t], n) for t, n in Counter(texts).items())


# ---- encoding with a tokenizer

public = pytest.mark.skipif(importlib.util.find_spec("public_tokenizers") is None, reason="no vocabulary files")
BITS = ["'s", "'", "s", "re", "ll", " ", "  ", "\n", "\t", "a", "B", "é", "\xa0", "　", "\x85", "\x1c", "1", "99", "!", "..", "<|endoftext|>", "日", "😀", "́", "ve", "'re", "đ", "؀"]


@pytest.fixture(scope="module")
def direct():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@public
def test_encoding_equals_the_tokenizer(spark, direct):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(20))) for _ in range(2000)] + [None, "", "x" * 5000, "don't  stop\n\n\nfoo"]
    df = spark.createDataFrame([(i, None, t, "ids") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.ids for r in encode.encode(df).collect()}
    assert got == {i: direct(t) if t else [] for i, t in enumerate(texts)}
    assert encode.encode(df.limit(0)).count() == 0


@public
def test_slices_of_a_long_text(direct, monkeypatch):
    monkeypatch.setattr(encode, "SLICE", 50)
    encoder = encode.Encoder(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice(BITS) for _ in range(100))
        assert encoder.ids([t, None, "a"]) == [direct(t), [], direct("a")]


# ---- leaks


def plain_words(text):
    import regex

    return [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", text or "")]


def test_leaks(spark):
    item = "One two three, four five six seven eight nine ten eleven twelve thirteen."
    docs = ["Before. " + item.upper() + " After.", "one two three four five six seven eight nine ten eleven", "x " + " - ".join(plain_words(item)[1:]) + " y", None, "", item.replace("five", "5ive"), item + " " + item]
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "too short")], "item_id bigint, text string")
    df = spark.createDataFrame([(i, None, t, "") for i, t in enumerate(docs)], DOCS)
    assert sorted(map(tuple, leaks.leaks(df, items).collect())) == [(d, i) for d in (0, 2, 6) for i in (1, 2)]
    assert leaks.leaks(df.limit(0), items).count() == leaks.leaks(df, items.limit(0)).count() == 0
    clean = leaks.without_leaks(df, items)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {1, 3, 4, 5}
    cut = {r.doc_id: r.text for r in leaks.without_leaks(df, items, remove="spans").collect()}
    assert cut[0] == "Before. After." and cut[2] == "x y" and cut[3] is None and cut[5] == docs[5] and cut[6] == ""
    again = {r.doc_id: r.text for r in leaks.without_leaks(df.withColumn("leak_at", df.doc_id), items, remove="spans").collect()}
    assert again == cut
    with pytest.raises(ValueError, match="remove"):
        leaks.without_leaks(df, items, remove="all")


def test_leaks_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BROADCAST_GRAMS", 0)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(40)) for _ in range(30)]
    items = spark.createDataFrame([*enumerate(texts[:10])], "item_id bigint, text string")
    df = spark.createDataFrame([(i, None, t, "") for i, t in enumerate(texts)], DOCS)
    grams = lambda t, n=5: {tuple(t.split()[i : i + n]) for i in range(36)}
    assert sorted(map(tuple, leaks.leaks(df, items, 5).collect())) == sorted((d, i) for d in range(30) for i in range(10) if grams(texts[d]) & grams(texts[i]))


# ---- garbled text

SENTENCES = [
    "Die Tür war ein bißchen schön und größer", "Müller fühlt sich überraschend gut während März", "Éric a été très déçu après l’été à Noël", "la fenêtre était cassée même plutôt légère",
    "Купила хороший чайник и очень рада", "Муж говорит что насос всегда отличный", "Zażółć gęślą jaźń w święta każdej nocy", "źródło było też bardzo głośne i średnie", "plain ascii only",
]
CHANNELS = [("utf_8", "latin_1"), ("utf_8", "cp1252"), ("cp1251", "latin_1"), ("koi8_r", "cp1251"), ("utf_8", "cp437"), ("utf_8", "mac_roman")]


def test_garbled_text(spark):
    rng = random.Random(8)
    rows, wrong, whole = [], {}, set()
    for i in range(1500):
        words = " ".join(rng.choice(SENTENCES) for _ in range(3)).split(" ")
        rng.shuffle(words)
        text = " ".join(words)
        if i % 40 == 0:
            w, r = CHANNELS[i // 40 % len(CHANNELS)]
            text = text.encode(w, "ignore").decode(w)  # what that code page can write at all
            bad = text.encode(w).decode(r, "ignore")
            if bad != text:
                wrong[i] = text
                if len(text.encode(w)) == len(bad):  # no byte was lost
                    whole.add(i)
                text = bad
        rows.append((i, rng.choice(["a", "b", None]), text, ""))
    rows += [(2000, "a", None, ""), (2001, "a", "", ""), (2002, None, "lost l�tter", ""), (2003, "a", "\xa0 — €5 \xa0", "")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in encoding.restored(df).collect()}
    assert not set(got) - set(wrong) - {2002}, "correct text taken as garbled"
    assert len(set(got) & set(wrong)) >= 0.95 * len(wrong) and got[2002].channels == []
    assert len(whole) > 20 and sum(got[i].text == wrong[i] for i in whole if i in got) >= 0.9 * len(whole), [(got[i].text, wrong[i]) for i in whole if i in got and got[i].text != wrong[i]]
    assert encoding.restored(df.limit(0)).count() == 0


def test_channels_are_undone():
    model = encoding.Model(encoding.Bigrams({}, {}))
    for w, r in CHANNELS:
        for s in ("größer", "отличный"):
            try:
                bad = s.encode(w).decode(r)
            except UnicodeError:
                continue
            beyond = "".join(sorted({c for c in bad if c >= "\x80"}))
            assert f"{w}>{r}" in (encoding.decodings(bad, beyond)[s] if w in encoding.MULTI else model.table(f"{w}>{r}") and [f"{w}>{r}"])
            assert w in encoding.MULTI or bad.translate(model.table(f"{w}>{r}")) == s
    twice = "é".encode().decode("cp1252").encode().decode("cp1252")
    assert "é" in encoding.decodings(twice, "".join(sorted(set(twice))))


def test_letters_of_a_page_are_learned():
    """A page like cp1251 read as Latin-1 but for two letters: expectation-maximization finds them from the bigrams."""
    words = [w for s in SENTENCES[4:6] for w in s.lower().split()] + ["кот", "они", "нос", "сон", "окно", "тот", "стон", "тонок", "носок", "коса", "насос", "стена", "холод", "хорошо", "муха", "ухо", "охота", "хвост"]
    page = {c: c.encode("cp1251").decode("latin_1") for w in words for c in w}
    page["т"], page["х"] = page["х"], page["т"]
    pairs, letters, channel = Counter(), Counter(), "cp1251>latin_1"
    for w in words:
        pairs.update(map("".join, zip("\n" + w, w + "\n")))
        letters.update(w + "\n")
    bigrams = lambda: encoding.Bigrams({k: 50 * v for k, v in pairs.items()}, {k: 50 * v for k, v in letters.items()})
    model = encoding.Model(bigrams())
    for _ in range(4):
        counts = defaultdict(Counter)
        for w in words * 5:
            bad = "".join(page[c] for c in w)
            for char, letter, p in model.stands_for(channel, bad, bad.translate(model.table(channel))):
                counts[channel, char][letter] += p
        model = encoding.Model(bigrams(), letters=counts)
    assert all("".join(page[c] for c in w).translate(model.table(channel)) == w for w in words)


def test_sources_have_their_own_shares(spark):
    """What is common in one source weighs for it alone, however many sources there are."""
    rng = random.Random(3)
    rows = []
    for i in range(2000):
        text = " ".join(rng.choice(SENTENCES[:4]) for _ in range(2))
        rows.append((i, f"s{i % 50}", text.encode().decode("cp1252", "ignore") if i % 50 == 7 and i % 3 else text, ""))
    model, own = encoding.learn(spark.createDataFrame(rows, DOCS))
    entries = {r.source: {e.b: e.n for e in r.own if e.kind == "channel"} for r in own.collect()}
    assert len(entries) == 50 and entries["s7"] and not any(v for s, v in entries.items() if s != "s7")
    model.meet("s7", [e.asDict() for e in own.where("source = 's7'").first().own])
    assert model.log_share("s7", "utf_8>cp1252") > model.log_share("s8", "utf_8>cp1252")
