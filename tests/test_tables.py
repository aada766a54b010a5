"""Sources, sinks, states, hot keys and the registered queries."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kmerloom.operators import contigs as C
from kmerloom.operators import hot_keys, search, state
from kmerloom.session import numbered
from kmerloom.sources import fastx, profiles
from kmerloom.streaming import arriving, progress


def write_fasta(path, n, rng):
    records = [(f"r{i} extra", "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 200)))) for i in range(n)]
    with open(path, "w") as f:
        for name, seq in records:
            f.write(f">{name}\n" + "".join(seq[p : p + 60] + "\n" for p in range(0, len(seq), 60)))
    return records


@pytest.mark.parametrize("split", [37, 200, 1 << 20])
def test_fasta_ranges(spark, tmp_path, split):
    records = write_fasta(tmp_path / "a.fa", 60, random.Random(split))
    got = fastx.read_fastx(spark, str(tmp_path / "a.fa"), split_bytes=split).orderBy("read_id").collect()
    assert [(r.header, r.seq) for r in got] == records and [r.name for r in got] == [h.split()[0] for h, _ in records]


@pytest.mark.parametrize("split", [41, 1 << 20])
def test_fastq_ranges(spark, tmp_path, split):
    rng = random.Random(split)
    records = [(f"q{i}", "".join(rng.choice("ACGT") for _ in range(30)), "".join(rng.choice("@+I#") for _ in range(30))) for i in range(50)]
    (tmp_path / "a.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records))
    got = fastx.read_fastx(spark, str(tmp_path), split_bytes=split).orderBy("read_id").collect()
    assert [(r.name, r.seq, r.qual) for r in got] == records
    assert fastx.is_fastq(str(tmp_path / "a.fq"))


def test_fasta_edges(spark, tmp_path):
    (tmp_path / "e.fa").write_text(">a,b\r\nac gt\r\n>empty\n>c\nNNxx")
    (tmp_path / "none.fa").write_text("")
    (tmp_path / "list").write_text(f"{tmp_path}/e.fa\n{tmp_path}/none.fa")
    got = fastx.load_reads(spark, fastx.paths_in(spark, str(tmp_path / "list"))).orderBy("read_id").collect()
    assert [(r.name, r.seq) for r in got] == [("a", "ACGT"), ("empty", ""), ("c", "NNNN")]
    more = fastx.with_row(fastx.load_small(spark, str(tmp_path / "e.fa")), "new", "AC GT")
    assert more.count() == 4 and more.orderBy("read_id").collect()[-1].seq == "ACGT"
    assert fastx.with_row(more, "given", "A", 5).where("read_id = 5").count() == 1
    with pytest.raises(Exception, match="missing"):
        fastx.read_fastx(spark, str(tmp_path / "missing.fa")).count()


def test_commas_in_paths(spark, tmp_path):
    (tmp_path / "a,b.fa").write_text(">x\nAC\n")
    (tmp_path / "c.fq").write_text("@y\nGT\n+\n@@\n")
    got = fastx.read_fastx(spark, [str(tmp_path / "a,b.fa"), str(tmp_path / "c.fq")]).orderBy("read_id").collect()
    assert [(r.name, r.seq, r.qual) for r in got] == [("x", "AC", None), ("y", "GT", "@@")]


def test_text_of_records(spark):
    df = spark.createDataFrame([("junk\n>a b\r\nAC GT\r\nN\n>empty\n>c\tdetail\nTT",), (None,), ("",), (">only",)], "value string")
    assert sorted((r.name, r.seq) for r in fastx.parse_text(df).collect()) == [("a b", "ACGTN"), ("c", "TT"), ("empty", ""), ("only", "")]


def test_a_database_of_many_partitions(spark, tmp_path):
    data = [(o, f"c{o:02}", c, float(o * 64 + c)) for o in range(12) for c in range(64)]
    df = spark.createDataFrame(data, "class_ord int, class string, code bigint, w double")
    profiles.write_db(df.repartition(5), 3, str(tmp_path / "db"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        assert spark.read.text(str(tmp_path / "db")).rdd.getNumPartitions() > 4
        back, k = profiles.read_db(spark, str(tmp_path / "db"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert k == 3 and [(r["class"], r.code, r.w) for r in back.orderBy("class_ord", "code").collect()] == [d[1:] for d in data]


def test_profile_database(spark, tmp_path, rows):
    data = [(o, f"c{o}", c, float(c) if c % 2 else c / 7) for o in range(2) for c in range(64)]
    df = spark.createDataFrame(data, "class_ord int, class string, code bigint, w double")
    profiles.write_db(df, 3, str(tmp_path / "db"))
    back, k = profiles.read_db(spark, str(tmp_path / "db"))
    assert k == 3 and back.groupBy("class").count().count() == 2
    assert max(abs(a.w - b[3]) for a, b in zip(back.orderBy("class", "code").collect(), data)) < 1e-5
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "db")).collect())
    assert text.startswith("%WORD_LENGTH:3") and ":1:0.28571:3:" in text


def test_training_table(spark, tmp_path, rows):
    (tmp_path / "a.fa").write_text(">x\nACGT\n")
    (tmp_path / "b.fa").write_text(">y\nGG\n>z\nCC\n")
    (tmp_path / "t").write_text(f"one\t{tmp_path}/a.fa\n\ntwo  {tmp_path}/b.fa\n")
    got = rows(profiles.training_sequences(spark, profiles.read_training(spark, str(tmp_path / "t"))))
    assert got == [(0, "one", "ACGT"), (1, "two", "CC"), (1, "two", "GG")]


def test_contig_files(spark, tmp_path):
    df = spark.createDataFrame([("c1", 700, 2.25, 0.5, 40.0, "s", "A" * 700), ("c2", 10, None, None, None, None, None)], "contig_id string, len int, cov double, stdev double, gc double, seed string, seq string")
    C.write_table(df, str(tmp_path / "t"))
    C.write_table(df, str(tmp_path / "t"), append=True)
    assert spark.read.text(str(tmp_path / "t")).count() == 4
    lines = {r.value.split("\t")[0]: r.value.split("\t")[1:6] for r in C.as_table(df).collect()}
    assert lines["c1"] in (["700", "2.3", "0.5", "40.0", "s"], ["700", "2.2", "0.5", "40.0", "s"]) and lines["c2"] == ["10", "", "", "", ""]
    C.write_tiers(df, str(tmp_path / "tiers"))
    assert [r.tier for r in spark.read.parquet(str(tmp_path / "tiers")).collect()] == ["medium"]
    C.write_fasta(df, str(tmp_path / "f"))
    back = C.from_fasta(fastx.read_fastx(spark, str(tmp_path / "f"), name_stop="header").select("header", "seq"))
    assert [(r.contig_id, r.len) for r in back.collect()] == [("c1", 700)]


def test_used_state(spark, tmp_path, rows):
    reads = spark.createDataFrame([(i, i % 2, i % 3) for i in range(9)], "read_id bigint, file_ord int, flag int")
    state.store_used(reads.where("flag = 2"), str(tmp_path / "used"))
    assert {r.read_id for r in state.restore_used(reads, str(tmp_path / "used")).collect()} == {0, 1, 3, 4, 6, 7}
    with pytest.raises(ValueError, match="other reads"):
        state.restore_used(reads.where("read_id < 5"), str(tmp_path / "used"))
    assert rows(state.next_seeds(reads)) == [(0, 0), (1, 3)] and tuple(state.fullest(reads).first()) == (0, 2)
    assert tuple(state.depleted(reads.limit(0)).first()) == (0, 0, None)


def test_search(spark):
    reads = spark.createDataFrame([(1, "a", "ATGAAAGTTCTGTGGCATTATGAACGT"), (2, "n", "NNNNNNNNNNNN"), (3, None, "")], "read_id bigint, name string, seq string")
    prof = spark.createDataFrame([(7, "p", "MKVLWHYERAAA"), (8, "q", "KVLWHYER")], "profile_id bigint, profile string, pseq string")
    (hit,) = search.candidates(reads, prof, 4).where("frame = 1").collect()
    assert (hit.read_id, hit.pos, hit.profile_id, hit.suffix) == (1, 0, 7, "MKVLWHYERAAA")
    assert search.candidates(reads, prof, 4, None).where("frame = 1").count() == 9
    found = search.hits(reads, prof, 4, 10.0)
    assert {k: v.count() for k, v in search.outputs(found).items()} == dict.fromkeys(("candidates", "focus", "matches"), 1)


@pytest.mark.parametrize("parts", [1, 9])
def test_numbering(spark, parts):
    df = spark.range(500).selectExpr("id * 7 % 500 AS x", "id").repartition(parts)
    assert [(r.x, r.i) for r in numbered(df, "x").orderBy("i").collect()] == [(i, i) for i in range(500)]
    assert numbered(df.limit(0), "x").count() == 0


def test_hot_keys(spark, rows, monkeypatch):
    df = spark.createDataFrame([("h", i) for i in range(5000)] + [(f"k{i}", i) for i in range(50)] + [(None, 1), (None, 2)], "k string, v bigint")
    look = spark.createDataFrame([("h", "H"), ("k1", "one"), ("k1", "uno"), ("zz", "-")], "k string, name string")
    assert rows(hot_keys.hot_keys(df, "k")) == [("h", 5000)]
    assert rows(hot_keys.attach(df, look, "k")) == rows(df.join(look, "k").select("k", "v", "name"))
    assert rows(hot_keys.attach(df.limit(0), look, "k")) == []
    monkeypatch.setattr(hot_keys, "BROADCAST_ROWS", 0)  # hot lookup rows are copied to salts
    many = look.unionByName(spark.createDataFrame([("h", "H2"), (None, "-")], look.schema))
    assert rows(hot_keys.attach(df, many, "k").select("k", "v", "name")) == rows(df.join(many, "k").select("k", "v", "name"))


def test_dominant_keys(spark, rows):
    df = spark.createDataFrame([("a", [3, 5]), ("a", None), ("a", []), ("b", [1] * 8), (None, [0] * 90), ("c", None), ("", [2])], "k string, o array<bigint>")
    totals = hot_keys.entry_totals(df, "k", F.greatest(F.coalesce(F.size("o"), F.lit(0)), F.lit(0)), F.array_min("o"))
    assert rows(totals) == sorted([("a", 2, 3), ("b", 8, 1), (None, 90, 0), ("c", 0, None), ("", 1, 2)], key=repr)
    assert rows(hot_keys.dominant_keys(totals, 0.02).select("key")) == [("b",)]
    assert rows(hot_keys.dominant_keys(totals.limit(0), 0.01)) == []


def test_stream_equals_batch(spark, tmp_path, rows):
    df = spark.createDataFrame([(i % 3, "ACGT" * i, i % 2 * 2) for i in range(20)], "file_ord int, seq string, flag int")
    for half in (df.where("file_ord = 0"), df.where("file_ord > 0")):
        half.write.mode("append").parquet(str(tmp_path / "in"))
    q = progress(arriving(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("seen")) == rows(progress(df))


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


DUCK = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9"))))
def test_sql(spark, name):
    import glob
    import os

    d = entry.SMOKE_DIR
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = DUCK.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, d)
    r = con.sql(entry.oracle_sql()[name])
    cols = list(r.columns)
    assert sorted(cols) == sorted(df.columns)
    clean = lambda row: tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in row)
    assert sorted(map(clean, df.select(*cols).collect()), key=repr) == sorted(map(clean, r.fetchall()), key=repr)
