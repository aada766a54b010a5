"""Duplicates hidden by formatting: radix partitioning on canonical bytes, counted in tries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Rows that a radix bucket may hold, whatever the number of rows, and oversized buckets that are broadcast at most.
BUCKET_ROWS, BROADCAST_LEADS = 20_000, 100_000
#: Leading bytes of the first round; each further round doubles them.
FIRST_BYTES = 4
#: Bytes on an edge of the trie.
EDGE = 16

#: The five named fields of a record header.
FIELDS = ["seed", "id", "len", "cov", "gc"]


def header_field(header: Column, name: str) -> Column:
    """Value of a named field, in lower case and without whitespace and punctuation; empty if there is none.

    A name counts where other characters than letters and digits stand around it; the value ends before the
    next name. The first of repeated names counts.
    """
    names = "|".join(FIELDS)
    sep = r"[^\p{L}\p{N}]"
    value = F.regexp_extract(F.lower(header), rf"(?:^|{sep}){name}{sep}+(.*?)(?={sep}+(?:{names})(?:{sep}|$)|{sep}*$)", 1)
    return F.regexp_replace(value, sep, "")


def canonical(header: Column, seq: Column) -> Column:
    """Canonical text of a record, the same for all its notations; null where ``seq`` is null.

    Five field values, then the letters of the sequence in lower case. Records without all five fields are
    the same only if stored unchanged.
    """
    values = [header_field(header, f) for f in FIELDS]
    whole = values[0] != ""
    for v in values[1:]:
        whole = whole & (v != "")
    letters = F.lower(F.regexp_replace(seq, r"\P{L}", ""))
    raw = F.concat_ws("\u0001", F.lit(""), F.coalesce(F.concat(F.lit("h"), header), F.lit("")), seq)
    return F.when(seq.isNotNull(), F.when(whole, F.concat_ws("|", *values, letters)).otherwise(raw))


class Trie:
    """Counts texts; a lone tail hangs on one edge until another text shares its beginning."""

    def __init__(self):
        self.root: dict = {}

    def add(self, text: bytes, key: int) -> list:
        """The terminal of ``text``, ``[first key, count]``, after counting one more."""
        node, at = self.root, 0
        while True:
            edge = text[at : at + EDGE]
            at += EDGE
            child = node.get(edge)
            if child is None:
                node[edge] = (text[at:], terminal := [key, 1])
                return terminal
            if isinstance(child, tuple):
                tail, terminal = child
                if tail == text[at:]:
                    terminal[1] += 1
                    return terminal
                # an edge shorter than EDGE ends the text, so tails below one edge are not both empty
                node[edge] = child = {tail[:EDGE]: (tail[EDGE:], terminal)}
            node = child

    def terminals(self) -> Iterator[list]:
        nodes = [self.root]
        while nodes:
            for child in nodes.pop().values():
                if isinstance(child, dict):
                    nodes.append(child)
                else:
                    yield child[1]


def _count(copies: bool):
    """Count each bucket in a trie of its own: the copies with their first row, or the terminals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, trie = None, Trie()
        out: list[tuple[int, int]] = []

        def batch() -> pa.RecordBatch:
            a, b = zip(*out) if out else ((), ())
            out.clear()
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["keep_id", "n"])

        for rows in batches:
            for at, key, text in zip(*(rows.column(i).to_pylist() for i in range(3))):
                if at != bucket:
                    if not copies:
                        out.extend(map(tuple, trie.terminals()))
                    bucket, trie = at, Trie()
                keep, n = trie.add(text, key)
                if copies and n > 1:
                    out.append((keep, key))
            if len(out) > 5000:
                yield batch()
        if not copies:
            out.extend(map(tuple, trie.terminals()))
        yield batch()

    return run


def _partitioned(df: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their radix bucket, and the texts that fill more than a bucket by themselves.

    Canonical texts are made once. Rounds count leading bytes and split the oversized ones by twice as many, until each
    bucket holds ``bucket_rows`` at most; only what is still oversized goes into the next round. A bucket that is a single text
    can't be split; its count and least id are known from the round that finds it (terminal).
    """
    rows = df.where(F.col("seq").isNotNull())
    rest = checkpoint(rows.select(F.col("rec_id").cast("bigint").alias("rec_id"), F.encode(canonical(F.col("header"), F.col("seq")), "utf-8").alias("text")))
    placed, heavy, size = [], None, FIRST_BYTES
    while True:
        lead = F.substring("text", 1, size)
        counts = rest.groupBy(lead.alias("lead")).agg(
            F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("keep_id"),
            F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"), F.min(F.hash("text")).alias("c"), F.max(F.hash("text")).alias("d"),
        )
        one_text = (F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))
        over = checkpoint(counts.where(F.col("n") > bucket_rows).select("lead", "n", "keep_id", one_text.alias("single")))
        many, singles = over.agg(F.count(F.lit(1)), F.count_if("single")).first()
        if many == 0:
            placed.append(rest.select(lead.alias("bucket"), "rec_id", "text"))
            break
        side = F.broadcast if many <= BROADCAST_LEADS else lambda leads: leads
        placed.append(rest.join(side(over.select("lead")), lead == F.col("lead"), "left_anti").select(lead.alias("bucket"), "rec_id", "text"))
        if singles:
            one = rest.join(side(over.where("single")), lead == F.col("lead")).select("keep_id", "rec_id", "n")
            heavy = one if heavy is None else heavy.unionByName(one)
        if singles == many:
            break
        rest = checkpoint(rest.join(side(over.where("not single").select("lead")), lead == F.col("lead"), "left_semi"))
        size *= 2
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.repartition("bucket").sortWithinPartitions("bucket", "rec_id"), heavy


def copies(df: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(keep_id, rec_id)``: every row that repeats another in some notation, with the least id of its group.

    Rows with null ``seq`` repeat nothing; a null header, or one without the five fields, agrees only with the
    same one beside the same stored sequence. Empty sequences are equal. Rows repeated under one ``rec_id`` are one row.
    """
    placed, heavy = _partitioned(df.select("rec_id", "header", "seq"), bucket_rows)
    found = placed.mapInArrow(_count(copies=True), "keep_id bigint, n bigint").select("keep_id", F.col("n").alias("rec_id"))
    if heavy is not None:
        found = found.unionByName(heavy.select("keep_id", "rec_id"))
    return found.where("keep_id < rec_id").distinct()


def records(df: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(rec_id, n_copies)``: one row for each different record, by its least id, with the number of its rows.

    Each row with null ``seq`` is a record of its own. An empty table gives no rows.
    """
    rows = df.select("rec_id", "header", "seq")
    placed, heavy = _partitioned(rows, bucket_rows)
    found = placed.mapInArrow(_count(copies=False), "keep_id bigint, n bigint").select(F.col("keep_id").alias("rec_id"), F.col("n").alias("n_copies"))
    if heavy is not None:
        found = found.unionByName(heavy.where("rec_id = keep_id").select("rec_id", F.col("n").alias("n_copies")).distinct())
    return found.unionByName(rows.where(F.col("seq").isNull()).select(F.col("rec_id").cast("bigint").alias("rec_id"), F.lit(1).cast("bigint").alias("n_copies")))
