"""Translated search: six frames against a protein set by seed, alignment and score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import alignment_bits
from ..functions.sequence import CODON_ORDER, GENETIC_CODE, translate_dna
from ..session import stored
from .ends import sliced
from .kmers import offsets, six_frames, slide
from .sieve import mixed, passes, sieves

#: Profile k-mers that are broadcast at most; beyond it the join is a shuffle.
BROADCAST_KMERS = 1_000_000


#: Amino acid of each codon, and digit of each letter; 4 is none.
_amino = np.frombuffer(GENETIC_CODE.encode(), np.uint8)
_digit = np.full(256, 4, np.int64)
_digit[list(CODON_ORDER.encode())] = range(4)
_turn = np.arange(256, dtype=np.uint8)
_turn[list(b"ACGT")] = list(b"TGCA")


def _words(letters: np.ndarray, k: int, step: int) -> np.ndarray:
    """Mixed hash of ``k`` letters, ``step`` apart, from each place on that has them; equal words have equal hashes."""
    n = max(len(letters) - step * (k - 1), 0)
    low, x = (letters & 31).astype(np.uint64), np.zeros(n, np.uint64)
    for t in range(k if n else 0):
        x = x * np.uint64(37) + low[step * t : step * t + n]
    return mixed(x)


def _slid(seqs: list[str], k: int) -> tuple[np.ndarray, ...]:
    """``(row, pos, x)`` of all k-mers of the texts; ``x`` is a mixed hash."""
    size = np.array([len(q) for q in seqs], np.int64)
    x = _words(np.frombuffer("".join(seqs).encode("latin_1", "replace"), np.uint8), k, 1)
    row = np.repeat(np.arange(len(seqs)), size)[: len(x)]
    pos = np.arange(len(x)) - (size.cumsum() - size)[row]
    inside = pos + k <= size[row]
    return row[inside], pos[inside], x[inside]


def _seeds(seqs: list[str], k: int, words: np.ndarray, first: bool) -> tuple[np.ndarray, ...]:
    """``(row, frame, pos, kmer)`` of the words of the six frames that the sieve lets through, but for the last of each frame; the ``first`` of a frame or all."""
    size = np.array([len(s) for s in seqs], np.int64)
    begin, found = size.cumsum() - size, []
    text = np.frombuffer("".join(seqs).encode("latin_1", "replace"), np.uint8)
    row = np.repeat(np.arange(len(seqs)), size)
    for turned in (0, 1):
        if turned:  # each sequence reversed in its place
            text = _turn[text[(2 * begin + size - 1)[row] - np.arange(len(text))]]
        d = _digit[text]
        if len(d) < 3 * k:
            continue
        codon = np.where((d[:-2] | d[1:-1] | d[2:]) < 4, 16 * d[:-2] + 4 * d[1:-1] + d[2:], -1)
        place = np.arange(len(codon)) - begin[row[: len(codon)]]
        limit = np.maximum(size[:, None] - np.arange(3), 0) // 3  # codons of each frame, ended by the first with N
        bad = np.flatnonzero((codon < 0) & (place + 3 <= size[row[: len(codon)]]))
        np.minimum.at(limit, (row[bad], place[bad] % 3), place[bad] // 3)
        amino = _amino[codon]
        x = _words(amino, k, 3)
        own, at = row[: len(x)], place[: len(x)]
        able = np.flatnonzero((at // 3 + k + 1 <= limit[own, at % 3]) & passes(words, x))
        r, frame, pos = own[able], at[able] % 3 + 1 + 3 * turned, at[able] // 3
        if first:
            order = np.lexsort((pos, frame, r))
            keep = order[np.flatnonzero(np.diff((r * 6 + frame)[order], prepend=-1))]
            able, r, frame, pos = able[keep], r[keep], frame[keep], pos[keep]
        found.append((r, frame, pos, amino[able[:, None] + 3 * np.arange(k)]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, k), np.uint8)
    return tuple(np.concatenate(c) for c in zip(*found))


def _seed_rows(reads: DataFrame, k: int, sieve, first: bool) -> DataFrame:
    """``(read_id, frame, pos, kmer)`` of ``(read_id, seq)`` reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sieve.value
        for batch in batches:
            seqs = batch.column(1).to_pylist()
            for s in sliced(seqs):
                row, frame, pos, kmer = _seeds(seqs[s], k, words, first)
                text = pa.Array.from_buffers(pa.string(), len(row), [None, pa.py_buffer(np.arange(0, len(row) * k + 1, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(kmer))])
                yield pa.record_batch([batch.column(0).take(pa.array(row + s.start)), pa.array(frame.astype(np.int32)), pa.array(pos.astype(np.int32)), text], ["read_id", "frame", "pos", "kmer"])

    kind = reads.schema["read_id"].dataType.simpleString()
    return reads.select("read_id", "seq").where(F.col("seq").isNotNull()).mapInArrow(run, f"read_id {kind}, frame int, pos int, kmer string")


def _keys(rows: DataFrame, column: str, k: int) -> DataFrame:
    """``(kind, x)`` of all k-mers of a text column, for ``sieves``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(0).to_pylist()
            for s in sliced(seqs):
                x = np.unique(_slid(seqs[s], k)[2]).view(np.int64)
                yield pa.record_batch([pa.array(np.zeros(len(x), np.int32)), pa.array(x)], ["kind", "x"])

    return rows.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "kind int, x bigint")


def _posted(seeds: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """Seeds with ``profile_id`` and ``p_pos`` of the latest posting of their k-mer, null if no profile has it; only k-mers that a seed may have are posted."""
    (asked,) = sieves(_keys(seeds, "kmer", k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = asked.value
        for batch in batches:
            seqs = batch.column(1).to_pylist()
            for s in sliced(seqs):
                part = seqs[s]
                row, pos, x = _slid(part, k)
                able = passes(words, x)
                r, p = row[able], pos[able]
                yield pa.record_batch([batch.column(0).take(pa.array(r + s.start)), pa.array(p.astype(np.int32)), pa.array([part[i][j : j + k] for i, j in zip(r, p)], pa.string())], ["profile_id", "p_pos", "kmer"])

    kind = profiles.schema["profile_id"].dataType.simpleString()
    index = profiles.select("profile_id", "pseq").where(F.col("pseq").isNotNull()).mapInArrow(run, f"profile_id {kind}, p_pos int, kmer string")
    latest = index.groupBy("kmer").agg(F.max(F.struct("profile_id", "p_pos")).alias("p")).select("kmer", "p.*")
    return seeds.join(latest, "kmer", "left").withColumn("met", F.col("p_pos").isNotNull())


def _first_hits(reads: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """``candidates`` with one hit a frame: the first word of each frame that a sieve of the profiles lets through meets the postings; frames in
    which no profile has it are looked at again as a whole. Texts are fetched by the ids, which are unique, in the end."""
    (known,) = sieves(_keys(profiles, "pseq", k))
    tried = stored(_posted(stored(_seed_rows(reads, k, known, True)), profiles, k))
    missed = tried.where("not met").select("read_id", "frame")
    again = stored(_seed_rows(reads.join(missed.select("read_id").distinct(), "read_id", "left_semi"), k, known, False).join(missed, ["read_id", "frame"], "left_semi"))
    rest = _posted(again, profiles, k).where("met").groupBy("read_id", "frame").agg(F.min(F.struct("pos", "kmer", "profile_id", "p_pos")).alias("h")).select("read_id", "frame", "h.*")
    found = tried.where("met").select(rest.columns).unionByName(rest)
    texts = profiles.select("profile_id", "profile", "pseq")
    placed = found.join(texts, "profile_id").withColumn("suffix", F.substr("pseq", F.col("p_pos") + 1, F.length("pseq")))
    aa = F.coalesce(*[F.when(F.col("frame") == f, translate_dna(F.col("seq"), f)) for f in range(1, 7)])
    return placed.join(reads.select("read_id", "name", "seq"), "read_id").withColumn("aa", aa)


def candidates(reads: DataFrame, profiles: DataFrame, k: int, max_hits_per_frame: int | None = 1) -> DataFrame:
    """``(read_id, name, seq, frame, aa, kmer, pos, profile_id, profile, suffix)``: seeds of reads in profiles.

    In each frame the first k-mer that a profile has, the last k-mer of the frame not being looked at (X6); of several
    postings the latest profile, then its latest place. ``suffix`` is the profile from that place on. With
    ``max_hits_per_frame`` None every seed comes out. ``profiles`` has ``(profile_id, profile, pseq)``.
    """
    columns = ["read_id", "name", "seq", "frame", "aa", "kmer", "pos", "profile_id", "profile", "suffix"]
    if max_hits_per_frame == 1:
        return _first_hits(reads, profiles, k).select(*columns)
    index = slide(profiles.withColumnRenamed("pseq", "seq"), k).select(
        "profile_id", "profile", "kmer", F.col("pos").alias("p_pos"), F.substr("seq", F.col("pos") + 1, F.length("seq")).alias("suffix")
    )
    small = index.limit(BROADCAST_KMERS + 1).count() <= BROADCAST_KMERS
    frames = six_frames(reads)
    seeds = frames.select("*", F.explode(offsets(F.length("aa") - k - 1)).alias("pos")).withColumn("kmer", F.substr("aa", F.col("pos") + 1, F.lit(k)))
    hits = seeds.join(F.broadcast(index) if small else index, "kmer")
    if max_hits_per_frame is not None:
        first = Window.partitionBy("read_id", "frame").orderBy("pos", F.desc("profile_id"), F.desc("p_pos"))
        hits = hits.withColumn("n", F.row_number().over(first)).where(F.col("n") <= max_hits_per_frame)
    return hits.select(*columns)


def hits(reads: DataFrame, profiles: DataFrame, k: int = 8, cutoff: float = 50.0, max_hits_per_frame: int | None = 1) -> DataFrame:
    """Candidates whose alignment of the frame with the profile's suffix scores more than ``cutoff`` bits.

    Pairs whose letters cannot score as much are not aligned.
    """
    found = candidates(reads, profiles, k, max_hits_per_frame)
    return found.withColumn("bits", alignment_bits("simple", cutoff)("aa", "suffix")).where(F.col("bits") > cutoff)


def outputs(found: DataFrame) -> dict[str, DataFrame]:
    """The three text projections of hits: candidate proteins, their reads, and the match table.

    Fixed values: the forms of the three lines.
    """
    return {
        "candidates": found.select(F.format_string(">%s | frame %d | kmer %s | score %.2f\n%s", "name", "frame", "kmer", "bits", "aa").alias("value")),
        "focus": found.select(F.format_string(">%s\n%s", "name", "seq").alias("value")),
        "matches": found.select(F.format_string("%s\t%s\t%.2f\t%d\t%s", "name", "profile", "bits", "frame", "kmer").alias("value")),
    }
