"""Overlaps as equal keys: every end of a read meets every beginning of the same letters.

The end of one read overlaps the beginning of another by ``n`` letters if both have one key ``(n, h, g)``. Keys are
polynomial hashes of 64 and 31 bits, so that all beginnings or ends of a read take time and space in proportion to its
length, no sequence is shuffled, and a join needs no candidates that fail. Only ends whose first k-mer begins a read, and
beginnings whose last k-mer ends one, leave their task (see ``sieve``). Beginnings are added up by key before they are
joined; however many reads share one, it is a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sieve import mixed, passes, sieves

#: Letters whose ends are made at a time.
SLICE = 1 << 18
#: Fixed values of the hashes: base and inverse modulo 2^64, base and inverse modulo the prime.
BASE, PRIME, SMALL = 0x9E3779B97F4A7C15, (1 << 31) - 1, 1_103_515_245
INVERSE, SMALL_INVERSE = pow(BASE, -1, 1 << 64), pow(SMALL, -1, PRIME)

#: Two bits of a letter, as a code; 4 for others.
_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = range(4)

_letter = np.random.default_rng(5).integers(1, 1 << 62, 256).astype(np.uint64) | np.uint64(1)


def _powers(base: int, n: int, prime: int | None = None) -> np.ndarray:
    """The first ``n`` powers of ``base``, by doubling."""
    out, size = np.ones(max(n, 1), np.uint64), 1
    while size < n:
        step = np.uint64(pow(base, size, prime or 1 << 64))
        part = out[: min(size, n - size)] * step
        out[size : size + len(part)] = part % np.uint64(prime) if prime else part
        size *= 2
    return out


def _text(seqs: list[str]) -> tuple[np.ndarray, ...]:
    """``(letters as bytes, first, size)`` of joined sequences."""
    text = np.frombuffer("".join(seqs).encode("latin_1", "replace"), np.uint8)
    size = np.array([len(s) for s in seqs], np.int64)
    return text, size.cumsum() - size, size


def _wide(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(sums, inverse, place)``: running sums of the 64-bit hash, inverse powers, and the place of each letter in its sequence."""
    longest, place = int(size.max(initial=0)), np.arange(len(text)) - np.repeat(first, size)
    sums = np.concatenate([[np.uint64(0)], (_letter[text] * _powers(BASE, longest)[place]).cumsum(dtype=np.uint64)])
    return sums, _powers(INVERSE, longest), place


def kmer_hashes(seqs: list[str], k: int) -> tuple[np.ndarray, ...]:
    """``(row, pos, x)`` of all k-mers of the sequences; ``x`` is a mixed hash."""
    text, first, size = _text(seqs)
    sums, inverse, _ = _wide(text, first, size)
    many = np.maximum(size - k + 1, 0)
    row = np.repeat(np.arange(len(seqs)), many)
    pos = np.arange(len(row)) - np.repeat(many.cumsum() - many, many)
    at = first[row] + pos
    return row, pos, mixed((sums[at + k] - sums[at]) * inverse[pos])


def sliced(seqs: list[str]) -> Iterator[slice]:
    """Slices of about SLICE letters."""
    at = 0
    while at < len(seqs):
        stop, letters = at, 0
        while stop < len(seqs) and (letters == 0 or letters + len(seqs[stop]) <= SLICE):
            letters += len(seqs[stop])
            stop += 1
        yield slice(at, stop)
        at = stop


def _hashed(seqs: list[str], k: int, ends: bool, words: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """``(row, n, h, g, next letter)`` of all beginnings of ``k`` to ``length - 1`` letters, or of all such ends; of those only that ``words`` let through."""
    text, first, size = _text(seqs)
    wide, inverse, place = _wide(text, first, size)
    longest, prime = int(size.max(initial=0)), np.uint64(PRIME)
    many = np.maximum(size - k, 0)
    row = np.repeat(np.arange(len(seqs)), many)
    n = k + np.arange(len(row)) - np.repeat(many.cumsum() - many, many)
    if words is not None:  # an end goes on with its first k-mer, a beginning with its last
        pos = size[row] - n if ends else n - k
        at = first[row] + pos
        able = passes(words, mixed((wide[at + k] - wide[at]) * inverse[pos]))
        row, n = row[able], n[able]
    narrow = np.concatenate([[np.uint64(0)], (_letter[text] % prime * _powers(SMALL, longest, PRIME)[place] % prime).cumsum(dtype=np.uint64)])
    begin = first[row]
    if not ends:
        return row, n, wide[begin + n] - wide[begin], (narrow[begin + n] - narrow[begin]) % prime, text[begin + n]
    stop, skip = begin + size[row], size[row] - n
    h = (wide[stop] - wide[stop - n]) * inverse[skip]
    g = (narrow[stop] - narrow[stop - n]) % prime * _powers(SMALL_INVERSE, longest, PRIME)[skip] % prime
    return row, n, h, g, np.zeros(len(row), np.uint8)


def _made(rows: DataFrame, k: int, ends: bool, kept: str, sieve=None) -> DataFrame:
    names = ["node", kept, "n", "h", "g", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sieve.value if sieve is not None else None
        for batch in batches:
            nodes, others, seqs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for s in sliced(seqs):
                row, n, h, g, base = _hashed(seqs[s], k, ends, words)
                columns = nodes[s][row], others[s][row], n.astype(np.int32), h.view(np.int64), g.astype(np.int32), base.astype(np.int16)
                yield pa.record_batch([pa.array(c) for c in columns], names)

    return rows.select("node", kept, "seq").mapInArrow(run, f"node bigint, {kept} bigint, n int, h bigint, g int, base smallint")


def end_sieves(rows: DataFrame, k: int) -> tuple:
    """Sieves of the first and of the last k-mers of ``rows`` that are longer: all that ends, and beginnings, can meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(0).to_pylist()
            for s in sliced(seqs):
                for kind, part in enumerate(([q[:k] for q in seqs[s]], [q[-k:] for q in seqs[s]])):
                    x = np.unique(kmer_hashes(part, k)[2]).view(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(x), kind, np.int32)), pa.array(x)], ["kind", "x"])

    return tuple(sieves(rows.where(F.length("seq") > k).select("seq").mapInArrow(run, "kind int, x bigint"), 2))


def beginnings(rows: DataFrame, k: int, sieve=None) -> DataFrame:
    """``(node, occr, n, h, g, base)``: the beginnings of ``k`` letters or more that leave a next one, ``base``, its code.

    ``rows`` are ``(node bigint, occr bigint, seq)``, without nulls. A ``sieve`` of last k-mers leaves out what no end can meet.
    """
    return _made(rows, k, False, "occr", sieve)


def tails(rows: DataFrame, k: int, sieve=None) -> DataFrame:
    """``(node, n, h, g)``: the ends of ``k`` letters or more that are shorter than the read; a ``sieve`` of first k-mers leaves out what no beginning can meet."""
    return _made(rows.withColumn("occr", F.lit(0).cast("bigint")), k, True, "occr", sieve).select("node", "n", "h", "g")


def _planes(text: np.ndarray, at: np.ndarray, size: np.ndarray, words: int) -> list[np.ndarray]:
    """``[fit, low 0, high 0, mask 0, low 1 ...]``: the first ``64 * words`` letters from ``at``, no more than ``size`` of them, as two bits and a
    set bit of the mask each. ``fit`` is how many of them stand before one that isn't A, C, G or T, whose bits are those of A."""
    code = _CODE[text]
    i, shift, out = at >> 6, (at & 63).astype(np.uint64), []
    odd = np.append(np.flatnonzero(code > 3), len(text) + 64 * words)
    out.append(np.minimum(odd[odd.searchsorted(at)] - at, 64 * words).astype(np.int32))
    bits = [np.concatenate([np.packbits(p, bitorder="little"), np.zeros(8 * words + 16, np.uint8)]) for p in (code & 1, code >> 1 & 1)]
    low, high = (b[: len(b) // 8 * 8].view(np.uint64) for b in bits)
    for j in range(words):
        left = np.clip(size - 64 * j, 0, 64).astype(np.uint64)
        mask = np.where(left > 63, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
        for plane in (low, high):
            out.append(((plane[i + j] >> shift | plane[i + j + 1] << np.uint64(1) << (np.uint64(63) - shift)) & mask).view(np.int64))
        out.append(mask.view(np.int64))
    return out


def plane_names(side: str, words: int) -> list[str]:
    return [f"{side}{i}" for i in range(3 * words)]


def first_keys(rows: DataFrame, k: int, words: int = 0, most: int | None = None, sieve=None) -> DataFrame:
    """``rows`` with ``x``, the mixed hash of the first ``k`` letters of ``oriented``, beside it; none is shorter. With ``words``, also its
    first ``64 * words`` letters, or ``most`` of them, as bits (``r0``, ``r1`` ...; see ``_planes``), and ``r_fit``. A ``sieve`` leaves out rows by ``x``."""
    kept, made = rows.columns, ["x", *(["r_fit", *plane_names("r", words)] if words else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.column(len(kept)).to_pylist()
            for s in sliced(heads):
                text, first, size = _text(heads[s])
                x = kmer_hashes([q[:k] for q in heads[s]], k)[2]
                columns = [x.view(np.int64), *(_planes(text, first, np.minimum(size, most or size), words) if words else [])]
                own = batch.slice(s.start, s.stop - s.start)
                made_rows = pa.record_batch([*own.columns[: len(kept)], *map(pa.array, columns)], [*kept, *made])
                yield made_rows if sieve is None else made_rows.filter(pa.array(passes(sieve.value, x)))

    fields = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {'int' if c == 'r_fit' else 'bigint'} not null" for c in made])
    return rows.select(*kept, F.substring("oriented", 1, max(k, 64 * words)).alias("_head")).mapInArrow(run, fields)


def word_keys(queries: DataFrame, k: int, less: int, sieve, words: int = 0, most: int | None = None, several=None) -> DataFrame:
    """``(query_id, offset, x)``: the k-mers of ``(query_id, seq)`` that the sieve lets through, to the offset ``length - less``. With ``words``,
    also ``rest``, the number of letters from there, and as in ``first_keys`` their bits (``q0``, ``q1`` ..., ``q_fit``).
    Where the queries are the reads, a sieve of the first k-mers of ``several`` rows leaves out those that only begin their own read."""
    made = ["rest", "q_fit", *plane_names("q", words)] if words else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shared = sieve.value, several.value if several is not None else None
        for batch in batches:
            seqs = batch.column(1).to_pylist()
            for s in sliced(seqs):
                row, pos, x = kmer_hashes(seqs[s], k)
                text, first, size = _text(seqs[s])
                able = (pos <= size[row] - less) & passes(known, x)
                if shared is not None:
                    own = np.array(["N" not in q for q in seqs[s]], bool)
                    able &= (pos > 0) | ~own[row] | passes(shared, x)
                able = np.flatnonzero(able)
                row, pos = row[able], pos[able]
                ids, rest = batch.column(0).take(pa.array(row + s.start)), size[row] - pos
                columns = [pos.astype(np.int32), x[able].view(np.int64), *([rest.astype(np.int32), *_planes(text, first[row] + pos, np.minimum(rest, most or rest), words)] if words else [])]
                yield pa.record_batch([ids, *map(pa.array, columns)], ["query_id", "offset", "x", *made])

    kind = queries.schema["query_id"].dataType.simpleString()
    fields = ", ".join([f"query_id {kind}", "offset int not null", "x bigint not null", *(f"{c} {'int' if i < 2 else 'bigint'} not null" for i, c in enumerate(made))])
    return queries.select("query_id", "seq").where(F.col("seq").isNotNull()).mapInArrow(run, fields)


def same_read(a: Column, b: Column) -> Column:
    """Whether two nodes are strands of one read."""
    return F.shiftright(a, 1) == F.shiftright(b, 1)
