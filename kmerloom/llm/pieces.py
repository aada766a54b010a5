"""Cutting oversized sequences at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

SCHEMA = "contig_ord bigint, beg_pos bigint, end_pos bigint"


def atoms(length: int, ends: list[int], limit: int, overlap: int) -> list[int]:
    """Ends of the atomic segments: the natural boundaries, and cuts that no piece can do without.

    Boundaries within the overlap are left out, since the next piece could not advance. A segment that does not fit even with what it
    repeats of its predecessor is cut as late as it may be.
    """
    out, begin = [], 0
    for end in [*(e for e in ends if overlap < e < length), length]:
        while end - begin + (overlap if begin else 0) > limit:
            begin += limit - (overlap if begin else 0)
            out.append(begin)
        out.append(end)
        begin = end
    return out


def merged_pieces(length: int, ends: list[int], limit: int, overlap: int, strength: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Pieces of one text of ``length`` characters, given the ascending ends of its natural boundaries.

    Adjacent pieces wait in a heap under the strength of the boundary between them. The weakest boundary is taken
    first, wherever it is, and its two pieces are merged if their size, with the overlap that the left one repeats of its predecessor,
    fits ``limit``; otherwise it stays for good, as pieces only grow. ``strength`` gives that of natural boundaries (cuts have the least), ties going
    to the left; without it a boundary is stronger than all before it, which makes every piece as long as it can be from
    left to right.
    """
    cuts = atoms(length, ends, limit, overlap)
    left = dict(zip(cuts, [0, *cuts]))  # begin of the piece that ends here
    right = dict(zip(cuts, cuts[1:]))  # end of the piece that begins here
    heap = [(strength.get(e, 0) if strength else e, e) for e in cuts[:-1]]
    heapq.heapify(heap)
    while heap:
        _, at = heapq.heappop(heap)
        begin, end = left[at], right[at]
        if end - begin + (overlap if begin else 0) <= limit:
            left[end] = begin
            del left[at], right[at]
            if begin:
                right[begin] = end
    return [(begin - overlap if begin else 0, end) for end, begin in sorted(left.items())]


def split_oversized(df: DataFrame, limit: int = 2000, overlap: int = 50, gap: int = 10, keep: str = "position") -> DataFrame:
    """``(contig_ord, beg_pos, end_pos)`` of the pieces of every ``seq`` longer than ``limit``.

    Natural boundaries are the ends of gaps, maximal runs of at least ``gap`` characters other than
    A, C, G, T in either case. ``keep``: ``position`` makes pieces as long as they can be from left to right, ``gap`` keeps the longest
    gaps as boundaries. Null, empty and short sequences give no pieces; rows are independent, so
    repeated rows give repeated pieces; a null ``contig_ord`` is kept. Only oversized rows reach Python.
    """
    if keep not in ("position", "gap"):
        raise ValueError("keep is 'position' or 'gap'")
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    gaps = re.compile(f"[^ACGTacgt]{{{gap},}}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, begs, ends = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = {m.end(): len(m[0]) for m in gaps.finditer(text)}
                for b, e in merged_pieces(len(text), [*found], limit, overlap, found if keep == "gap" else None):
                    ords.append(key)
                    begs.append(b)
                    ends.append(e)
            yield pa.record_batch([pa.array(ords, pa.int64()), pa.array(begs, pa.int64()), pa.array(ends, pa.int64())], ["contig_ord", "beg_pos", "end_pos"])

    rows = df.select(F.col("contig_ord").cast("bigint"), "seq")
    return spread(rows).where(F.length("seq") > limit).mapInArrow(cut, SCHEMA)
