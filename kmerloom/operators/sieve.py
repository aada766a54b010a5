"""Sieves of k-mers: bitmaps of bounded size that tell which k-mers can meet at all.

Most ends, beginnings and words of a read set meet nothing. A sieve of the k-mers of one side lets the tasks of the other leave these
out before a shuffle. It never leaves out what meets; beyond its size it only lets more through, so no result depends on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Bits for each key.
BITS = 16
#: Logarithms of the parts of a sieve, and of the most words of 64 bits in a part (64 MB in all).
PARTS, LARGEST = 7, 16
#: Multipliers that mix a hash.
MIX, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with all bits mixed into all."""
    h = (h ^ (h >> np.uint64(30))) * MIX
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def _mask(x: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    return (one << (x & low)) | (one << ((x >> np.uint64(6)) & low)) | (one << ((x >> np.uint64(12)) & low))


def passes(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether mixed hashes may be among the keys of a sieve."""
    mask = _mask(x)
    return words[(x >> np.uint64(65 - len(words).bit_length())).astype(np.int64)] & mask == mask


def sieves(keys: DataFrame, kinds: int = 1) -> list:
    """Broadcast sieves, one for each ``kind`` from 0, of ``keys`` ``(kind int, x bigint)`` of mixed hashes.

    Keys go to the tasks that make a part each, in as many words as its keys ask for; the driver gets the parts of one task at a time
    and brings them to one size, at which a smaller part repeats its words.
    """
    ship(keys.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            part, x = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            order = part.argsort(kind="stable")
            begins = np.flatnonzero(np.diff(part[order], prepend=-1))
            for key, own in zip(part[order][begins], np.split(x[order], begins[1:])):
                held.setdefault(int(key), []).append(own)
        for key, several in held.items():
            x = np.unique(np.concatenate(several))
            size = min(LARGEST, max(0, math.ceil(math.log2(len(x) * BITS / 64))))
            words = np.zeros(1 << size, np.uint64)
            np.bitwise_or.at(words, (x << np.uint64(PARTS) >> np.uint64(1) >> np.uint64(63 - size)).astype(np.int64), _mask(x))
            yield pa.record_batch([pa.array([key], pa.int32()), pa.array([words.tobytes()], pa.binary())], ["part", "words"])

    part = F.shiftrightunsigned("x", 64 - PARTS).cast("int") + F.col("kind") * (1 << PARTS)
    found: dict[int, np.ndarray] = {}
    for row in keys.select(part.alias("part"), "x").repartition("part").mapInArrow(run, "part int, words binary").toLocalIterator():
        found[row["part"]] = np.frombuffer(row["words"], np.uint64)
    out = []
    for kind in range(kinds):
        parts = [found.pop(p, np.zeros(1, np.uint64)) for p in range(kind << PARTS, (kind + 1) << PARTS)]
        most = max(map(len, parts))
        out.append(keys.sparkSession.sparkContext.broadcast(np.concatenate([np.repeat(w, most // len(w)) for w in parts])))
    return out
