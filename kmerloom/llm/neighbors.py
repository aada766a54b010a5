"""Most similar vectors for every vector, by multi-probe p-stable hashing.

A table hashes a unit vector by ``m`` random projections, each cut into slots of one width. A query looks into
its own bucket and into those that the closest slot borders suggest, in the order of estimated success.
Candidates of all tables are merged, screened by sign sketches and reranked by their exact cosine.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hot_keys import attach
from ..session import checkpoint, spread

TABLES, WIDTH, SKETCH = 4, 1.4, 128
#: Vectors that a bucket may hold, whatever their number, before it is split by further projections of half the width; how often
#: at most, and hot buckets that are broadcast at most.
BUCKET_ROWS, LEVELS, BROADCAST_KEYS = 2048, 16, 100_000
#: Blocks over which the queries of a bucket that could not be split are spread.
BLOCKS = 32

#: Vectors of one block of the exact search.
BLOCK_ROWS = 2048

KEYS = "key bigint, id bigint, s1 bigint, s2 bigint"


def probe_sets(m: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks of the sorted border distances to cross, most promising first; the empty one leads.

    The square of the j-th least of 2m border distances has a known expectation; ranks j and 2m-1-j are the two
    borders of one slot and don't go together.
    """
    def cost(j: int) -> float:
        j, e = j + 1, 4 * (m + 1) * (m + 2)
        return j * (j + 1) / e if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / e

    heap, sets = [(cost(0), (0,))], [()]
    while heap and len(sets) < probes:
        total, ranks = heapq.heappop(heap)
        if not {2 * m - 1 - r for r in ranks} & set(ranks):
            sets.append(ranks)
        last = ranks[-1] + 1
        if last < 2 * m:
            heapq.heappush(heap, (total - cost(last - 1) + cost(last), (*ranks[:-1], last)))
            heapq.heappush(heap, (total + cost(last), (*ranks, last)))
    return sets


def _fold(key: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """One 64-bit key from a key and slot numbers."""
    h = key.astype(np.uint64)
    for i in range(slots.shape[1]):
        h = (h ^ slots[:, i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _keys(dim: int, m: int, level: int, sets: list[tuple[int, ...]], tables: int):
    """Bucket keys of vectors ``(id, unit, key)``: the buckets of all tables at level 0, else a finer one below ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = np.random.default_rng(7).normal(size=(dim, SKETCH))
        width = WIDTH / 2**level
        for batch in batches:
            n = batch.num_rows
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            sketch = np.packbits(x @ signs > 0, axis=1).view(np.int64)
            for t in range(tables if level == 0 else 1):
                rng = np.random.default_rng([11, level, t])
                y = x @ (rng.normal(size=(dim, m)) / width) + rng.uniform(0, 1, m)
                slot = np.floor(y)
                above = y - slot  # the borders: m below, then m above
                order = np.argsort(np.concatenate([above, 1 - above], axis=1), axis=1)
                parent = np.full(n, t) if level == 0 else batch.column(2).to_numpy()
                for ranks in sets:
                    near = slot.copy()
                    for r in ranks:
                        near[np.arange(n), order[:, r] % m] += np.where(order[:, r] < m, -1, 1)
                    yield pa.record_batch([pa.array(_fold(parent, near)), pa.array(ids), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["key", "id", "s1", "s2"])

    return run


def unit_vectors(df: DataFrame, id: str, vector: str, dim: int) -> DataFrame:
    """``(id, unit, cls)`` of usable vectors: ``dim`` numbers, none null or NaN, not all zero. Equal ``cls``: equal directions."""
    v = F.col("v")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    usable = df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
    unit = usable.withColumn("norm", norm).where((F.col("norm") > 0) & ~F.isnan("norm") & (F.col("norm") < float("inf"))).select(
        "id", F.transform("v", lambda x: x / F.col("norm")).alias("unit")
    )
    cls = F.sha2(F.concat_ws(",", F.transform("unit", lambda x: F.round(x * 1e9).cast("bigint").cast("string"))), 256)
    return unit.withColumn("cls", cls)


def nearest(df: DataFrame, id: str, vector: str, dim: int, k: int = 5, min_cosine: float = 0.9, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS, probes: int | None = None) -> DataFrame:
    """``(id, other, cosine, place)``: of every vector the ``k`` most similar others with at least ``min_cosine``.

    Ties go to the lower id. Unusable vectors (see ``unit_vectors``) take no part. Vectors of equal direction count
    as one in the index by their ``k + 1`` lowest ids, which is all that can ever be among ``k`` neighbours; the
    others find those directly. An empty table gives no rows. Pairs below ``min_cosine`` are not searched for:
    it sets the sketch screen, and the tables are laid out for close pairs.
    """
    vectors, index = _indexed(df, id, vector, dim, k)
    return _close(vectors, index, dim, k, min_cosine, tables, bucket_rows, probes)


def _indexed(df: DataFrame, id: str, vector: str, dim: int, k: int) -> tuple[DataFrame, DataFrame]:
    """All usable vectors, and of each direction the ``k + 1`` lowest ids."""
    vectors = checkpoint(unit_vectors(spread(df.select(id, vector)), id, vector, dim))
    ranked = vectors.withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("n") <= k + 1)
    return vectors, checkpoint(ranked.select("id", "unit", "cls", "n"))


def _close(vectors: DataFrame, index: DataFrame, dim: int, k: int, min_cosine: float, tables: int, bucket_rows: int, probes: int | None) -> DataFrame:
    rows = index.count()
    m = max(4, math.ceil(math.log2(max(rows, 2)) / 2))
    sets = probe_sets(m, probes or 2 * m)
    angle = math.acos(min_cosine) / math.pi
    far = math.ceil(SKETCH * angle + 3.5 * math.sqrt(SKETCH * angle * (1 - angle)))

    pairs, source = None, index.select("id", "unit", F.lit(0).cast("bigint").alias("key"))
    asked, kept = source, source
    for level in range(LEVELS + 1):
        homes = kept.mapInArrow(_keys(dim, m, level, sets[:1], tables), KEYS)
        visits = asked.mapInArrow(_keys(dim, m, level, sets, tables), KEYS)
        hot = None
        if level < LEVELS:
            sizes = homes.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            large = checkpoint(sizes.where(F.col("n") > bucket_rows).select("key"))
            if many := large.count():
                hot = F.broadcast(large) if many <= BROADCAST_KEYS else large
        if hot is not None:
            deep = [side.join(hot, "key", "left_semi").select("key", "id").distinct().join(index.select("id", "unit"), "id").select("id", "unit", "key") for side in (visits, homes)]
            homes, visits = homes.join(hot, "key", "left_anti"), visits.join(hot, "key", "left_anti")
        if level == LEVELS:  # vectors closer than any width: spread over blocks
            homes = homes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
            visits = visits.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int"))
        on = ["key"] if level < LEVELS else ["key", "block"]
        a, b = visits.alias("a"), homes.alias("b")
        match = F.col("a.id") != F.col("b.id")
        for c in on:
            match = match & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        distance = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))
        found = a.join(b, match & (distance <= far)).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))
        pairs = found if pairs is None else pairs.unionByName(found)
        if hot is None:
            break
        asked, kept = (checkpoint(side) for side in deep)

    dot = F.aggregate(F.zip_with("unit", "unit_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    once = (  # each pair once, whoever found it; the cosine serves both
        pairs.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
        .join(index.select("id", "unit"), "id")
        .join(index.select(F.col("id").alias("other"), F.col("unit").alias("unit_b")), "other")
        .select("id", "other", F.round(dot, 9).alias("cosine"))
        .where(F.col("cosine") >= min_cosine)
    )
    both = F.array(F.struct("id", "other"), F.struct(F.col("other").alias("id"), F.col("id").alias("other")))
    scored = once.select(F.inline(both), "cosine")
    low = index.where(F.col("n") <= k).select("cls", F.col("id").alias("other"))
    copies = vectors.join(index.select("id"), "id", "left_anti").select("id", "cls")
    scored = scored.unionByName(attach(copies, low, "cls").select("id", "other", F.lit(1.0).alias("cosine")))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def nearest_of_all(df: DataFrame, id: str, vector: str, dim: int, k: int = 5, min_cosine: float = 0.9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id, other, cosine, place)``: of every vector the ``k`` most similar others, however far they are.

    What has ``k`` neighbours of at least ``min_cosine`` gets those that ``nearest`` finds. Every other vector is compared
    with the whole index in blocks, which is exact and takes their number times that of the index.
    """
    vectors, index = _indexed(df, id, vector, dim, k)
    close = checkpoint(_close(vectors, index, dim, k, min_cosine, TABLES, BUCKET_ROWS, None))
    full = close.where(F.col("place") == k).select("id")
    open_ = index.join(full, "id", "left_anti")
    far = _blocks(open_, block_rows, "q").crossJoin(_blocks(index, block_rows, "r")).mapInArrow(_best(dim, k), "id bigint, other bigint, cosine double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    far = far.withColumn("place", place).where(F.col("place") <= k)
    return close.join(full, "id", "left_semi").unionByName(far)


def _blocks(rows: DataFrame, block_rows: int, name: str) -> DataFrame:
    """Rows of at most about ``block_rows`` ids and their vectors, end to end."""
    blocks = max(1, math.ceil(rows.count() / block_rows))
    lists = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("unit")).alias(f"{name}_units"))
    return checkpoint(lists.drop("block").repartition(blocks))  # few pairs of blocks in an Arrow batch


def _best(dim: int, k: int):
    """The ``k`` most similar rows of a block for each query of another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                q_ids, q, r_ids, r = (c[i].values.to_numpy(zero_copy_only=False) for c in columns)
                order = np.argsort(r_ids)  # ties go to the lower id
                r_ids, r = r_ids[order], r.reshape(-1, dim)[order]
                cosine = np.round(q.reshape(-1, dim) @ r.T, 9)
                cosine[q_ids[:, None] == r_ids[None, :]] = -np.inf
                n = min(k, len(r_ids))
                top = np.argsort(-cosine, axis=1, kind="stable")[:, :n]
                found = np.take_along_axis(cosine, top, axis=1).ravel()
                real = found > -np.inf
                columns_out = np.repeat(q_ids, n)[real], r_ids[top].ravel()[real], found[real]
                yield pa.record_batch([pa.array(c) for c in columns_out], ["id", "other", "cosine"])

    return run
