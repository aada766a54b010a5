"""Per-key results that a few dominant keys cannot hold up.

Everything here relies on two facts. Algebraic aggregates are combined in bounded hash maps inside
each map task, which spill mergeable states, so a key that owns a third of all rows reaches the
shuffle as one small state per task. And at most ``1/share`` keys can each own that share of the
rows, so the set of dominant keys has a proven size bound and may be broadcast.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: A key is called hot when it owns more than one row in this many; there are at most as many.
HOT_KEYS = 1000
#: Lookup rows of hot keys that are broadcast at most, and the parts into which a hot key is cut beyond that.
BROADCAST_ROWS, SALTS = 1_000_000, 64


def entry_totals(df: DataFrame, key: str, entries: Column, lowest: Column) -> DataFrame:
    """Number of list entries and the lowest value of each key, a null key being a key as well.

    ``entries`` counts what one row holds and ``lowest`` is the least value in the row, both computed
    inside the row, so that long lists are never exploded. Rows without entries count zero; keys all
    of whose rows are empty give ``n_entries`` 0 and a null ``low``. An empty table gives no rows.
    """
    return df.groupBy(F.col(key).alias("key")).agg(
        F.sum(entries.cast("bigint")).alias("n_entries"), F.min(lowest).alias("low")
    )


def dominant_keys(totals: DataFrame, share: float) -> DataFrame:
    """Non-null keys that own at least ``share`` of all entries, those of null keys included.

    The total comes from the same shuffled states (the exchange is reused), not from another scan.
    """
    owned = totals.where(F.col("low").isNotNull())
    total = owned.agg(F.sum("n_entries").alias("total")).scalar()
    # one condition over key and total, so that it stays above the aggregate and the exchange is shared
    return owned.where(F.when(F.col("key").isNotNull(), F.col("n_entries")) >= total * F.lit(Decimal(str(share))))


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that own more than one row in ``HOT_KEYS``, with their number of rows; fewer than HOT_KEYS rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.where(F.col("n_rows") * HOT_KEYS > total).where(F.col("n_rows") > HOT_KEYS)


def attach(rows: DataFrame, lookup: DataFrame, key: str, probe: DataFrame | None = None) -> DataFrame:
    """Inner join of many rows to a lookup by ``key``, safe against hot keys in ``rows``.

    ``lookup`` may hold several rows for a key. Rows of hot keys (fewer than HOT_KEYS keys, proven by ``hot_keys``) meet a broadcast of the
    lookup rows of those keys while these are at most BROADCAST_ROWS; beyond that they are salted, and the lookup rows copied to
    each salt. All other rows are joined by a shuffle in which no key owns more than one row in HOT_KEYS. Null keys join nothing.
    Hot keys may be looked for in a ``probe`` of the rows instead, which saves a pass; the result is the same whatever it holds.
    """
    hot = checkpoint(hot_keys(rows if probe is None else probe, key).select(key))
    if hot.isEmpty():
        return rows.join(lookup, key)
    wanted = lookup.join(F.broadcast(hot), key, "left_semi")
    held = rows.join(F.broadcast(hot), key, "left_semi")
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = held.join(F.broadcast(wanted), key)
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = held.withColumn("_salt", F.floor(F.rand(3) * SALTS).cast("int")).join(wanted.withColumn("_salt", salts), [key, "_salt"]).drop("_salt")
    return met.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(lookup, key))
