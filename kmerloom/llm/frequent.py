"""Most frequent values by exact refinement of hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Groups that one round may hold: the memory of the operator, whatever the number of distinct values.
MAX_GROUPS = 1 << 16
#: Bits that a round adds while more prefixes than that survive.
STEP = 8


def frequent_items(df: DataFrame, value: str, weight: str | None = None, k: int = 20, max_groups: int = MAX_GROUPS) -> DataFrame:
    """The ``k`` values with the largest total weight, as ``(item, total)``; totals are exact.

    Each round sums the weights by a prefix of the value's 64-bit hash. The sum of a prefix is an upper
    bound for each value in it. A prefix gives a lower bound as well: its sum if it holds one value only
    (least and greatest hash agree), else the largest weight of one row. Values of different prefixes
    differ, so the k-th largest lower bound is one for the k-th total, and prefixes below it are dropped.
    To raise that bound early, the heaviest prefixes are looked at with more bits before the others are
    judged. The rest get longer until each holds a single value, or about so (an eighth of the possible prefixes
    at most are taken); then the full values of those that can still be among the first are counted.

    A round has at most about ``max_groups`` groups while weights let it; survivors are broadcast only within
    that bound. Where weights are too flat for it, refinement goes on in the same way with survivors joined by a shuffle, until each
    prefix holds a single value; groups are then kept in tables that spill, and only ``k`` values are counted in full.

    Null values and rows of null or zero weight add nothing; a value without weight is not frequent, so
    fewer than ``k`` rows may come out (none for an empty table). Negative weights raise ValueError.
    Ties at the last place go to the lesser value. The empty string is a value.
    """
    w = F.coalesce(F.col(weight), F.lit(0)) if weight else F.lit(1).cast("bigint")
    rows = df.where(F.col(value).isNotNull()).select(
        F.col(value).alias("item"), F.xxhash64(value).alias("h"), F.hash(value).alias("h2"), w.alias("weight")
    ).where(F.col("weight") != 0)
    bits, kept, kept_bits, small = max_groups.bit_length() - 1, None, 0, True

    pure = (F.col("h_lo") == F.col("h_hi")) & (F.col("h2_lo") == F.col("h2_hi"))

    def within(prefixes: DataFrame, length: int, few: bool) -> DataFrame:
        side = prefixes.select(F.col("prefix").alias("kept_prefix"))
        return rows.join(F.broadcast(side) if few else side, _prefix(length) == F.col("kept_prefix"), "left_semi")

    def counted(part: DataFrame, length: int) -> DataFrame:
        return checkpoint(
            part.groupBy(_prefix(length).alias("prefix")).agg(
                F.sum("weight").alias("total"), F.max("weight").alias("most"), F.min("weight").alias("least"),
                F.min("h").alias("h_lo"), F.max("h").alias("h_hi"), F.min("h2").alias("h2_lo"), F.max("h2").alias("h2_hi"),
            )
        )

    def kth_bound(groups: DataFrame) -> float:
        lower = groups.select(F.when(pure, F.col("total")).otherwise(F.col("most")).alias("b")).orderBy(F.desc("b")).limit(k)
        low, n = lower.agg(F.min("b"), F.count("b")).first()
        return low if n == k else 0

    while True:
        groups = counted(rows if kept is None else within(kept, kept_bits, small), bits)
        bound = kth_bound(groups)
        n_groups = groups.count()
        sparse = kept is not None and n_groups * 8 <= n_kept << (bits - kept_bits)  # about one value in each
        leaders = groups.orderBy(F.desc("total"), "prefix").limit(4 * k)
        deeper = min(64, bits + max(1, (max_groups // (4 * k)).bit_length() - 1))
        if bits < 64 and not sparse and leaders.where(~pure).count():
            bound = max(bound, kth_bound(counted(within(leaders, bits, True), deeper)))
        stays = (F.col("total") >= F.lit(bound)) & (F.col("total") > 0)
        kept, kept_bits = groups.where(stays), bits
        n_kept, mixed, least = groups.agg(F.count_if(stays), F.max(F.when(stays, ~pure)), F.min("least")).first()
        if least is not None and least < 0:
            raise ValueError("weights must not be negative")
        small = n_kept <= max_groups
        if not mixed or bits == 64 or (sparse and small):
            break
        bits = min(64, bits + (max(4, (max_groups // n_kept).bit_length() - 1) if small else STEP))
    if not mixed:  # totals are known, ties kept
        last = kept.orderBy(F.desc("total")).limit(k).agg(F.min("total")).first()[0]
        kept = checkpoint(kept.where(F.col("total") >= (last or 0)))
        small = kept.limit(max_groups + 1).count() <= max_groups
    totals = within(kept, kept_bits, small).groupBy("item").agg(F.sum("weight").alias("total"))
    return totals.where(F.col("total") > 0).orderBy(F.desc("total"), "item").limit(k)


def _prefix(bits: int):
    return F.shiftrightunsigned("h", 64 - bits) if bits < 64 else F.col("h")
