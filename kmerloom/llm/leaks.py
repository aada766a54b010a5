"""Evaluation texts inside training text: a broadcast set of word n-grams, verified and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hot_keys import attach
from ..session import checkpoint, spread

WORD = r"[\p{L}\p{N}]+"
#: n-grams that are broadcast at most; a larger set is joined by a shuffle.
BROADCAST_GRAMS = 1_000_000


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, each in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.lower(w))


def windows(items: Column, n: int) -> Column:
    """All runs of ``n`` consecutive elements of an array; none if it is shorter or null."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, n))


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """``(item_id, gram, h)``: the distinct n-grams of each test item."""
    return (
        items.select(F.col("item_id").cast("bigint").alias("item_id"), words(F.col("text")).alias("w"))
        .select("item_id", F.explode(windows(F.col("w"), n)).alias("gram"))
        .distinct().withColumn("h", F.xxhash64(F.transform("gram", lambda x: F.xxhash64(x))))
    )


def hits(documents: DataFrame, items: DataFrame, n: int = 12) -> DataFrame:
    """``(doc_id, at, item_id)``: each window of ``n`` words of a document that occurs in an item; ``at`` counts words.

    Windows travel as ``(doc_id, at, h)``, a hash of their words' hashes, and only while the n-grams of the items don't fit
    BROADCAST_GRAMS do they travel at all; then hot windows are spread (``attach``). The text of a document is fetched and split once more
    if some hash agrees, and all its candidates are compared with it word by word. Null and empty texts and items of fewer
    words hit nothing; repeated rows hit alike.
    """
    grams = item_grams(items, n)
    few = grams.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    rows = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    hashed = rows.select("doc_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("hs"))
    placed = hashed.select("doc_id", F.posexplode(F.transform(windows(F.col("hs"), n), lambda x: F.xxhash64(x))).alias("at", "h"))
    met = placed.join(F.broadcast(grams), "h") if few else attach(placed, grams, "h")
    # candidates of one document are as many as its windows, times the items that share them
    candidates = checkpoint(met.select("doc_id", F.struct(F.col("at").cast("bigint").alias("at"), "item_id", "gram").alias("c")).groupBy("doc_id").agg(F.collect_set("c").alias("cs")))
    split = rows.join(candidates.select("doc_id"), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    same = F.filter("cs", lambda c: F.slice("w", (c["at"] + 1).cast("int"), n) == c["gram"])
    return candidates.join(split, "doc_id").select("doc_id", F.inline(same)).select("doc_id", "at", "item_id").distinct()


def leaks(documents: DataFrame, items: DataFrame, n: int = 12) -> DataFrame:
    """``(doc_id, item_id)``: the documents that hold a window of an item, each pair once."""
    return hits(documents, items, n).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, n: int = 12, remove: str = "documents") -> DataFrame:
    """The documents without what leaked, other columns as they were.

    ``documents`` drops each document with a hit. ``spans`` keeps it and drops the words of all hits from its
    ``text``, together with what stands between and directly after them. Documents are known by ``doc_id``; rows
    that repeat it are treated alike.
    """
    found = hits(documents, items, n)
    if remove == "documents":
        return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(documents.columns)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    starts = checkpoint(found.groupBy(F.col("doc_id").alias("leak_doc")).agg(F.array_sort(F.collect_set("at")).alias("leak_at")))
    rows = documents.select(F.col("doc_id").alias("leak_doc"), F.col("text").alias("t"), F.struct(*documents.columns).alias("d"))  # columns of any name
    whole = rows.join(starts, "leak_doc", "left_anti").select("d.*")
    parts = F.regexp_extract_all("t", F.lit(rf"^[^\p{{L}}\p{{N}}]+|{WORD}[^\p{{L}}\p{{N}}]*"), 0)
    lead = F.when(F.col("t").rlike(r"^[^\p{L}\p{N}]"), 1).otherwise(0)
    hit = rows.join(starts.select("leak_doc"), "leak_doc", "left_semi").select("leak_doc", "d", parts.alias("leak_parts"), lead.cast("bigint").alias("leak_lead"))
    both = hit.join(starts, "leak_doc")
    # windows that touch make one gap; what stands between two gaps is kept as it is, so each part is looked at once
    first = F.filter("leak_at", lambda x, i: (i == 0) | (x > F.get("leak_at", i - 1) + n))
    last = F.filter("leak_at", lambda x, i: (i == F.size("leak_at") - 1) | (F.get("leak_at", i + 1) > x + n))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(last, lambda x: x + n + F.col("leak_lead")))
    begins = F.concat(F.transform(first, lambda x: x + F.col("leak_lead")), F.array(F.size("leak_parts").cast("bigint")))
    kept = F.zip_with(ends, begins, lambda e, b: F.array_join(F.slice("leak_parts", (e + 1).cast("int"), F.greatest(b - e, F.lit(0)).cast("int")), ""))
    cut = both.select(F.col("d").withField("text", F.array_join(kept, "")).alias("d")).select("d.*")
    return whole.unionByName(cut)
