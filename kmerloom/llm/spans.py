"""Long exact spans shared between sequences, by relative Lempel-Ziv parsing.

Every sequence is factored greedily against indexed reference blocks of the other sequences. Only factors of the wanted
length count, so a block is indexed by its windows of that length. Which blocks can matter is known beforehand: a window of the wanted length that occurs twice has the same
minimizer in both places, so a block holds the stretches around one minimizer, and a sequence is parsed
against the blocks of its own minimizers only. Blocks that would grow too large are split by longer
minimizers, at last by the window itself; no block is ever paired with itself row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hot_keys import HOT_KEYS, attach
from ..session import checkpoint

#: Stretches that one reference block may hold before it is split by longer minimizers.
BLOCK_ROWS = 4096
#: Windows that one stretch may span, so that long low-complexity runs are cut into bounded rows.
STRETCH_WINDOWS = 256
#: Characters of a long sequence that are hashed at a time.
SLICE = 1 << 20

STRETCH = "anchor bigint, doc bigint, off bigint, single boolean, txt string"
OUT = "doc bigint, beg bigint, fin bigint, single boolean, txt string"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_anchors(codes: np.ndarray, k: int, span: int) -> np.ndarray:
    """Least mixed hash of the ``k``-mers of each window of ``span`` characters (polynomial hashes by doubling)."""
    power, size = {1: 0x9E3779B97F4A7C15}, 1
    by_size = {1: codes.astype(np.uint64) + np.uint64(1)}
    while size * 2 <= k:
        h = by_size[size]
        by_size[size * 2] = h[:-size] * np.uint64(power[size]) + h[size:]
        power[size * 2] = power[size] ** 2 % (1 << 64)
        size *= 2
    done, h = size, by_size[size]
    for part in sorted(by_size, reverse=True):
        if done + part <= k:
            n = len(codes) - done - part + 1
            h = h[:n] * np.uint64(power[part]) + by_size[part][done : done + n]
            done += part
    h = _mix(h)
    width, reach = span - k + 1, 1
    while reach * 2 <= width:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    if reach < width:
        h = np.minimum(h[: len(h) - (width - reach)], h[width - reach :])
    return h


def stretches(texts: list[str], k: int, span: int) -> Iterator[tuple[int, int, int, np.uint64]]:
    """``(row, begin, end, anchor)``: runs of windows with one anchor, at most STRETCH_WINDOWS of them."""
    long = [i for i, t in enumerate(texts) if len(t) > SLICE]
    at = 0
    while at < len(texts):  # texts of about SLICE characters are hashed together
        rows, size = [], 0
        while at < len(texts) and size < SLICE:
            if span <= len(texts[at]) <= SLICE:
                rows.append(at)
                size += len(texts[at])
            at += 1
        if rows:
            lens = np.array([len(texts[i]) for i in rows])
            yield from _runs("".join(texts[i] for i in rows), np.repeat(rows, lens), np.concatenate([np.arange(n) for n in lens]), np.repeat(lens, lens), k, span)
    for i in long:
        for b in range(0, len(texts[i]) - span + 1, SLICE):
            part = texts[i][b : b + SLICE + span - 1]
            n = len(part)
            yield from _runs(part, np.full(n, i), np.arange(b, b + n), np.full(n, b + n), k, span)


def _runs(text: str, row: np.ndarray, pos: np.ndarray, end: np.ndarray, k: int, span: int) -> Iterator[tuple[int, int, int, np.uint64]]:
    anchors = window_anchors(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), k, span)
    n = len(anchors)
    ok = np.flatnonzero(pos[:n] + span <= end[:n])
    a, r, p = anchors[ok], row[ok], pos[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(ok)))
    for s, length in zip(starts.tolist(), runs.tolist()):
        for o in range(0, length, STRETCH_WINDOWS):
            b = int(p[s]) + o
            yield int(r[s]), b, b + min(STRETCH_WINDOWS, length - o) - 1 + span, a[s]


def _emit(k: int, span: int):
    """Rows of the input as stretches with their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, off, single, txt = (batch.column(i).to_pylist() for i in range(4))
            found = list(stretches(txt, k, span))
            yield pa.record_batch(
                [
                    pa.array(np.array([f[3] for f in found], np.uint64).view(np.int64)), pa.array([doc[f[0]] for f in found], pa.int64()),
                    pa.array([off[f[0]] + f[1] for f in found], pa.int64()), pa.array([single[f[0]] for f in found], pa.bool_()), pa.array([txt[f[0]][f[1] : f[2]] for f in found], pa.string()),
                ],
                ["anchor", "doc", "off", "single", "txt"],
            )

    return run


def _count(k: int, span: int):
    """Stretches by anchor, already added up within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = np.array([a for _, _, _, a in stretches(batch.column(0).to_pylist(), k, span)], np.uint64).view(np.int64)
            values, counts = np.unique(anchors, return_counts=True)
            yield pa.record_batch([pa.array(values), pa.array(counts.astype(np.int64))], ["anchor", "n"])

    return run


class Block:
    """One reference block: a hash index of all windows of its stretches, made once."""

    def __init__(self, rows: list[tuple[int, int, bool, str]], span: int):
        self.span, self.owner = span, {}
        claim = self.owner.setdefault
        for doc, _, _, text in rows:
            for i in range(len(text) - span + 1):
                window = text[i : i + span]
                if claim(window, doc) != doc:
                    self.owner[window] = None  # several documents

    def factors(self, text: str) -> Iterator[tuple[int, int]]:
        """Parse the text of a stretch of this block: maximal factors of at least ``span`` characters that occur elsewhere.

        A factor begins with a window that another document has and goes on for as long as the next window is one as well; all
        beginnings are looked up, so none hides across the boundary of two factors. What lies between is literal.
        """
        at, stop = 0, len(text) - self.span + 1
        while at < stop:
            if self.owner[text[at : at + self.span]] is None:
                begin = at
                while at + 1 < stop and self.owner[text[at + 1 : at + 1 + self.span]] is None:
                    at += 1
                yield begin, at + self.span
            at += 1


def _factor(span: int, block_rows: int):
    """Parse each anchor's stretches against each other; those of an anchor that outgrows a block are handed on."""

    def parse(rows: list[tuple[int, int, bool, str]]) -> list[tuple]:
        if rows[0][0] == rows[-1][0]:  # sorted by document: a single one shares nothing
            return []
        block = Block(rows, span)
        return [(doc, off + b, off + e, True, None) for doc, off, single, t in rows if single for b, e in block.factors(t)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        doc, beg, fin, single, txt = zip(*rows) if rows else ([],) * 5
        return pa.record_batch(
            [pa.array(doc, pa.int64()), pa.array(beg, pa.int64()), pa.array(fin, pa.int64()), pa.array(single, pa.bool_()), pa.array(txt, pa.string())],
            ["doc", "beg", "fin", "single", "txt"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple[int, int, bool, str]] = []
        key, over = None, False
        for batch in batches:
            for anchor, doc, off, single, txt in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if anchor != key:
                    if held:
                        out += parse(held)
                    key, held, over = anchor, [], False
                if over:
                    out.append((doc, off, None, single, txt))
                    continue
                held.append((doc, off, single, txt))
                if len(held) > block_rows:
                    out += [(d, o, None, s, t) for d, o, s, t in held]
                    held, over = [], True
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        if held:
            out += parse(held)
        yield batch_of(out)

    return run


def shared_spans(df: DataFrame, span: int = 72, levels: tuple[int, ...] = (24, 48), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(read_id, beg_pos, end_pos)``: the maximal runs of positions that lie in a stretch of at least
    ``span`` characters which occurs verbatim in a row with another ``read_id``.

    Null, empty and shorter sequences share nothing; letter case counts. Sequences that are equal as a whole
    are one document to the parser, and each of their rows is shared from end to end; a row repeated under
    one ``read_id`` is not another row. An empty table gives no rows. ``levels`` are the minimizer
    lengths by which oversized blocks are split, before single windows are counted at last.
    """
    if not all(0 < k < span for k in levels):
        raise ValueError("minimizers must be shorter than the span")
    reads = df.select(F.col("read_id").cast("bigint").alias("read_id"), "seq").where((F.length("seq") >= span) & F.col("read_id").isNotNull())
    docs = checkpoint(
        reads.groupBy("seq").agg(F.min("read_id").alias("doc"), F.max("read_id").alias("last")).select(
            "doc", F.lit(0).cast("bigint").alias("off"), (F.col("doc") == F.col("last")).alias("single"), F.col("seq").alias("txt")
        )
    )
    work, spans = docs, None
    for k in levels:
        found, work = _level(work, k, span, block_rows)
        spans = found if spans is None else spans.unionByName(found)
        if work is None:
            break
    if work is not None:
        spans = spans.unionByName(_same_windows(work, span))
    begin = Window.partitionBy("doc").orderBy("beg", "fin")
    runs = (
        spans.distinct()
        .withColumn("reach", F.max("fin").over(begin.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("run", F.sum(F.when(F.col("beg") <= F.col("reach"), 0).otherwise(1)).over(begin))
        .groupBy("doc", "run").agg(F.min("beg").alias("beg_pos"), F.max("fin").alias("end_pos"))
        .select(F.col("doc").alias("read_id"), "beg_pos", "end_pos")
    )
    singles = docs.where("single").select(F.col("doc").alias("read_id"))
    copied = reads.join(singles, "read_id", "left_anti").select("read_id", F.lit(0).cast("bigint").alias("beg_pos"), F.length("seq").cast("bigint").alias("end_pos"))
    return runs.unionByName(copied.distinct())


def _level(work: DataFrame, k: int, span: int, block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Spans found in blocks of ``k``-mer minimizers, and the stretches whose blocks are too large."""
    counts = work.select("txt").mapInArrow(_count(k, span), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    hot = counts.where((F.col("n") * HOT_KEYS > total) & (F.col("n") > block_rows)).select("anchor").collect()  # fewer than HOT_KEYS
    pieces = work.select("doc", "off", "single", "txt").mapInArrow(_emit(k, span), STRETCH)
    normal, large = pieces, None
    if hot:
        hot = F.broadcast(work.sparkSession.createDataFrame(hot, "anchor bigint"))
        normal, large = pieces.join(hot, "anchor", "left_anti"), pieces.join(hot, "anchor", "left_semi")
    out = checkpoint(normal.repartition("anchor").sortWithinPartitions("anchor", "doc", "off").mapInArrow(_factor(span, block_rows), OUT))
    rest = out.where(F.col("fin").isNull()).select("doc", F.col("beg").alias("off"), "single", "txt")
    if large is not None:
        rest = rest.unionByName(large.select("doc", "off", "single", "txt"))
    elif rest.isEmpty():
        rest = None
    return out.where(F.col("fin").isNotNull()).select("doc", "beg", "fin"), None if rest is None else checkpoint(rest)


def _same_windows(work: DataFrame, span: int) -> DataFrame:
    """Windows of the remaining stretches that several documents have: one index in as many parts as the shuffle has, by hashes of 96 bits."""
    starts = F.transform(F.sequence(F.lit(0), F.length("txt") - span), lambda i: F.struct((F.col("off") + i).alias("beg"), F.substr("txt", i + 1, F.lit(span)).alias("txt")))
    windows = work.select("doc", "single", F.explode(starts).alias("w")).select("doc", "single", "w.beg", F.struct(F.xxhash64("w.txt").alias("a"), F.hash("w.txt").alias("b")).alias("key"))
    shared = windows.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key")
    return attach(windows.where("single"), shared, "key").select("doc", "beg", (F.col("beg") + span).alias("fin"))
