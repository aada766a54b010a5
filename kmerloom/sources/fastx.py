"""FASTA and FASTQ files as a Spark data source with record-aligned byte-range partitions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.sequence import upcase
from ..session import ship

SCHEMA = "file_ord int, pos bigint, header string, name string, seq string, qual string"
#: Characters that end a name, by option ``name_stop``.
NAME_STOPS = {"reads": " ,\t\r\n", "header": "\r\n", "strict": "(),: \t\r\n"}
BLOCK = 1 << 20


@dataclass
class Range(InputPartition):
    path: str
    file_ord: int
    start: int
    end: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(paths: list[str]) -> list[str]:
    """The files of the given paths in order, those of a folder by name."""
    found = []
    for path in paths:
        fs, inner = _open(path)
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.Directory:
            prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
            inside = [f.path for f in fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.type == pafs.FileType.File]
            found += [prefix + f for f in sorted(inside) if not f.rsplit("/", 1)[-1].startswith(("_", "."))]
        elif info.type == pafs.FileType.File:
            found.append(path)
        else:
            raise FileNotFoundError(path)
    return found


def is_fastq(path: str) -> bool:
    """Whether the first byte is '@' (S3)."""
    fs, inner = _open(path)
    with fs.open_input_stream(inner) as f:
        return f.read(1) == b"@"


def _lines(f: pa.NativeFile, start: int) -> Iterator[tuple[int, bytes]]:
    """Lines that begin at or after ``start``, with their offsets."""
    at = max(start - 1, 0)
    f.seek(at)
    rest, first = b"", start > 0
    while block := f.read(BLOCK):
        *whole, rest_ = (rest + block).split(b"\n")
        for line in whole:
            if not first:
                yield at, line
            first = False
            at += len(line) + 1
        rest = rest_
    if rest and not first:
        yield at, rest


def _cut(header: str, stop: str) -> str:
    ends = [i for c in stop if (i := header.find(c)) >= 0]
    return header[: min(ends)] if ends else header


def fasta_records(lines: Iterator[tuple[int, bytes]], end: int) -> Iterator[tuple[int, str, str, None]]:
    """Records whose '>' lies before ``end``; lines of a sequence are joined without white space."""
    pos, header, parts = None, "", []
    for at, line in lines:
        if line.startswith(b">"):
            if pos is not None:
                yield pos, header, "".join(parts), None
            pos = None
            if at >= end:
                return
            pos, header, parts = at, line[1:].decode("utf-8", "replace").rstrip("\r"), []
        elif pos is not None:
            parts.append("".join(line.decode("utf-8", "replace").split()))
    if pos is not None:
        yield pos, header, "".join(parts), None


def fastq_records(lines: Iterator[tuple[int, bytes]], end: int) -> Iterator[tuple[int, str, str, str]]:
    """Four-line records that begin before ``end``. A record begins where the line two below an '@' begins with '+';
    '@' alone may be a quality."""
    held: list[tuple[int, bytes]] = []
    for item in lines:
        held.append(item)
        if len(held) < 4:
            continue
        if held[0][1].startswith(b"@") and held[2][1].startswith(b"+"):
            if held[0][0] >= end:
                return
            head, seq, _, qual = (x.decode("utf-8", "replace").rstrip("\r") for _, x in held)
            yield held[0][0], head[1:], seq.strip(), qual
            held = []
        else:
            held.pop(0)


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        if not (options.get("paths") or options.get("path")):
            raise ValueError("give a path")
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]  # names may hold commas
        self.split = int(options.get("splitbytes", 64 << 20))
        self.stop = NAME_STOPS[options.get("name_stop", "reads")]

    def partitions(self) -> list[Range]:
        out = []
        for n, path in enumerate(files_of(self.paths)):
            fs, inner = _open(path)
            size = fs.get_file_info(inner).size
            out += [Range(path, n, b, min(b + self.split, size)) for b in range(0, size, self.split)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        columns = ["file_ord", "pos", "header", "name", "seq", "qual"]
        types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)

        if not part.path:
            return
        fs, inner = _open(part.path)
        with fs.open_input_file(inner) as f:
            rows = []
            records = (fastq_records if is_fastq(part.path) else fasta_records)(_lines(f, part.start), part.end)  # each task looks for itself
            for pos, header, seq, qual in records:
                rows.append((part.file_ord, pos, header, _cut(header, self.stop), seq, qual))
                if len(rows) >= 5000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


class Fastx(DataSource):
    """``spark.read.format('fastx').load(path)``; options ``splitbytes``, ``name_stop``, and ``paths``, a JSON list.

    A record belongs to the range that holds its first byte, so none is lost or read twice, however it is cut (S1, S2, S4).
    Records without a sequence give an empty one. Sequences have any length and come as stored.
    """

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader(self.options)


def read_fastx(spark: SparkSession, paths: str | list[str], name_stop: str = "reads", split_bytes: int = 64 << 20) -> DataFrame:
    """``(read_id, file_ord, name, header, seq, qual)`` of files or folders, sequences as stored.

    ``read_id`` follows the order of files and records without any shuffle.
    """
    ship(spark)
    spark.dataSource.register(Fastx)
    listed = [paths] if isinstance(paths, str) else paths
    rows = spark.read.format("fastx").option("name_stop", name_stop).option("splitbytes", split_bytes).option("paths", json.dumps(listed)).load()
    return rows.select((F.shiftleft(F.col("file_ord").cast("bigint"), 40) + F.col("pos")).alias("read_id"), "file_ord", "name", "header", "seq", "qual")


def load_reads(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Reads in A, C, G, T, N for the index."""
    return read_fastx(spark, paths, **options).withColumn("seq", upcase(F.col("seq")))


def load_small(spark: SparkSession, path: str, limit_bytes: int = 64 << 20) -> DataFrame:
    """A small file for every task, headers kept as names; beyond ``limit_bytes`` it is not marked for broadcast."""
    rows = read_fastx(spark, path, name_stop="header")
    size = sum(_open(f)[0].get_file_info(_open(f)[1]).size for f in files_of([path]))
    return F.broadcast(rows) if size <= limit_bytes else rows


def paths_in(spark: SparkSession, listing: str) -> list[str]:
    """White-space separated paths of a list file."""
    return [p for row in spark.read.text(listing).collect() for p in row.value.split()]


def parse_text(texts: DataFrame, column: str = "value") -> DataFrame:
    """``(name, seq)`` of the FASTA records in a text column, whole headers kept as names, white space taken out of sequences.

    What stands before the first '>' is no record; records without a sequence give an empty one.
    """
    marked = texts.select(F.explode(F.slice(F.split(F.concat(F.lit("\n"), F.col(column)), "\n>"), 2, 2147483647)).alias("r"))
    head = F.regexp_replace(F.substring_index("r", "\n", 1), "[\t\r].*$", "")
    body = F.when(F.col("r").contains("\n"), F.expr("substr(r, instr(r, '\n') + 1)")).otherwise("")
    return marked.select(head.alias("name"), F.regexp_replace(body, r"\s", "").alias("seq"))


def with_row(reads: DataFrame, name: str, seq: str, read_id: int | None = None) -> DataFrame:
    """One more read, white space taken out; its id follows the greatest one unless it is given."""
    one = reads.sparkSession.createDataFrame([(name, "".join(seq.split()))], "name string, seq string")
    given = F.lit(read_id).cast("bigint") if read_id is not None else reads.agg((F.coalesce(F.max("read_id"), F.lit(-1)) + 1).alias("n")).scalar()
    return reads.select("read_id", "name", "seq").unionByName(one.select(given.alias("read_id"), "name", "seq"))
