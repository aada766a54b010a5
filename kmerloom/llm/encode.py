"""Encoding with a public byte-level BPE tokenizer, cut at forced boundaries."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread

TOKENIZERS = "/opt/tokenizers"
#: Fragments whose ids a task remembers.
CACHE = 200_000
#: Characters that are cut at a time.
SLICE = 1 << 20

_space = np.array([c.isspace() or bool(re.match(r"\s", c)) for c in map(chr, range(0x3002))])


def byte_pairs(vocabulary: Iterator[bytes]) -> np.ndarray:
    """256 x 256 booleans: whether a byte pair occurs inside a token."""
    inside = np.zeros((256, 256), bool)
    for token in vocabulary:
        b = np.frombuffer(token, np.uint8)
        inside[b[:-1], b[1:]] = True
    return inside


def forced_cuts(text: str, inside: np.ndarray) -> np.ndarray:
    """Character offsets at which ``text`` may be cut without changing its ids.

    No token spans a byte pair that occurs inside none. The pattern that splits text before the merges must not
    notice the cut either: it looks ahead only behind white space, and only an apostrophe opens one of its special
    forms, so a cut never follows white space nor precedes an apostrophe. Everything else in the pattern is a run
    of one class of characters, which breaks or is continued at a cut just as without it.
    """
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    x, y = c[:-1], c[1:]
    last = np.where(x < 0x80, x, 0x80 | (x & 0x3F))
    first = np.where(y < 0x80, y, np.where(y < 0x800, 0xC0 | (y >> 6), np.where(y < 0x10000, 0xE0 | (y >> 12), 0xF0 | (y >> 18))))
    return np.flatnonzero(~inside[last, first] & ~_space[np.minimum(x, 0x3001)] & (y != ord("'"))) + 1


class Encoder:
    """Encodes texts by their fragments; made once in each task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        to_byte = {c: b for b, c in _byte_alphabet().items()}
        self.inside = byte_pairs(bytes(to_byte[c] for c in token) for token in self.tokenizer.get_vocab(with_added_tokens=False) if all(c in to_byte for c in token))
        self.known: dict[str, list[int]] = {}

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        parts: list[list[str]] = []
        group: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            if len(t) > SLICE or size > SLICE:
                parts += self._together(group)
                group, size = [], 0
            if len(t) > SLICE:
                parts.append(self.fragments(t))
            else:
                group.append(t)
                size += len(t)
        parts += self._together(group)
        if len(self.known) > CACHE:
            self.known = {}
        new = list({f for p in parts for f in p if f not in self.known})
        for f, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
            self.known[f] = e.ids
        known = self.known
        return [[i for f in p for i in known[f]] for p in parts]

    def _together(self, texts: list[str]) -> list[list[str]]:
        """Fragments of each of several texts, cut in one go."""
        joined, ends = "".join(texts), np.cumsum([0, *map(len, texts)])
        if not joined:
            return [[] for _ in texts]
        cuts = np.unique(np.concatenate([forced_cuts(joined, self.inside), ends]))
        at = np.searchsorted(cuts, ends).tolist()
        cuts = cuts.tolist()
        pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
        return [pieces[a:b] for a, b in zip(at, at[1:])]

    def fragments(self, text: str) -> list[str]:
        """Fragments of a text of any length, a slice at a time."""
        out, tail = [], ""
        for at in range(0, len(text), SLICE):
            part = tail + text[at : at + SLICE]
            cuts = [0, *forced_cuts(part, self.inside).tolist(), len(part)]
            out += [part[a:b] for a, b in zip(cuts[:-2], cuts[1:-1])]
            tail = part[cuts[-2] :]  # its end is the end of a slice, not a cut
        return [*out, tail]


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def encode(df: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(<id>, ids)``: one row for each row, the ids of its text without special tokens.

    Null and empty texts give an empty list, never null; repeated rows are encoded each; an empty table gives no
    rows. The text is taken as stored, strings of special tokens included. ``folder`` holds the vocabulary files
    on every executor; only byte-level vocabularies (``.json``) are cut correctly.
    """
    path = os.path.join(folder, f"{vocabulary}.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                ids = encoder.ids(some.column(1).to_pylist())
                yield pa.record_batch([some.column(0), pa.array(ids, pa.list_(pa.int32()))], [id, "ids"])

    kind = df.schema[id].dataType.simpleString()
    return spread(df.select(id, text)).mapInArrow(run, f"`{id}` {kind}, ids array<int>")
