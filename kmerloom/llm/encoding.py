"""Text garbled by a wrong character encoding: found and restored by decipherment.

A garbled word is taken as enciphered by an unknown channel: its bytes were written in one code page and read
in another. For bytes of single letters that is a substitution cipher. Which letter each character stands for in a channel is learned
by expectation-maximization against the letter bigrams of the language, for all text and for each source, and so are
the shares of the channels in each source; known pairs of code pages are where the ciphers begin. The E-step weighs for each word what it
would be under each channel, and in a word of a channel what each character may stand for; the M-step re-estimates bigrams, shares and
substitution tables. The tables are applied by ``str.translate``.

Text in UTF-8 or an Asian encoding that was read as single bytes is no such cipher, since one letter is several characters. It is decoded
as what it is; its channels take part in the same estimates.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread

#: Code pages that text was written in or is read by.
READ_AS = ["latin_1", "cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "cp437", "cp850", "mac_roman", "cp1253"]
WRITTEN_IN = ["cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "cp437", "cp850", "mac_roman"]
#: Multi-byte encodings with the bytes of one character (of two bytes or more).
MULTI = {
    "utf_8": "[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}",
    "shift_jis": "(?:[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc])+",
    "euc_jp": "(?:[\xa1-\xf4][\xa1-\xfe])+",
}
ASIAN_READ_AS = ["latin_1", "cp1252"]

#: White space that parts words; within a word, other kinds may be garbled letters.
BLANK = "[ \\t\\n\\r\\f\\u000b]+"
#: Rounds of expectation-maximization at most, and the change of the channels' shares of words below which it ends.
ROUNDS, SETTLED = 4, 0.1
#: Log odds by which a restored word must beat the word as it is, the shares of the channels included: what is likelier is taken.
MARGIN = 0.0
#: Share of garbled words before anything is known, and the count with which it enters the estimates.
SHARE, WEIGHT = 0.02, 50.0
#: Share of the words of a damaged text that are damaged.
PASSED = 0.3
#: Passes over one word, for text that was garbled several times.
PASSES = 3
#: Count with which a code page's own letter enters a substitution table, and with which every other letter of the page does.
OWN_LETTER, OTHER_LETTER = 20.0, 0.02
#: Evidence that a source needs for a letter of its own.
EVIDENCE = 5.0
#: Verdicts that a task remembers; bigrams that a model keeps, the most frequent ones; sources whose shares are broadcast.
CACHE, PAIRS, BROADCAST_SOURCES = 200_000, 1_000_000, 10_000
#: Marks sums over one source, and those over all.
OF_SOURCE, COMMON = "s", "all"

SURE = re.compile("[\x80-\x9f�]")  # no correct text has these


@cache
def _page(name: str) -> list[str]:
    """The character of each byte; undefined bytes read as control characters."""
    return [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]


@cache
def _swap(read_as: str, written: str) -> dict[int, str]:
    """Where the cipher of two code pages begins."""
    return {ord(a): b for a, b in list(zip(_page(read_as), _page(written)))[0x80:] if a != b}


@cache
def _upper(read_as: str) -> frozenset:
    return frozenset(_page(read_as)[0x80:])


@cache
def _alphabet(written: str, upper: bool) -> tuple[str, ...]:
    """The letters of one case that a page has beyond ASCII."""
    return tuple(c for c in _page(written)[0x80:] if c.isalpha() and c.isupper() == upper)


@cache
def _runs(read_as: str, written: str) -> tuple[re.Pattern, dict[str, int]]:
    """Runs of characters whose bytes are valid in a multi-byte encoding, and those bytes."""
    page = _page(read_as)
    char = lambda m: re.escape(page[ord(m[0])]) if m[0] >= "\x80" else re.escape(m[0])
    classes = re.sub(r"\[([^]]*)\]", lambda m: "[" + "".join(re.sub("(?s).", char, "".join(map(chr, range(ord(a), ord(b) + 1)))) for a, b in re.findall("(?s)(.)-(.)", m[1])) + "]", MULTI[written])
    return re.compile(classes), {c: b for b, c in enumerate(page) if b >= 0x80} | {chr(b): b for b in range(0x80)}


@cache
def _leads(read_as: str, written: str) -> frozenset:
    """Characters that such a run may begin with."""
    pattern, to_byte = _runs(read_as, written)
    return frozenset(c for c, b in to_byte.items() if b >= 0x80 and any(pattern.match(c + d + e + f) for d in _tails(read_as) for e in (d,) for f in (d,)))


@cache
def _tails(read_as: str) -> tuple[str, ...]:
    return tuple(_page(read_as)[b] for b in (0x80, 0x90, 0xA1, 0xBF, 0xC1, 0xF0, 0x40))


def _decoded(word: str, read_as: str, written: str) -> str:
    """``word`` with every run of bytes that is valid in the multi-byte encoding decoded."""
    pattern, to_byte = _runs(read_as, written)
    out, at = [], 0
    for m in pattern.finditer(word):
        try:
            text = bytes(map(to_byte.__getitem__, m[0])).decode(written)
        except UnicodeError:
            continue
        out += [word[at : m.start()], text]
        at = m.end()
    return "".join([*out, word[at:]]) if out else word


def decodings(word: str, beyond: str) -> dict[str, list[str]]:
    """What ``word`` would be if it were multi-byte text, with the channels that say so; ``beyond`` are its characters beyond ASCII."""
    found: dict[str, list[str]] = {}
    if len(beyond) < 2:  # a letter of two bytes has two kinds of them
        return found
    chars = set(beyond)
    for r in READ_AS:
        if chars.isdisjoint(_leads(r, "utf_8")):
            continue
        text = word
        for _ in range(PASSES):  # the same channel may have been passed several times
            before, text = text, _decoded(text, r, "utf_8")
            if text == before:
                break
            found.setdefault(text, []).append(f"utf_8>{r}")
    for r in ASIAN_READ_AS:
        for w in ("shift_jis", "euc_jp"):
            if not chars.isdisjoint(_leads(r, w)) and (text := _decoded(word, r, w)) != word:
                found.setdefault(text, []).append(f"{w}>{r}")
    return found


def _kind(c: str) -> str:
    """Letters of large scripts share their bigrams, so that there are as many as small alphabets make."""
    return c if c < "⺀" or "　" <= c < "㄀" else "漢" if c < "가" else "한" if c < "ힰ" else "☺"


class Bigrams(dict):
    """Log probability of the second character of a pair after the first; filled as it is asked."""

    def __init__(self, pairs: dict[str, float], letters: dict[str, float]):
        self.pairs, self.letters, self.total = pairs, letters, sum(letters.values()) + 5000.0
        self.kinds, self.after = Counter(), Counter()
        for c, n in letters.items():
            self.kinds[_kind(c)] += n
        for p, n in pairs.items():
            self.after[p[0]] += n

    def __missing__(self, pair: str) -> float:
        a, b = _kind(pair[0]), _kind(pair[1])
        alone = (self.kinds[b] + 0.5) / self.total
        p = (self.pairs.get(a + b, 0.0) + 4 * alone) / (self.after[a] + 4)
        if b != pair[1]:
            p *= (self.letters.get(pair[1], 0.0) + 0.05) / (self.kinds[b] + 1000)
        self[pair] = out = math.log(p)
        return out

    def score(self, word: str) -> float:
        t = f"\n{word}\n"
        return sum(map(self.__getitem__, map("".join, zip(t, t[1:]))))


class Model:
    """Bigrams of undamaged text, and of the channels their shares of the words and their substitution tables."""

    def __init__(self, bigrams: Bigrams, channels: dict[str, float] | None = None, words: float = 0.0, letters: dict[tuple[str, str], dict[str, float]] | None = None):
        self.bigrams, self.common, self.n_common = bigrams, channels or {}, words
        self.letters = letters or {}  # (channel, character): expected counts of what it stands for
        self.tables = {}
        self.sources: dict[str, tuple[float, dict[str, float], dict[str, dict[int, str]]]] = {}
        self.restored: dict[tuple[str, str], tuple[str, str | None]] = {}
        self.better: dict[str, list[tuple[float, str, list[str]]]] = {}
        self.swapped: dict[str, list[tuple[dict[int, str], list[str]]]] = {}

    def odds(self, channel: str, char: str, letter: str) -> float:
        """Weight of ``letter`` behind ``char`` in a single-byte channel: what was counted, and where the cipher began."""
        written, read_as = channel.split(">")
        start = OWN_LETTER if _swap(read_as, written).get(ord(char), char) == letter else OTHER_LETTER
        return start + self.letters.get((channel, char), {}).get(letter, 0.0)

    def table(self, channel: str) -> dict[int, str]:
        """The substitution of a single-byte channel: the likeliest letter for each character."""
        if (known := self.tables.get(channel)) is None:
            written, read_as = channel.split(">")
            known = dict(_swap(read_as, written))
            for (c, char), counts in self.letters.items():
                if c == channel:
                    best = max({*counts, known.get(ord(char), char)}, key=lambda x: (self.odds(channel, char, x), x))
                    known[ord(char)] = best
            self.tables[channel] = known
        return known

    def swaps(self, beyond: str) -> list[tuple[dict[int, str], list[str]]]:
        """The different substitutions of some characters, with the channels that make them."""
        if (known := self.swapped.get(beyond)) is not None:
            return known
        found: dict[str, list[str]] = {}
        chars = set(beyond)
        for r in READ_AS:
            if chars <= _upper(r):
                for w in WRITTEN_IN:
                    if w != r and (letters := beyond.translate(self.table(f"{w}>{r}"))) != beyond:
                        found.setdefault(letters, []).append(f"{w}>{r}")
        if len(self.swapped) >= CACHE:
            self.swapped.clear()
        self.swapped[beyond] = known = [(dict(zip(map(ord, beyond), letters)), cs) for letters, cs in found.items()]
        return known

    def likelier(self, word: str) -> list[tuple[float, str, list[str]]]:
        """``(log odds, text, channels)`` of what makes ``word`` likelier; worked out once for each word."""
        if (known := self.better.get(word)) is not None:
            return known
        beyond = "".join(sorted({c for c in word if c >= "\x80"}))
        padded, pair = f"\n{word}\n", self.bigrams
        as_is, known = [pair[padded[i : i + 2]] for i in range(len(word) + 1)], []
        whole = sum(as_is)
        for text, channels in decodings(word, beyond).items():
            if (odds := pair.score(text) - whole) > 0.5:
                known.append((odds, text, channels))
        touched = sorted({j for i, c in enumerate(word) if c >= "\x80" for j in (i, i + 1)})  # bigrams that a substitution changes
        most = [0.0]  # what the bigrams from here on can gain at most, no probability being above 1
        for j in reversed(touched):
            most.append(most[-1] - as_is[j])
        most.reverse()
        steps = [(j, as_is[j], gain) for j, gain in zip(touched, most[1:])]
        for table, channels in self.swaps(beyond):
            text, odds = padded.translate(table), 0.0
            for j, before, gain in steps:
                odds += pair[text[j : j + 2]] - before
                if odds + gain <= 0.5:
                    break
            else:
                known.append((odds, text[1:-1], channels))
        if len(self.better) >= CACHE:
            self.better.clear()
        self.better[word] = known
        return known

    def meet(self, source: str, own: list | None) -> None:
        """Take in what was learned about a source: ``(key, letter, n)`` entries, see ``own_entries``."""
        if source in self.sources:
            return
        if len(self.sources) >= BROADCAST_SOURCES:
            self.sources.clear()
            self.restored.clear()
        words, channels, tables = 0.0, {}, {}
        for e in own or ():
            if e["kind"] == "words":
                words = e["n"]
            elif e["kind"] == "channel":
                channels[e["b"]] = e["n"]
            else:
                channel, char = e["b"].split("\t")
                tables.setdefault(channel, {})[ord(char)] = e["c"]
        self.sources[source] = words, channels, {c: self.table(c) | t for c, t in tables.items()}

    def log_share(self, source: str, channel: str) -> float:
        words, channels, _ = self.sources.get(source, (0.0, {}, {}))
        base = (self.common.get(channel, 0.0) + WEIGHT * SHARE / 100) / (self.n_common + WEIGHT)
        return math.log((channels.get(channel, 0.0) + WEIGHT * base) / (words + WEIGHT))

    def restore(self, source: str, word: str) -> tuple[str, str | None]:
        """The word as it was written, and the channel that was undone last; None if it is undamaged."""
        if (known := self.restored.get((source, word))) is not None:
            return known
        text, channel = word, None
        own = self.sources.get(source, (0.0, {}, {}))[2]
        for _ in range(PASSES):
            ways = self.likelier(text)
            if own:  # ciphers of this source alone
                as_is = self.bigrams.score(text)
                ways = [*ways, *((self.bigrams.score(c) - as_is, c, [name]) for name, table in own.items() if (c := text.translate(table)) != text)]
            best, now = None, MARGIN
            for odds, candidate, channels in ways:
                if odds > now:  # any of the channels may have made the word
                    shares = [(self.log_share(source, c), c) for c in channels]
                    odds += math.log(sum(math.exp(share) for share, _ in shares))
                    if odds > now:
                        best, now = (candidate, max(shares)[1]), odds
            if best is None:
                break
            text, channel = best
        if len(self.restored) >= CACHE:
            self.restored.clear()
        self.restored[source, word] = text, channel
        return text, channel

    def stands_for(self, channel: str, word: str, text: str) -> Iterator[tuple[str, str, float]]:
        """``(character, letter, probability)`` of each enciphered character of a word, its neighbours being taken as restored."""
        written = channel.split(">")[0]
        padded = f"\n{text}\n"
        for i, char in enumerate(word):
            if char >= "\x80":
                left, right = padded[i], padded[i + 2]
                logs = {x: math.log(self.odds(channel, char, x)) + self.bigrams[left + x] + self.bigrams[x + right] for x in {*_alphabet(written, text[i].isupper()), text[i]}}  # letters of one case
                most = max(logs.values())
                weights = {x: math.exp(v - most) for x, v in logs.items() if v > most - 7}
                total = sum(weights.values())
                for x, v in weights.items():
                    yield char, x, v / total

    def restore_all(self, source: str, words: list[str]) -> tuple[list[str], set[str]]:
        """The words of one text as they were written, and the channels undone.

        A channel that damaged a text damaged many of its words: what is doubtful for each word alone is judged for
        the text as a whole, as a mixture of words that passed the channel and words that didn't.
        """
        out, channels, odds = [*words], set(), Counter()
        open_words = []
        for i, word in enumerate(words):
            text, channel = self.restore(source, word)
            if channel:
                out[i] = text
                channels.add(channel)
            else:
                open_words.append(i)
        stay, passed = math.log(1 - PASSED), {}
        for i in open_words:
            passed[i] = known = {}
            for gain, text, cs in self.likelier(words[i]):
                for c in cs:
                    if c not in known or known[c][0] < gain:
                        known[c] = gain, text
            for c, (gain, _) in known.items():
                odds[c] += math.log(1 - PASSED + PASSED * math.exp(min(gain, 50.0))) - stay
        if odds:
            c, most = max(odds.items(), key=lambda x: (x[1], x[0]))
            if most + stay * len(open_words) + self.log_share(source, c) > MARGIN:
                channels.add(c)
                for i in open_words:
                    if c in passed[i]:
                        out[i] = passed[i][c][1]
        return out, channels


STATS = "kind string, a string, b string, c string, n double"
OWN = "array<struct<kind string, b string, c string, n double>>"


def _suspect(word: str, letters: dict[str, float]) -> bool:
    """Whether bytes of ``word`` make valid UTF-8 for letters that are more frequent than what stands there."""
    for r in READ_AS:
        text = _decoded(word, r, "utf_8")
        if text != word:
            new, old = set(text) - set(word), set(word) - set(text)
            if new and old and min(letters.get(c, 0) for c in new) > min(letters.get(c, 0) for c in old):
                return True
    return False


def _statistics(model: Model | None, letters: dict[str, float] | None):
    """One E-step over distinct words: expected bigrams, letters, channels and substitutions, added up within a batch.

    Without a model, all words count that aren't suspect; without ``letters`` either, just all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats: Counter = Counter()
            for i, (source, word, n) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                if word.isspace():
                    continue
                text = word
                if model is None:
                    if letters and _suspect(word, letters):
                        continue
                else:
                    if source not in model.sources:
                        model.meet(source, batch.column(3)[i].as_py())
                    text, channel = model.restore(source, word)
                    for s in (OF_SOURCE + source, COMMON):
                        stats["words", s, "", ""] += n
                        if channel:
                            stats["channel", s, channel, ""] += n
                    if channel and len(text) == len(word) and channel.split(">")[0] not in MULTI:
                        for char, letter, p in model.stands_for(channel, word, text):
                            for s in (OF_SOURCE + source, COMMON):
                                stats["letter of", s, f"{channel}\t{char}", letter] += n * p
                if SURE.search(text):
                    continue
                kinds = [*map(_kind, text)]
                for a, b in zip(["\n", *kinds], [*kinds, "\n"]):
                    stats["pair", a, b, ""] += n
                for c in text:
                    stats["letter", c, "", ""] += n
                stats["letter", "\n", "", ""] += n
            columns = [*zip(*stats)] if stats else [()] * 4
            yield pa.record_batch([*(pa.array(c, pa.string()) for c in columns), pa.array(map(float, stats.values()), pa.float64())], ["kind", "a", "b", "c", "n"])

    return run


def word_counts(documents: DataFrame) -> DataFrame:
    """``(source, word, n)``: how often each word beyond ASCII stands in the texts of each source."""
    beyond = F.filter(F.split("text", BLANK), lambda w: w.rlike(r"[^\x00-\x7f]"))
    return documents.select(F.coalesce("source", F.lit("?")).alias("source"), F.explode(beyond).alias("word")).groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))


def own_entries(sums: DataFrame, model: Model) -> DataFrame:
    """``(source, own)``: the channels of each source, and the letters in which its tables differ from the common ones."""
    spark = sums.sparkSession
    shares = sums.where("kind in ('words', 'channel')").where(F.col("a") != COMMON).select("a", "kind", "b", "c", "n")
    letters = sums.where("kind = 'letter of'").where(F.col("a") != COMMON).groupBy("a", "b").agg(F.max_by("c", "n").alias("c"), F.sum("n").alias("n")).where(F.col("n") >= EVIDENCE)
    common = [(f"{channel}\t{char}", model.table(channel).get(ord(char), char)) for channel, char in model.letters]  # channels times characters at most
    same = F.broadcast(spark.createDataFrame(common, "b string, c string"))
    rows = shares.unionByName(letters.join(same, ["b", "c"], "left_anti").select("a", F.lit("letter of").alias("kind"), "b", "c", "n"))
    return rows.groupBy(F.substr("a", F.lit(len(OF_SOURCE) + 1)).alias("source")).agg(F.collect_list(F.struct("kind", "b", "c", "n")).alias("own"))


def _with_own(rows: DataFrame, own: DataFrame | None) -> DataFrame:
    if own is None:
        return rows.withColumn("own", F.lit(None).cast(OWN))
    few = own.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(own) if few else own, "source", "left")


def learn(documents: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame | None]:
    """Bigrams, channel shares and substitution tables by expectation-maximization over all words of all documents.

    Returns the common model, whose size is bounded by alphabets and code pages, and a table with one row for each source.
    Rounds end when the shares of the channels settle.
    """
    words = spread(checkpoint(word_counts(documents)))
    model, letters, own, before = None, None, None, None
    for step in range(rounds + 2):  # letters, then a first model, then the rounds
        sums = _with_own(words, own).mapInArrow(_statistics(model, letters), STATS).groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n"))
        sums = checkpoint(sums)
        common = sums.where("kind in ('words', 'channel', 'letter of')").where(F.col("a") == COMMON)
        pairs = {r.a + r.b: r.n for r in sums.where("kind = 'pair'").orderBy(F.desc("n"), "a", "b").limit(PAIRS).collect()}
        letters = {r.a: r.n for r in sums.where("kind = 'letter'").collect()}  # characters there are
        if step == 0:
            continue
        total, channels, stands = 0.0, {}, {}
        for r in common.collect():
            if r.kind == "words":
                total = r.n
            elif r.kind == "channel":
                channels[r.b] = r.n
            else:
                channel, char = r.b.split("\t")
                stands.setdefault((channel, char), {})[r.c] = r.n
        model = Model(Bigrams(pairs, letters), channels, total, stands)
        if step > 1:
            own = checkpoint(own_entries(sums, model))
            change = sum(abs(n - (before or {}).get(c, 0.0)) for c, n in (channels | dict.fromkeys(set(before or {}) - set(channels), 0.0)).items())
            if before is not None and change <= SETTLED * sum(channels.values()):
                break
            before = channels
    return model, own


def _apply(model: Model):
    blank = re.compile(f"({BLANK})")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, done = [], [], []
            for row, (doc, source, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                if source not in model.sources:
                    model.meet(source, batch.column(3)[row].as_py())
                parts = blank.split(text)
                at = [i for i, word in enumerate(parts) if not (word.isascii() or word.isspace())]
                words, channels = model.restore_all(source, [parts[i] for i in at])
                for i, word in zip(at, words):
                    parts[i] = word
                if channels or SURE.search(text):
                    ids.append(doc)
                    texts.append("".join(parts))
                    done.append(sorted(channels))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(done, pa.list_(pa.string()))], ["doc_id", "text", "channels"])

    return run


def restored(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, text, channels)`` of every garbled document, restored as far as possible.

    ``channels`` names the code pages undone (written in > read as); it is empty where letters are lost for good
    (replacement or control characters alone). Null, empty and pure ASCII texts are never garbled; a null source is a
    source of its own; repeated rows come out each. An empty table gives no rows.
    """
    model, own = learn(documents, rounds)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("?")).alias("source"), "text")
    asked = spread(rows).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    return _with_own(asked, own).select("doc_id", "source", "text", "own").mapInArrow(_apply(model), "doc_id bigint, text string, channels array<string>")
