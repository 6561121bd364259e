"""Phrases whose words keep company: counts in a HAT-trie per task, spilled as sorted runs and merged by prefix.

A task numbers its words. Under the number of a first word lies a hash container of what follows it (one or two
words); a container that grows large bursts into containers under the second word. When the trie is full its largest
subtrees leave as runs in the order of their words, one compressed run for each part of the prefixes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import spread_join

#: Occurrences of a candidate; hundredths of them inside a longer one that drop it; results of a language.
LEAST, SHARE, TOP = 10, 50, 2000
#: Entries of the tries of a task (some 100 bytes each), entries at which a container bursts, bytes counted at a time.
ENTRIES, BURST, WINDOW = 1_500_000, 1 << 16, 1 << 20
#: The phrases of a two-word prefix are dealt to so many parts by their third word.
THIRDS = 256
#: Parts for each shuffle partition of the session; a task merges one part after another.
PARTS = 8

#: For ``bytes.translate``: A-Z to a-z, what separates pieces to a line feed, tabs to blanks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_BREAK = re.compile(rb"[\n ]")
_RUN = "part int, lang array<string>, size array<int>, phrases array<binary>, counts array<binary>"


class Burst(dict):
    """A burst container: number of the second word to a container of third words, 0 standing for none."""


class Trie:
    """Counts of one, two and three words in a row; words are numbered from 1, a line feed is 0."""

    def __init__(self, lang: str = "") -> None:
        self.seed = zlib.crc32(lang.encode())
        self.numbers: dict[bytes, int] = {b"\n": 0}
        self.words, self.codes, self.below, self.size = [b"\n"], [0], [None], [0]
        self.single = np.zeros(1, dtype="int64")
        self.sorted: list[int] = []

    def number(self, words: Iterable[bytes]) -> None:
        for word in words:
            self.numbers[word] = len(self.words)
            self.words.append(word)
            self.codes.append(zlib.crc32(word, self.seed))
            self.below.append(None)
            self.size.append(0)

    def add(self, text: bytes, before: tuple[bytes, ...] = ()) -> tuple[tuple[bytes, ...], int]:
        """Count what ends in a word of the text, ``before`` being the words (two at most) that its first piece goes
        on from. Returns the last words of its last piece, and the number of words."""
        tokens = [t for t in text.replace(b"\n", b" \n ").split(b" ") if t]
        self.number(set(tokens).union(before).difference(self.numbers))
        skip = len(before)
        x = np.array(list(map(self.numbers.__getitem__, [*before, *tokens])), dtype="int64")
        counted = np.bincount(x[skip:], minlength=len(self.words))
        counted[0] = 0
        counted[:len(self.single)] += self.single
        self.single = counted
        words = len(tokens) - int((x == 0).sum())
        pair = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
        triple = np.flatnonzero((x[:-2] > 0) & (x[1:-1] > 0) & (x[2:] > 0))
        pair, triple = pair[pair + 1 >= skip], triple[triple + 2 >= skip]
        first = np.concatenate([x[pair], x[triple]])
        key = np.concatenate([x[pair + 1] << 32, x[triple + 1] << 32 | x[triple + 2]])
        order = np.argsort(first, kind="stable")
        first, key = first[order], key[order]
        edges = np.flatnonzero(np.diff(first, prepend=-1, append=-1)).tolist()
        keys, below, size = key.tolist(), self.below, self.size
        for a, i, j in zip(first[edges[:-1]].tolist(), edges, edges[1:]):
            box = below[a]
            if box is None:
                box = below[a] = {}
            if type(box) is Burst:
                for k in keys[i:j]:
                    thirds = box.get(k >> 32)
                    if thirds is None:
                        thirds = box[k >> 32] = {}
                    k &= 0xFFFFFFFF
                    n = thirds.get(k, 0)
                    size[a] += not n
                    thirds[k] = n + 1
                continue
            if j - i > 8:
                Counter.update(box, keys[i:j])
            else:
                for k in keys[i:j]:
                    box[k] = box.get(k, 0) + 1
            size[a] = len(box)
            if size[a] > BURST:
                below[a] = burst = Burst()
                for k, n in box.items():
                    burst.setdefault(k >> 32, {})[k & 0xFFFFFFFF] = n
        last = [*before, *tokens][-2:]
        while b"\n" in last:
            last = last[last.index(b"\n") + 1:]
        return tuple(last), words

    def ranks(self) -> np.ndarray:
        """The place of every word in the order of their bytes; the old ones are in order already."""
        self.sorted.extend(range(len(self.sorted), len(self.words)))
        self.sorted.sort(key=self.words.__getitem__)
        rank = np.empty(len(self.words), dtype="int64")
        rank[self.sorted] = np.arange(len(self.words))
        return rank

    def sizes(self) -> np.ndarray:
        """Entries of the subtree of every first word."""
        return np.array(self.size, dtype="int64") + (self.single > 0)

    def take(self, firsts: list[int]) -> tuple[np.ndarray, ...]:
        """Word numbers and count of all that begins with these words; their subtrees are empty afterwards."""
        boxes = []
        for a in firsts:
            box = self.below[a] or {}
            boxes.append({b << 32 | c: n for b, thirds in box.items() for c, n in thirds.items()} if type(box) is Burst else box)
            self.below[a], self.size[a] = None, 0
        lengths = np.fromiter(map(len, boxes), dtype="int64", count=len(boxes))
        keys = np.fromiter(chain.from_iterable(boxes), dtype="int64", count=lengths.sum())
        counts = np.fromiter(chain.from_iterable(map(dict.values, boxes)), dtype="int64", count=lengths.sum())
        heads = np.array(firsts, dtype="int64")
        alone = heads[self.single[heads] > 0]
        keys = np.concatenate([np.zeros(len(alone), dtype="int64"), keys])
        counts = np.concatenate([self.single[alone], counts])
        self.single[heads] = 0
        return np.concatenate([alone, np.repeat(heads, lengths)]), keys >> 32, keys & 0xFFFFFFFF, counts


def _runs(trie: Trie, firsts: list[int], parts: int) -> Iterator[tuple]:
    """Sorted runs (part, size, phrases, counts) of the subtrees: words between blanks, a line feed after each phrase."""
    a, b, c, n = trie.take(firsts)
    words = pa.array(trie.words, pa.large_binary())
    feed, blank, none = (pa.scalar(x, pa.large_binary()) for x in (b"\n", b" ", b""))
    rank, code = trie.ranks(), np.array(trie.codes, dtype="uint64")
    prefix = (code[a] * np.uint64(0x9E3779B1) ^ np.where(b > 0, code[b], 0)) * np.uint64(0x85EBCA6B)
    part = ((prefix >> np.uint64(20)) + np.where(c > 0, code[c], 0) % np.uint64(THIRDS)) % np.uint64(parts)
    squeeze, bits = zstandard.ZstdCompressor(level=1).compress, max(1, len(words).bit_length())
    for size, own in ((1, b == 0), (2, (b > 0) & (c == 0)), (3, c > 0)):
        at = np.flatnonzero(own)
        at = at[np.argsort((rank[a[at]] << bits | rank[b[at]]) << bits | rank[c[at]])]
        at = at[np.argsort(part[at].astype("uint16" if parts < 1 << 16 else "int64"), kind="stable")]
        columns = [words.take(pa.array(x[at])) for x in (a, b, c)[:size]]
        columns[-1] = pc.binary_join_element_wise(columns[-1], feed, none)
        phrases = pc.binary_join_element_wise(*columns, blank) if size > 1 else columns[0]
        offsets, data = np.frombuffer(phrases.buffers()[1], dtype="int64"), memoryview(phrases.buffers()[2] or b"")
        edges = [0, *(np.flatnonzero(np.diff(part[at].astype("int64"))) + 1), len(at)]
        for i, j in zip(edges, edges[1:]):
            if i < j:
                yield int(part[at[i]]), size, squeeze(data[offsets[i]:offsets[j]]), squeeze(n[at[i:j]].tobytes())


def _chunks(data: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """A text in bounded stretches that end between words, and whether a stretch continues the piece before."""
    at, inside = 0, False
    while at < len(data):
        end = len(data)
        if end - at > size:
            found = _BREAK.search(data, at + size)
            end = found.end() if found else end
        yield data[at:end], inside
        inside, at = data[end - 1] == 32, end


def _count(batches: Iterable[pa.RecordBatch], parts: int, entries: int) -> Iterator[pa.RecordBatch]:
    """Rows of runs: what leaves the tries at one time for one part, in all languages.

    Phrases of size 0 are the numbers of words of the languages.
    """
    tries: dict[str, Trie] = {}
    totals: dict[str, int] = {}
    room, window = entries // 3, min(WINDOW, entries)

    def leave(everything: bool) -> Iterator[pa.RecordBatch]:
        """Empties the largest subtrees if the bound is reached; with too many words, all."""
        nonlocal room
        sizes = {lang: t.sizes() for lang, t in tries.items()}
        left, chosen = sum(int(n.sum()) for n in sizes.values()), {}
        everything |= sum(len(t.words) for t in tries.values()) * 4 > entries
        if everything or left * 8 > entries * 7:
            every = np.concatenate([n for n in sizes.values()] or [np.zeros(0, int)])
            # The largest subtrees that leave a quarter of the bound behind.
            order = np.argsort(-every, kind="stable")
            gone = np.cumsum(every[order])
            order = order[:int((every > 0).sum()) if everything else int(np.searchsorted(gone, left - entries // 4)) + 1]
            start = 0
            for lang, n in sizes.items():
                chosen[lang] = (order[(order >= start) & (order < start + len(n))] - start).tolist()
                start += len(n)
            left -= int(every[order].sum())
            rows: dict[int, list[tuple]] = {}
            for lang, firsts in chosen.items():
                for part, *run in _runs(tries[lang], firsts, parts):
                    rows.setdefault(part, []).append((lang, *run))
            yield from _batches(rows)
            if everything:
                tries.clear()
        # A word brings two entries beside itself, so the bound is passed by those of one window at most.
        room = max(entries - left, 3) // 3

    def add(lang: str, text: bytes, before: tuple[bytes, ...] = ()) -> tuple[bytes, ...]:
        nonlocal room
        if lang not in tries:
            tries[lang] = Trie(lang)
        last, words = tries[lang].add(text, before)
        if words:
            totals[lang] = totals.get(lang, 0) + words
        room -= words
        return last

    waiting: dict[str, list[bytes]] = {}
    bytes_waiting = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang, data = lang.as_py(), text.as_py().translate(_TABLE)
            if len(data) <= window:
                waiting.setdefault(lang, []).append(data)
                bytes_waiting += len(data)
                if bytes_waiting > window:
                    for own, texts in waiting.items():
                        add(own, b"\n".join(texts))
                    waiting, bytes_waiting = {}, 0
            else:
                last = ()
                for chunk, inside in _chunks(data, window):
                    last = add(lang, chunk, last if inside else ())
                    if room <= 0:
                        yield from leave(False)
            if room <= 0:
                yield from leave(False)
    for own, texts in waiting.items():
        add(own, b"\n".join(texts))
    yield from leave(True)
    rows = {}
    for lang, n in totals.items():
        rows.setdefault(zlib.crc32(lang.encode()) % parts, []).append((lang, 0, zstandard.compress(b"\n"), zstandard.compress(np.int64(n).tobytes())))
    yield from _batches(rows)


def _batches(rows: dict[int, list[tuple]], size: int = 256) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(k) for k in (pa.string(), pa.int32(), pa.binary(), pa.binary())]
    listed = list(rows.items())
    for i in range(0, len(listed), size):
        runs = [list(zip(*r)) for _, r in listed[i:i + size]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in listed[i:i + size]], pa.int32()), *[pa.array([r[j] for r in runs], k) for j, k in enumerate(kinds)]],
            ["part", "lang", "size", "phrases", "counts"])


def _merge(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Adds up the runs of one part after another, language by language; what occurs often enough goes on."""
    unpack = zstandard.ZstdDecompressor().decompress

    def opened(run: tuple[bytes, bytes]) -> pa.RecordBatch:
        phrases, n = unpack(run[0]), np.frombuffer(unpack(run[1]), dtype="int64")
        data = np.frombuffer(phrases, dtype="uint8")
        # Phrase i lies between line feeds i - 1 and i; each keeps the one at its end until it is reported.
        ends = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype("int64")), pa.py_buffer(phrases)])
        return pa.RecordBatch.from_arrays([column, pa.array(n)], ["phrase", "n"])

    def merged(lang: str, size: int, runs: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        total = pa.Table.from_batches(map(opened, runs)).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
        often = total.filter(pc.greater_equal(total["n_sum"], least)) if size else total
        if len(often):
            phrases = [p[:-1] for p in often["phrase"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(often)), pa.array(np.full(len(often), size, dtype="int32")), pa.array(phrases, pa.binary()),
                 often["n_sum"].combine_chunks()], ["lang", "size", "phrase", "f"])

    on, held = None, {}
    for batch in batches:
        for part, *runs in zip(*[c.to_pylist() for c in batch.columns]):
            if part != on:
                for key, found in held.items():
                    yield from merged(*key, found)
                on, held = part, {}
            for lang, size, phrases, n in zip(*runs):
                held.setdefault((lang, size), []).append((phrases, n))
    for key, found in held.items():
        yield from merged(*key, found)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, entries: int = ENTRIES) -> DataFrame:
    """How often each phrase of one to three words occurs in a language: (lang, size, phrase, f), from ``least`` on.

    ``size`` 0 with an empty phrase counts all words of the language. Texts are lower-cased (A-Z), cut into pieces at
    ``.,;:!?`` and line ends, and those into words at blanks and tabs. NULL text counts as empty, NULL language as
    ``und``; a language without words has no row. All of every text counts, long ones in stretches.

    A task holds at most about ``entries`` entries. What it spills are compressed sorted runs, dealt by the first two
    words (and the third, modulo 256, so that one prefix is not one task); repeated phrases are added before they
    travel. A merging task holds the compressed runs of one part and unpacks those of one language and size: raise
    ``spark.sql.shuffle.partitions`` with the input.
    """
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    runs = texts.filter("text IS NOT NULL").mapInArrow(lambda batches: _count(batches, parts, entries), _RUN)
    ordered = runs.repartition("part").sortWithinPartitions("part")
    found = ordered.mapInArrow(lambda batches: _merge(batches, least), "lang string, size int, phrase binary, f long")
    return found.withColumn("phrase", F.col("phrase").cast("string"))


def _key(lang: Column, phrase: Column) -> Column:
    return F.concat(lang, F.lit("\t"), phrase)  # a phrase has no tab


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE,
                 top: int = TOP, entries: int = ENTRIES) -> DataFrame:
    """The ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Candidates are phrases of two or three words with ``a`` >= ``least`` occurrences. Of the cuts into two parts with
    ``l`` and ``r`` occurrences that with the lowest ``floor(10**6 * a * a / (l * r))`` counts, of equal ones the
    first. A candidate that stands inside a longer one (kept or not) with at least ``share`` hundredths of its
    occurrences is dropped. Order: score and ``a`` falling, then the bytes of the phrase. Counting is as in
    ``phrase_counts``, which also says what NULL and empty texts are; repeated rows count each time. An empty table
    gives no rows. Products are decimals of 38 digits, exact for counts below 10**16.
    """
    counted = stored(phrase_counts(docs, text, lang, least, entries), "phrases")
    words = F.split("phrase", " ")
    every = counted.filter("size > 0").select("lang", "size", "phrase", "f", _key(F.col("lang"), F.col("phrase")).alias("key"))
    longer = every.filter("size > 1")

    def span(first: Column | int, length: Column | int) -> Column:
        return _key(F.col("lang"), F.array_join(F.slice(words, first, length), " "))

    k = F.col("k")
    cuts = (longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("key", "lang", "size", "phrase", F.col("f").alias("a"), "k", span(1, k).alias("left"),
                    span(k + 1, F.col("size") - k).alias("right")))
    cuts = spread_join(cuts, every.select(F.col("key").alias("left"), F.col("f").alias("l")), "left", "key").drop("left")
    cuts = spread_join(cuts, every.select(F.col("key").alias("right"), F.col("f").alias("r")), "right", "key")
    whole = [F.col(c).cast("decimal(19,0)").alias(c) for c in ("a", "l", "r")]
    scored = cuts.select("key", "lang", "size", "phrase", "k", *whole).withColumn("score", F.expr("(a * a * 1000000BD) div (l * r)"))
    best = (scored.groupBy("key", "lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("key", "lang", "phrase", "a", "cut.*"))
    inside = (longer.filter("size = 3").select(F.col("f").alias("most"), F.explode(F.array(span(1, 2), span(2, 2))).alias("key"))
              .groupBy("key").agg(F.max("most").alias("most")))
    kept = best.join(inside, "key", "left").filter(F.coalesce(F.col("most"), F.lit(0)) * 100 < share * F.col("a"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank).filter(F.col("rank") <= top)
    totals = counted.filter("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
