"""Benchmark passages in training texts, by spaced seeds: hashes of some positions of a window, others ignored."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLAIN_TABLE

#: An overlap counts when this many aligned words in a row ...
WINDOW = 13
#: ... agree in at least this share.
SIMILARITY = 0.8
#: 1: the word at this place is hashed, 0: it is ignored. A window of 13 words with any two of them changed still
#: holds one of the masks in full (a test tries all cases).
MASKS = ("11010111", "11110011")
#: Items of fewer words than the window are compared as a whole, from so many words; shorter ones never match.
SHORTEST = 5
#: Benchmark rows that are indexed and sent to the tasks at a time; more go in further passes.
BLOCK_ITEMS = 20_000


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and characters beyond ASCII."""
    return (text or b"").translate(PLAIN_TABLE).split()


def needed(window: int, similarity: float = SIMILARITY) -> int:
    return math.ceil(similarity * window - 1e-9)


def masks_for(words: int) -> tuple[str, ...]:
    """Masks that miss no allowed overlap of an item: the fixed ones, or one run of words for a short item.

    With m changes allowed among w words some w - m over m + 1 of them (rounded up) stand together unchanged.
    """
    if words >= WINDOW:
        return MASKS
    changes = words - needed(words)
    return ("1" * math.ceil((words - changes) / (changes + 1)),)


def seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Places at which all hashed words of the mask are known (number above 0), and the hashes there."""
    offsets = [i for i, c in enumerate(mask) if c == "1"]
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    good = np.ones(n, bool)
    for o in offsets:
        good &= ids[o:o + n] > 0
    at = np.flatnonzero(good)
    h = np.zeros(len(at), np.uint64)
    for o in offsets:
        h = (h ^ ids[at + o].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return at, h


@dataclass
class Index:
    """Benchmark items as word numbers, and per mask their seeds: hash, item, place, in order of the hash."""

    items: list
    vocabulary: dict[bytes, int]
    tokens: list[np.ndarray]
    tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple]) -> Index:
        vocabulary: dict[bytes, int] = {}
        items, tokens, found = [], [], {}
        for item, text in rows:
            words = words_of(text.encode() if isinstance(text, str) else text)
            if len(words) < SHORTEST:
                continue
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64)
            for mask in masks_for(len(ids)):
                at, h = seeds(ids, mask)
                found.setdefault(mask, []).append((h, np.full(len(at), len(items)), at))
            items.append(item)
            tokens.append(ids)
        tables = {}
        for mask, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            tables[mask] = h[order], item[order], at[order]
        return cls(items, vocabulary, tokens, tables)

    def parts(self) -> tuple:
        """The fields, as plain values that can be sent to tasks."""
        return self.items, self.vocabulary, self.tokens, self.tables

    def overlap(self, item: int, doc: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
        """(matched, start, end, best window) of an item laid on a text at a diagonal, if a window agrees.

        start and end are words of the text around all windows that agree; words beyond its ends differ.
        """
        own = self.tokens[item]
        width = min(WINDOW, len(own))
        same = np.zeros(len(own), bool)
        first, last = max(0, -diagonal), min(len(own), len(doc) - diagonal)
        same[first:last] = own[first:last] == doc[first + diagonal:last + diagonal]
        sums = np.concatenate([[0], np.cumsum(same)])
        windows = sums[width:] - sums[:-width]
        good = np.flatnonzero(windows >= needed(width))
        if not len(good):
            return None
        start, end = good[0], good[-1] + width
        return int(sums[end] - sums[start]), int(max(0, start + diagonal)), int(min(len(doc), end + diagonal)), int(windows.max())

    def search(self, texts: list[bytes]) -> list[tuple]:
        """(text, item, start, end, matched, best window): the best alignment of each item in each text."""
        gap = max(map(len, self.tables), default=1)
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) + gap for w in words])
        starts = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), np.int64)
        get = self.vocabulary.get
        for s, ws in zip(starts, words):
            ids[s:s + len(ws)] = [get(w, 0) for w in ws]
        found = []
        for mask, (hashes, item, place) in self.tables.items():
            at, h = seeds(ids, mask)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            times = high - low
            hit = np.repeat(np.arange(len(at)), times)
            row = np.repeat(low, times) + np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)
            text = np.searchsorted(starts, at[hit], "right") - 1
            found.append(np.stack([text, item[row], at[hit] - starts[text] - place[row]], axis=1))
        best: dict[tuple[int, int], tuple] = {}
        for text, item, diagonal in np.unique(np.concatenate(found), axis=0).tolist() if found else []:
            doc = ids[starts[text]:starts[text] + len(words[text])]
            result = self.overlap(item, doc, diagonal)
            if result and ((text, item) not in best or (result[0], -result[1]) > (best[text, item][0], -best[text, item][1])):
                best[text, item] = result
        return [(text, item, start, end, matched, window) for (text, item), (matched, start, end, window) in sorted(best.items())]


def index_blocks(benchmark: DataFrame, item: str, text: str, block: int = BLOCK_ITEMS) -> Iterator[Index]:
    """The benchmark as indexes of a bounded number of items: a stated query set, in blocks."""
    rows = benchmark.filter(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("t"))
    blocks = max(1, math.ceil(rows.count() / block))
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b)
        yield Index.of([(r["item"], r["t"]) for r in part.orderBy("item", "t").collect()])


def _parts(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in parts of bounded size, with the number of the first one; NULL is empty."""
    first, part, held = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t.as_py() or b"")
        held += len(part[-1])
        if held >= size:
            yield first, part
            first, part, held = i + 1, [], 0
    if part:
        yield first, part


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
             item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that share a passage: (key, item, start, end, matched, window).

    Words are lower-cased runs of letters, digits and characters beyond ASCII. A passage is shared if 13 aligned
    words of both (all words of an item with 5 to 12) agree in 80 % or more; the others may be any words, but
    none is skipped. Hits of the spaced seeds name the alignments; each is verified word by word. ``start`` and
    ``end`` (exclusive) are words of the document around all agreeing windows, ``matched`` the words that agree
    there, ``window`` the best window's. Documents without a shared passage have no row. NULL and empty texts
    share nothing, items of fewer than five words never match, repeated rows and items are all reported.
    """
    kinds = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField(item, benchmark.schema[item].dataType),
        *[T.StructField(n, T.IntegerType()) for n in ("start", "end", "matched", "window")]])
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    out = None
    for index in index_blocks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index.parts())

        def find(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in batches:
                found = [(first + t, *rest) for first, part in _parts(batch.column(1).cast(pa.binary()))
                         for t, *rest in index.search(part)]
                if found:
                    text_at, item_at, *numbers = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(text_at)), pa.array([index.items[i] for i in item_at])]
                        + [pa.array(x, pa.int32()) for x in numbers], kinds.names)

        part = rows.mapInArrow(find, kinds)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                      item_text: str = "text") -> DataFrame:
    """The documents that share no passage with the benchmark, with all their columns (see ``overlaps``)."""
    for index in index_blocks(benchmark, item, item_text):
        docs = docs.filter(_clean(docs.sparkSession.sparkContext.broadcast(index.parts()), F.col(text)))
    return docs


def _clean(shared, text: Column) -> Column:
    """True for texts that share no passage with the items of one index."""
    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(*shared.value)
        for texts in batches:
            hit = {first + t for first, part in _parts(texts.cast(pa.binary())) for t, *_ in index.search(part)}
            yield pa.array([i not in hit for i in range(len(texts))], pa.bool_())

    return clean(text)
