"""Language-model scores from a subword lattice: all segmentations of a text into known pieces, summed."""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

#: Public byte-level vocabulary for many languages; one line per piece: base-64 bytes, rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Words above this many bytes are summed one by one instead of in batches of equal length.
LONG_WORD = 256
#: Words that make up at least one in so many tokens, so never more than that, and have at most so many bytes,
#: travel to every task; all others are joined.
FREQUENT, FREQUENT_BYTES = 1 << 20, 48
#: Weight (in pieces) of the vocabulary's own scores beside what the training texts count.
PRIOR = 1000.0
#: Distinct words that a task of the training step takes.
WORDS_PER_TASK = 50_000
#: Rows that a scoring task holds before it hands them on.
ROWS_OUT = 50_000
BASE = np.uint64(0x9E3779B97F4A7C15)
END = b""
LOG10 = math.log(10)


def read_pieces(spark: SparkSession, path: str = VOCABULARY) -> dict[bytes, float]:
    """Pieces and their scores: log of 1 / (rank + 2.7), the usual law of word frequencies by rank.

    Pieces that no lower-cased word can hold (capitals, inner white space) are left out, whatever their length all
    others stay, as do all single bytes, so every word has a segmentation. A vocabulary has a fixed, small size.
    """
    with open(path, "rb") as lines:
        rows = [line.split() for line in lines if line.strip()]
    found = {}
    for piece, rank in rows:
        piece = base64.b64decode(piece)
        inner = piece[1:] if piece[:1] == b" " and len(piece) > 1 else piece
        if len(piece) == 1 or inner == inner.lower() and len(inner.split()) == 1 and inner.split()[0] == inner:
            found[piece] = -math.log(int(rank) + 2.7)
    for byte in range(256):
        found.setdefault(bytes([byte]), -math.log(len(rows) + 2.7))
    return found


def _log_sum(terms: np.ndarray) -> np.ndarray:
    """log of the sum of exp over the first axis, safe for -inf."""
    top = terms.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(terms - safe).sum(axis=0)) + safe


class Lattice:
    """Sums over all segmentations of words (with a leading blank as their start mark) into pieces."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.pieces, self.log_p = pieces, np.append(log_p, -np.inf)
        self.index = {p: i for i, p in enumerate(pieces)}
        self.tables = {}
        lengths = np.array([len(p) for p in pieces])
        for k in sorted(set(lengths.tolist())):
            ids = np.flatnonzero(lengths == k)
            rows = np.frombuffer(b"".join(pieces[i] for i in ids), dtype=np.uint8).reshape(len(ids), k)
            keys = self._prefix(rows)[:, k]
            order = np.argsort(keys)
            self.tables[k] = keys[order], ids[order]

    @staticmethod
    def _prefix(rows: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes of equally long byte strings."""
        out = np.zeros((rows.shape[0], rows.shape[1] + 1), dtype=np.uint64)
        for j in range(rows.shape[1]):
            out[:, j + 1] = out[:, j] * BASE + rows[:, j] + np.uint64(1)
        return out

    def _arcs(self, rows: np.ndarray) -> dict[int, np.ndarray]:
        """Per piece length: the piece that starts at each place of each word; the last id means none."""
        prefix, power, arcs = self._prefix(rows), np.uint64(1), {}
        for k in range(1, min(rows.shape[1], max(self.tables)) + 1):
            power = power * BASE
            if k not in self.tables:
                continue
            keys, ids = self.tables[k]
            here = prefix[:, k:] - prefix[:, :-k] * power
            at = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
            arcs[k] = np.where(keys[at] == here, ids[at], len(self.pieces))
        return arcs

    def _forward(self, arcs: dict[int, np.ndarray], n: int, length: int) -> np.ndarray:
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        weights = {k: self.log_p[a].T for k, a in arcs.items()}
        for j in range(1, length + 1):
            alpha[j] = _log_sum(np.stack([alpha[j - k] + weights[k][j - k] for k in arcs if k <= j]))
        return alpha

    def _batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of equal length as (their places, byte matrix), in pieces of bounded size."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cuts):
            size = lengths[same[0]] + 1
            for part in np.array_split(same, max(1, len(same) * size // 60_000)):
                joined = b"".join(b" " + words[i] for i in part)
                yield part, np.frombuffer(joined, dtype=np.uint8).reshape(len(part), size)

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the summed probability of all segmentations, per word."""
        out = np.zeros(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        if short:
            for part, rows in self._batches([words[i] for i in short]):
                out[[short[i] for i in part]] = self._forward(self._arcs(rows), *rows.shape)[-1]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._one_by_one(b" " + w)[0][-1]
        return out

    def _one_by_one(self, word: bytes) -> tuple[list[float], list[list[tuple[int, int]]]]:
        """The same recursion for one long word: forward values and the arcs that end at each place."""
        alpha, arcs, index, log_p = [0.0], [[]], self.index, self.log_p
        for j in range(1, len(word) + 1):
            ends = [(k, i) for k in self.tables if k <= j
                    if (i := index.get(word[j - k:j])) is not None]
            terms = [alpha[j - k] + log_p[i] for k, i in ends]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            arcs.append(ends)
        return alpha, arcs

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over the words, by forward and backward sums."""
        out = np.zeros(len(self.pieces) + 1)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        if short:
            for part, rows in self._batches([words[i] for i in short]):
                n, length = rows.shape
                arcs = self._arcs(rows)
                alpha, times = self._forward(arcs, n, length), counts[[short[i] for i in part]]
                weights = {k: self.log_p[a].T for k, a in arcs.items()}
                beta = np.full((length + 1, n), -np.inf)
                beta[length] = 0.0
                for j in range(length - 1, -1, -1):
                    beta[j] = _log_sum(np.stack([beta[j + k] + weights[k][j] for k in arcs if j + k <= length]))
                for k, ids in arcs.items():
                    share = np.exp(alpha[:length - k + 1] + weights[k] + beta[k:] - alpha[length]) * times
                    out += np.bincount(ids.T.ravel(), share.ravel(), len(out))
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                alpha, arcs = self._one_by_one(b" " + w)
                beta = [-math.inf] * (len(alpha) - 1) + [0.0]
                for j in range(len(alpha) - 1, 0, -1):
                    for k, piece in arcs[j]:
                        term = beta[j] + self.log_p[piece]
                        out[piece] += counts[i] * math.exp(alpha[j - k] + term - alpha[-1])
                        beta[j - k] = np.logaddexp(beta[j - k], term)
        return out[:-1]


def _tokens(texts: pa.Array) -> Iterator[list[bytes]]:
    """Words of each text, A-Z in lower case; on bytes both touch ASCII only."""
    for text in texts.cast(pa.binary()):
        yield (text.as_py() or b"").lower().split()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(train, text) to (word, c): occurrences in training texts, 0 for words of the others; END per text."""
    for batch in batches:
        counts, others = Counter(), set()
        for train, words in zip(batch.column(0).to_pylist(), _tokens(batch.column(1))):
            words.append(END)
            if train:
                counts.update(words)
            else:
                others.update(words)
        for w in others:
            counts.setdefault(w, 0)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                         ["word", "c"])


@dataclass
class Model:
    """What is learned: a table with one row per word (word, base, lat, known), and its totals."""

    words: DataFrame
    tokens: int
    distinct: int


def train(docs: DataFrame, held_out: Column, text: str = "text", vocabulary: str = VOCABULARY) -> Model:
    """Learn from the rows that are not held out; tabulate every word of the table.

    Counts of words cover all rows and stay a distributed table that grows with the corpus. Piece scores start
    from the vocabulary's own and are re-estimated once: every distinct training word, times its count, gives the
    expected uses of each piece over all its segmentations. What reaches the driver is one number per piece of
    the fixed vocabulary. Without training rows the vocabulary's scores stand.
    """
    spark = docs.sparkSession
    counts = stored(
        docs.select((~held_out).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        .mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    total, distinct, rows = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count("*")).first()
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    dealt = counts.repartition(rows // WORDS_PER_TASK + 1, "word")

    scores = read_pieces(spark, vocabulary)
    pieces = list(scores)
    prior = np.exp(np.array([scores[p] for p in pieces]))
    prior /= prior.sum()
    first = spark.sparkContext.broadcast((pieces, np.log(prior)))

    def estimate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, found = Lattice(*first.value), 0.0
        for batch in batches:
            found = found + lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy(False).astype(float))
        if np.ndim(found):
            ids = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(found[ids])], ["piece", "uses"])

    uses = np.zeros(len(pieces))
    learned = (dealt.filter((F.col("c") > 0) & (F.col("word") != F.lit(END)))
               .mapInArrow(estimate, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")))
    for row in learned.collect():
        uses[row["piece"]] = row["uses"]
    whole = uses.sum() + ends + PRIOR
    end = math.log10(max(ends, 1) / whole)
    second = spark.sparkContext.broadcast((pieces, np.log((uses + PRIOR * prior) / whole)))

    def tabulate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*second.value)
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy(False)
            lat = lattice.log_probability(words) / LOG10
            lat[[i for i, w in enumerate(words) if w == END]] = end
            base = np.log10((c + 1) / (total + distinct + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base), pa.array(lat)],
                                             ["word", "c", "base", "lat"])

    table = stored(dealt.mapInArrow(tabulate, "word binary, c long, base double, lat double"), "scored_words")
    return Model(table, int(total), int(distinct))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, n_tokens, n_known, base_score, score).

    ``score`` is log10 of the probability of the text: over its words and one end, the sum over all
    segmentations. No piece spans two words, so the sum of a text is the product of the sums of its words.
    Words above a fixed share of all tokens travel to the tasks; every other word of a text is counted inside the
    text and joined with the table, so nothing is left out. NULL text counts as empty: one
    token, the end. Rows that repeat key and text get the same result each.
    """
    spark = docs.sparkSession
    often = (F.col("c") > 0) & (F.col("c") * FREQUENT >= model.tokens)
    common = model.words.filter(often & (F.octet_length("word") <= FREQUENT_BYTES)).select("word", "base", "lat").collect()
    near = spark.sparkContext.broadcast({bytes(r["word"]): (r["base"], r["lat"]) for r in common})
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("k", kind), T.StructField("h", T.LongType()), T.StructField("word", T.BinaryType()),
        T.StructField("n", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType()),
        T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("lat", T.DoubleType())])

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = near.value
        kinds = [pa.binary()] + [pa.int64()] * 4 + [pa.float64()] * 2

        def close(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            at, *columns = zip(*rows)
            at = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at)] + [pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

        for batch in batches:
            rows, hashes = [], batch.column(1).to_pylist()
            for row, words in enumerate(_tokens(batch.column(2))):
                words.append(END)
                k, b, s = 0, 0.0, 0.0
                for w, times in Counter(words).items():
                    found = table.get(w)
                    if found is None:
                        rows.append((row, w, times, 0, 0, 0, 0.0, 0.0))
                    else:
                        k, b, s = k + times, b + times * found[0], s + times * found[1]
                # One row per text with what is known here; the blank keeps its key apart from all words.
                rows.append((row, b" %d" % hashes[row], 0, 1, len(words), k, b, s))
                if len(rows) > ROWS_OUT:
                    yield close(batch, rows)
                    rows = []
            if rows:
                yield close(batch, rows)

    content = F.coalesce(F.col(text), F.lit(""))
    parts = docs.select(F.col(key).alias("k"), F.xxhash64(content).alias("h"), content.alias("t")).mapInArrow(dealt, schema)
    table = model.words.select("word", F.col("base").alias("w_base"), F.col("lat").alias("w_lat"), (F.col("c") > 0).cast("long").alias("w_known"))
    joined = parts.join(table, "word", "left")
    sums = joined.groupBy("k", "h").agg(
        F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"),
        *[F.sum(F.col(own) + F.col("n") * F.coalesce(F.col(f"w_{own}"), F.lit(0))).alias(own) for own in ("known", "base", "lat")])
    per_row = lambda name: F.col(name) / F.col("docs")
    return (sums.select(F.col("k").alias(key), per_row("tokens").cast("long").alias("n_tokens"), per_row("known").cast("long").alias("n_known"),
                        per_row("base").alias("base_score"), per_row("lat").alias("score"),
                        F.explode(F.sequence(F.lit(1).cast("long"), F.col("docs"))).alias("_copy")).drop("_copy"))
