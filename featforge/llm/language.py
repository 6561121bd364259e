"""Language of the words of a text by a linear-chain conditional random field, and of the text by their sum."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK

#: Bounds of the training sample: documents per label, words of each (a window at a place fixed by a hash).
PER_LABEL, WINDOW = 300, 120
#: Words of one language before a training sequence switches to another document.
STRETCH = 30
HASHED = 1 << 17
EPOCHS, BATCH, RATE, RIDGE = 3, 64, 0.3, 1e-4
UNKNOWN = "und"
#: Rows (tokens times labels) that one forward-backward pass holds, unless a single text has more.
HELD = 1_000_000


def _codes(rows: np.ndarray, places: slice | list[int], kind: int) -> np.ndarray:
    """Feature numbers of byte strings at the given columns; kind keeps prefixes, suffixes and n-grams apart."""
    code = np.full(rows.shape[0], kind, dtype=np.uint64)
    for j in places:
        code = (code * np.uint64(1_099_511_628_211)) ^ (rows[:, j] + np.uint64(1))
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int64)


def _features(rows: np.ndarray) -> np.ndarray:
    """Words of equal length, framed by ^ and $, to their feature numbers: prefixes and suffixes of one to four
    bytes, and all runs of three bytes."""
    n = rows.shape[1]
    found = [_codes(rows, range(min(k + 1, n)), k) for k in range(1, 5)]
    found += [_codes(rows, range(n - min(k + 1, n), n), 10 + k) for k in range(1, 5)]
    found += [_codes(rows, range(j, j + 3), 20) for j in range(n - 2)]
    return np.stack(found, axis=1)


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length as (their places, matrix of framed bytes)."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        size = int(lengths[same[0]]) + 2
        for part in np.array_split(same, max(1, len(same) * size // 400_000)):
            joined = b"".join(b"^" + words[i] + b"$" for i in part)
            yield part, np.frombuffer(joined, dtype=np.uint8).reshape(len(part), size)


@dataclass
class Chain:
    """Weights of the field: per feature and label, per pair of labels, and the lexicon (word to its label)."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[bytes, int]

    def emissions(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), dtype=np.float32)
        for part, rows in by_length(words):
            out[part] = self.weights[_features(rows)].sum(axis=1)
        for i, w in enumerate(words):
            if (label := self.lexicon.get(w)) is not None:
                out[i] += self.weights[HASHED + label]
        return out


def forward_backward(scores: np.ndarray, active: np.ndarray, transitions: np.ndarray, forward: np.ndarray | None = None) -> np.ndarray:
    """Posteriors of the labels of many sequences at once; an array given as ``forward`` takes the forward values.

    scores: one row per word, all first words, then all second words, and so on; active[t] sequences have a word
    t, the longest stand first. Both passes are scaled to sum to one at every step.
    """
    at = np.concatenate([[0], np.cumsum(active)])
    e = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60.0)).astype(np.float64)
    a = np.exp(transitions - transitions.max())
    alpha = np.empty_like(e)
    now = e[:at[1]] / e[:at[1]].sum(axis=1, keepdims=True)
    alpha[:at[1]] = now
    for t in range(1, len(active)):
        now = (now[:active[t]] @ a) * e[at[t]:at[t + 1]]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at[t]:at[t + 1]] = now
    if forward is not None:
        forward[:] = alpha
    beta = np.ones((active[-1], e.shape[1]))
    for t in range(len(active) - 1, -1, -1):
        here = slice(at[t], at[t + 1])
        if active[t] > len(beta):
            beta = np.concatenate([beta, np.ones((active[t] - len(beta), e.shape[1]))])
        alpha[here] *= beta
        if t:
            beta = (beta * e[here]) @ a.T
            beta /= beta.sum(axis=1, keepdims=True)
    return alpha / alpha.sum(axis=1, keepdims=True)


def expected_pairs(forward: np.ndarray, post: np.ndarray, active: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """How often each label is expected to follow each other one, over all sequences.

    A pair's probability is (forward value of the earlier word) * transition * (posterior of the later word), the last
    divided by what the first two bring to its label.
    """
    a = np.exp(transitions - transitions.max())
    at = np.concatenate([[0], np.cumsum(active)])
    pairs = np.zeros_like(a)
    for t in range(1, len(active)):
        before, later = forward[at[t - 1]:at[t - 1] + active[t]], post[at[t]:at[t + 1]]
        pairs += a * (before.T @ (later / np.maximum(before @ a, 1e-300)))
    return pairs


def fit_chain(samples: list[tuple[str, list[bytes]]], seed: int = 7) -> Chain:
    """Learn weights and transitions from labelled word lists, by gradient steps on the likelihood of the chain.

    Stretches of different documents are put one behind the other, so that switches occur in training. A word is
    in the lexicon of a label if the sample has it at least three times, nine times out of ten under that label.
    """
    labels = sorted({label for label, _ in samples})
    k, rng = len(labels), np.random.default_rng(seed)
    seen: dict[bytes, Counter] = {}
    for label, words in samples:
        for w in words:
            seen.setdefault(w, Counter())[labels.index(label)] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in seen.items()
               if (n := sum(c.values())) >= 3 and c.most_common(1)[0][1] >= 0.9 * n}
    vocabulary = {w: i for i, w in enumerate(seen)}
    features: list[np.ndarray] = [np.zeros(0, np.int64)] * len(vocabulary)
    names = list(vocabulary)
    for part, rows in by_length(names):
        for i, f in zip(part, _features(rows)):
            extra = [HASHED + lexicon[names[i]]] if names[i] in lexicon else []
            features[i] = np.concatenate([f, np.array(extra, np.int64)])
    stretches = [(labels.index(label), [vocabulary[w] for w in words[i:i + STRETCH]])
                 for label, words in samples for i in range(0, len(words), STRETCH)]
    stretches = [stretches[i] for i in rng.permutation(len(stretches))]
    sequences = [stretches[i:i + 4] for i in range(0, len(stretches), 4)]

    weights, transitions = np.zeros((HASHED + k, k)), np.zeros((k, k))
    squares, t_squares = np.full(weights.shape, 1e-6), np.full((k, k), 1e-6)
    for _ in range(EPOCHS):
        for i in range(0, len(sequences), BATCH):
            rows = [(np.concatenate([np.array(ids) for _, ids in s]),
                     np.concatenate([np.full(len(ids), y) for y, ids in s])) for s in sequences[i:i + BATCH]]
            rows.sort(key=lambda r: -len(r[0]))
            active = np.array([sum(len(r[0]) > t for r in rows) for t in range(len(rows[0][0]))])
            ids = np.concatenate([[r[0][t] for r in rows[:n]] for t, n in enumerate(active)])
            truth = np.concatenate([[r[1][t] for r in rows[:n]] for t, n in enumerate(active)])
            flat = np.concatenate([features[j] for j in ids])
            owner = np.repeat(np.arange(len(ids)), [len(features[j]) for j in ids])
            scores = np.stack([np.bincount(owner, weights[flat, y], len(ids)) for y in range(k)], axis=1)
            forward = np.empty_like(scores)
            post = forward_backward(scores, active, transitions, forward)
            error = post.copy()
            error[np.arange(len(ids)), truth] -= 1
            gradient = np.stack([np.bincount(flat, error[owner, y], len(weights)) for y in range(k)], axis=1)
            gradient = gradient / len(rows) + RIDGE * weights
            squares += gradient ** 2
            weights -= RATE * gradient / np.sqrt(squares)
            pairs = expected_pairs(forward, post, active, transitions)
            at = np.concatenate([[0], np.cumsum(active)])
            for t in range(1, len(active)):
                np.add.at(pairs, (truth[at[t - 1]:at[t - 1] + active[t]], truth[at[t]:at[t + 1]]), -1.0)
            step = pairs / len(rows) + RIDGE * transitions
            t_squares += step ** 2
            transitions -= RATE * step / np.sqrt(t_squares)
    return Chain(labels, weights.astype(np.float32), transitions, lexicon)


def training_sample(docs: DataFrame, allowed: Column, key: str, text: str, label: str, per_label: int,
                    window: int) -> list[tuple[str, list[bytes]]]:
    """At most ``per_label`` documents of each label, at most ``window`` words of each, chosen by hashes."""
    known = docs.filter(allowed & F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = known.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    h = F.xxhash64(F.col(key), F.col(text))
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.size("w") - window + 1)).cast("int")
    shares = {r["label"]: min(1.0, 1.5 * per_label / r["n"]) for r in counts.collect()}
    if not shares:
        return []
    share = F.coalesce(*[F.when(F.col("label") == F.lit(n), F.lit(s)) for n, s in shares.items()])
    chosen = (known.select(F.col(label).cast("string").alias("label"), h.alias("h"), F.col(text).alias("t"))
              .filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
              .select("label", "h", F.filter(F.split("t", BLANK + "+"), lambda w: w != "").alias("w"))
              .filter(F.size("w") > 0)
              .select("label", "h", F.slice("w", start + 1, window).alias("w")))
    taken, out = Counter(), []
    for row in sorted(chosen.collect(), key=lambda r: (r["label"], r["h"])):
        taken[row["label"]] += 1
        if taken[row["label"]] <= per_label:
            out.append((row["label"], [w.encode().lower() for w in row["w"]]))
    return out


RUNS = "array<struct<start:int,end:int,lang:string>>"


class Tagger:
    """Labels batches of texts; what a word contributes is kept while the words of a task fit."""

    def __init__(self, chain: Chain, cached: int = 200_000):
        self.chain, self.cached = chain, cached
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(self.chain.labels)), np.float32)
        self.letters = np.zeros(0, bool)

    def _places(self, words: list[list[bytes]]) -> np.ndarray:
        if len(self.place) > self.cached:
            self._clear()
        fresh = list({w for ws in words for w in ws if w not in self.place})
        if fresh:
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
            self.scores = np.concatenate([self.scores, self.chain.emissions(fresh)])
            self.letters = np.concatenate([self.letters, [
                any(map(str.isalpha, w.decode("utf-8", "replace"))) for w in fresh]])
        return np.fromiter((self.place[w] for ws in words for w in ws), np.int64)

    def label(self, words: list[list[bytes]]) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
        """(language, its mean posterior, runs of words of one language, mean over words of each word's largest
        posterior) for each list of words, all non-empty."""
        labels, lengths = self.chain.labels, np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        words = [words[i] for i in order]
        ids, sizes = self._places(words), lengths[order]
        active = (len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(active)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = at[place] + owner
        timed = np.empty_like(ids)
        timed[flat] = ids
        post = forward_backward(self.scores[timed], active, self.chain.transitions)[flat]
        counted = self.letters[ids]
        sums = np.stack([np.bincount(owner[counted], post[counted, y], len(sizes)) for y in range(len(labels))], axis=1)
        n = np.bincount(owner[counted], minlength=len(sizes))
        best = post.argmax(axis=1)
        sure = np.bincount(owner[counted], post.max(axis=1)[counted], len(sizes))
        new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])]))
        runs: list[list[tuple[int, int, str]]] = [[] for _ in sizes]
        for i, j in zip(new, np.append(new[1:], len(ids))):
            runs[owner[i]].append((int(place[i]), int(place[j - 1]) + 1, labels[best[i]]))
        out: list = [None] * len(sizes)
        for d, source in enumerate(order):
            y = int(sums[d].argmax())
            out[source] = ((labels[y], min(1.0, float(sums[d, y] / n[d])), runs[d], min(1.0, float(sure[d] / n[d])))
                           if n[d] else (UNKNOWN, 0.0, runs[d], 0.0))
        return out


def _labelled(texts: pa.Array, tagger: Tagger | None) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
    """(language, score, runs, sureness of its words) per text. The longest texts come first, and only some are split at a time."""
    out: list = [(UNKNOWN, 0.0, [], 0.0)] * len(texts)
    if tagger is None:
        return out
    texts = texts.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part, words, held = [], [], 0
    for i in [*np.argsort(-sizes, kind="stable").tolist(), None]:
        mine = texts[i].as_py().lower().split() if i is not None and sizes[i] else []
        if part and (i is None or held + len(mine) > HELD // len(tagger.chain.labels)):
            for j, found in zip(part, tagger.label(words)):
                out[j] = found
            part, words, held = [], [], 0
        if mine:
            part.append(i)
            words.append(mine)
            held += len(mine)
    return out


def _fitted(docs: DataFrame, key: str, text: str, label: str, allowed: Column | None, per_label: int, window: int):
    """The fitted field as plain values, sent to the executors."""
    sample = training_sample(docs, F.lit(True) if allowed is None else allowed, key, text, label, per_label, window)
    fitted = fit_chain(sample) if sample else None
    return docs.sparkSession.sparkContext.broadcast(
        fitted and (fitted.labels, fitted.weights, fitted.transitions, fitted.lexicon))


def _tagger(chain) -> Tagger | None:
    return Tagger(Chain(*chain.value)) if chain.value else None


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
             allowed: Column | None = None, per_label: int = PER_LABEL, window: int = WINDOW) -> DataFrame:
    """One row per document: (key, lang_pred, score, runs).

    The field is fitted on a bounded sample of the labelled rows that ``allowed`` admits; every word of every
    whole text is then labelled by forward-backward. ``lang_pred`` has the largest posterior, averaged over words
    with a letter, ``score`` is that average, ``runs`` the stretches (start, end, lang) in words. NULL texts and
    texts without a letter are ``und`` with score 0; without labelled rows all are. Labels of rows, their keys
    and further columns never enter a prediction.
    """
    chain = _fitted(docs, key, text, label, allowed, per_label, window)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    @F.arrow_udf(f"lang string, score double, runs {RUNS}")
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = _tagger(chain)
        for texts in batches:
            out = _labelled(texts, tagger)
            runs = pa.array([[dict(zip(("start", "end", "lang"), r)) for r in o[2]] for o in out], kind)
            yield pa.StructArray.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), runs], ["lang", "score", "runs"])

    found = docs.select(F.col(key), tag(F.col(text)).alias("_found"))
    return found.select(key, F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"), F.col("_found.runs").alias("runs"))


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
                    least: float = 0.5, allowed: Column | None = None, per_label: int = PER_LABEL, window: int = WINDOW) -> DataFrame:
    """The documents whose words have a known language, with all their columns.

    Each word with a letter counts with its largest posterior, whichever language that is; the mean over a text is
    at least ``least``. A text that switches between languages stays if its words are clear. Without labelled rows
    nothing is fitted and nothing can be told apart: then every text with a letter stays.
    """
    chain = _fitted(docs, key, text, label, allowed, per_label, window)

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = _tagger(chain)
        for texts in batches:
            if tagger is None:
                yield pa.array([any(map(str.isalpha, t.as_py() or "")) for t in texts], pa.bool_())
            else:
                yield pa.array([lang != UNKNOWN and sure >= least for lang, _, _, sure in _labelled(texts, tagger)], pa.bool_())

    return docs.filter(known(F.col(text)))
