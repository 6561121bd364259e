import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from featforge.llm import collocations
from featforge.llm.collocations import Trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(" ".join(w[i:i + size]) for i in range(len(w) - size + 1))
    return f, n


def brute(rows, least=10, top=2000):
    f, n = counts(rows)
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if " " in p and a >= least}
        kept = []
        for p, a in found.items():
            w = p.split(" ")
            if any(100 * b >= 50 * a for q, b in found.items() if len(q.split(" ")) > len(w)
                   and any(q.split(" ")[i:i + len(w)] == w for i in range(2))):
                continue
            cuts = []
            for k in range(1, len(w)):
                left, right = own[" ".join(w[:k])], own[" ".join(w[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            kept.append((-score, -a, p.encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "the", "The", "naïve", "\x01x", "a b", "x-y"]
    rows = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            parts.append(rng.choices(words, k=rng.randrange(1, 9)) if rng.random() < 0.6 else rng.choice(
                [["new", "york", "city"], ["Of", "the"], ["of", "the", "of", "the"], ["ha"] * 5, ["per", "cent"]]))
        rows.append((rng.choice([".", ", ", ";\n", "\t!", " \r\n", "? ", "\x0b"]).join(" ".join(p) for p in parts),
                     rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), (" \t\n", "fr"), ("...", None)]


@pytest.mark.parametrize("entries", [1_000_000, 400])
def test_against_brute_force(docs_of, clashing, monkeypatch, entries):
    """With little room, tries burst, spill and start anew all the time."""
    if entries < 1000:
        monkeypatch.setattr(collocations, "BURST", 8)
    rows = corpus()
    docs = docs_of([(i, t, lang) for i, (t, lang) in enumerate(rows)])
    got = collocations.collocations(clashing(docs), entries=entries).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    few = collocations.collocations(docs, top=3, entries=entries).collect()
    assert sorted(tuple(r) for r in few) == brute(rows, top=3)


def test_all_counts_and_totals(docs_of):
    rows = corpus(8)
    f, n = counts(rows)
    got = collocations.phrase_counts(docs_of([(i, t, lang) for i, (t, lang) in enumerate(rows)]), least=1).collect()
    assert {(r["lang"], r["phrase"]): r["f"] for r in got if r["size"]} == {(lang, p): a for lang, c in f.items() for p, a in c.items()}
    assert {r["lang"]: r["f"] for r in got if not r["size"]} == {k: v for k, v in n.items() if v}
    assert len(got) == sum(map(len, f.values())) + sum(v > 0 for v in n.values())


def test_long_pieces_are_counted_across_stretches(monkeypatch):
    """Stretches end inside pieces and tries start anew there; no phrase is lost or made up."""
    rng = random.Random(2)
    long = " ".join(rng.choices(["a", "b", "c", "dd", "eé"], k=3000)) + ". " + "x" * 500 + " " + " ".join(["y", "z"] * 200)
    rows = [(long, "en"), (long[::-1], "de"), ("tail" * 300, "en"), (long[:50], "en")]
    want, _ = counts(rows)
    batch = pa.RecordBatch.from_arrays([[r[1] for r in rows], [r[0].encode() for r in rows]], ["lang", "text"])
    for window, entries in ((64, 100), (64, 1_000_000), (7, 300)):
        monkeypatch.setattr(collocations, "WINDOW", window)
        runs = [b for b in collocations._count([batch], 4, entries)]
        table = pa.Table.from_batches(runs).sort_by("part").combine_chunks()
        got = [r for b in collocations._merge(table.to_batches(), 1) for r in b.to_pylist()]
        assert {(r["lang"], r["phrase"].decode()): r["f"] for r in got if r["size"]} == {
            (lang, p): a for lang, c in want.items() for p, a in c.items()}


def test_burst_containers_keep_their_counts(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 3)
    trie, words = Trie(), [b"a", b"b", b"a", b"c", b"a", b"b", b"d", b"a", b"a"] * 4
    want = Counter()
    for i in range(0, len(words), 5):
        w = words[i:i + 5]
        trie.add(b" ".join(w))
        for size in (1, 2, 3):
            want.update(tuple(w[j:j + size]) for j in range(len(w) - size + 1))
    assert any(isinstance(b, collocations.Burst) for b in trie.below)
    a, b, c, n = trie.take(list(range(1, len(trie.words))))
    got = {tuple(trie.words[x] for x in t if x): int(k) for *t, k in zip(a, b, c, n)}
    assert got == want and trie.sizes().sum() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of some 10**12 give exact scores."""
    rows = [("en", 0, "", 10**13), ("en", 1, "x", 3 * 10**12 + 1), ("en", 1, "y", 10**12 + 7), ("en", 2, "x y", 10**12 + 3)]
    counted = spark.createDataFrame(rows, "lang string, size int, phrase string, f long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: counted)
    got = collocations.collocations(counted).collect()
    a, left, right = 10**12 + 3, 3 * 10**12 + 1, 10**12 + 7
    assert [tuple(r) for r in got] == [("en", 1, "x y", a, left, right, 10**13, 10**6 * a * a // (left * right))]


def test_empty_table(docs_of):
    assert collocations.collocations(docs_of([(1, "x")]).filter("false")).collect() == []
    assert collocations.collocations(docs_of([(1, None), (2, "")])).collect() == []
