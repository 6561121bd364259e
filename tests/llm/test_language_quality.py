import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featforge.llm import language as L
from featforge.llm import quality as Q
from featforge.llm.common import fold

SYLLABLES = {"en": ["the", "th", "ing", "er", "on"], "de": ["sch", "ung", "ein", "keit", "ö"], "fr": ["eau", "que", "é", "oi", "ment"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


@pytest.mark.parametrize("scale", [0.3, 1.0, 4.0])
def test_transition_gradient_equals_differences(scale):
    """Expected pairs are the derivative of the log of the sum over all paths."""
    rng = np.random.default_rng(1)
    lengths = [6, 4, 1]
    scores, transitions = [rng.normal(size=(n, 3)) * scale for n in lengths], rng.normal(size=(3, 3)) * scale
    active = np.array([sum(n > t for n in lengths) for t in range(6)])
    timed = np.concatenate([[scores[s][t] for s in range(n)] for t, n in enumerate(active)])

    def log_sum(tr):
        total = 0.0
        for e in scores:
            now = e[0]
            for x in e[1:]:
                now = np.log(np.exp(now[:, None] + tr).sum(axis=0)) + x
            total += np.log(np.exp(now).sum())
        return total

    forward = np.empty_like(timed)
    pairs = L.expected_pairs(forward, L.forward_backward(timed, active, transitions, forward), active, transitions)
    for i in range(3):
        for j in range(3):
            step = np.zeros((3, 3))
            step[i, j] = 1e-5
            assert pairs[i, j] == pytest.approx((log_sum(transitions + step) - log_sum(transitions - step)) / 2e-5, abs=1e-6)
    assert pairs.sum() == pytest.approx(5 + 3)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    lengths, k = [4, 3, 3, 1], 3
    scores = [rng.normal(size=(n, k)) * 3 for n in lengths]
    transitions = rng.normal(size=(k, k))
    active = np.array([sum(n > t for n in lengths) for t in range(max(lengths))])
    timed = np.concatenate([[s[t] for s in scores if len(s) > t] for t in range(max(lengths))])
    post = L.forward_backward(timed, active, transitions)
    at = np.concatenate([[0], np.cumsum(active)])
    for d, s in enumerate(scores):
        want, total = np.zeros((len(s), k)), 0.0
        for path in itertools.product(range(k), repeat=len(s)):
            p = np.exp(sum(s[t, y] for t, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                want[t, y] += p
        got = np.stack([post[at[t] + d] for t in range(len(s))])
        assert np.allclose(got, want / total, atol=1e-6)


def labelled(rng, n=240):
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.randrange(5, 60)), lang))
    return rows


def test_languages_of_held_out_texts_and_of_mixed_ones(docs_of):
    rng = random.Random(5)
    rows = labelled(rng)
    mixed = prose(rng, "en", 25) + " " + prose(rng, "de", 20)
    rows += [(1000, mixed, None), (1001, None, "en"), (1002, "", "en"), (1003, "123 -- !!", "en"), (1004, "12 " + prose(rng, "fr", 9), None),
             (1005, prose(rng, "en", 30000), None)]
    held = fold("doc_id", 5) == 0
    got = {r["doc_id"]: r for r in L.identify(docs_of(rows), allowed=~held, per_label=40).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:240])
    assert [got[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3
    assert [got[i]["score"] for i in (1001, 1002, 1003)] == [0.0] * 3
    assert got[1004]["lang_pred"] == "fr" and got[1005]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    runs = got[1000]["runs"]
    assert runs[0]["lang"] == "en" and runs[-1]["lang"] == "de" and abs(runs[-1]["start"] - 25) <= 2 and runs[-1]["end"] == 45


def test_labels_of_the_scored_rows_do_not_matter(docs_of):
    rows = labelled(random.Random(6), 100)
    held = fold("doc_id", 5) == 0
    one = {r["doc_id"]: r["score"] for r in L.identify(docs_of(rows), allowed=~held).collect()}
    crc = {r["doc_id"] for r in docs_of(rows).filter(held).collect()}
    other = [(i, t, "xx" if i in crc else lang, "other") for i, t, lang in rows]
    assert one == {r["doc_id"]: r["score"] for r in L.identify(docs_of(other), allowed=~held).collect()}


def test_language_filter(docs_of, clashing):
    rows = labelled(random.Random(7), 60) + [(100, None, "en"), (101, "123", "en"), (1, "", None)]
    docs = clashing(docs_of(rows))
    out = L.keep_identified(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(60))
    assert L.identify(docs_of([])).count() == 0
    assert {r["lang_pred"] for r in L.identify(docs_of([(1, "words", None)])).collect()} == {"und"}


def test_language_filter_keeps_texts_that_switch(docs_of):
    rng = random.Random(11)
    rows = labelled(rng) + [(1000, " ".join(prose(rng, lang, 25) for lang in sorted(SYLLABLES)), None)]
    found = {r["doc_id"]: r["score"] for r in L.identify(docs_of(rows)).collect()}
    assert found[1000] < 0.5
    assert sorted(r["doc_id"] for r in L.keep_identified(docs_of(rows)).collect()) == [*range(240), 1000]


def test_language_filter_without_any_label(docs_of):
    rows = [(1, "some words", None), (2, "123 \u00e9", None), (3, "123 -- !!", None), (4, "", None), (5, None, None)]
    assert sorted(r["doc_id"] for r in L.keep_identified(docs_of(rows)).collect()) == [1, 2]


def test_small_parts_give_the_same(docs_of, monkeypatch):
    rows = labelled(random.Random(8), 80)
    chain = L.fit_chain([(lang, t.encode().lower().split()) for _, t, lang in rows])
    words = [t.encode().lower().split() for _, t, _ in rows]
    whole = L.Tagger(chain).label(words)
    one = [L.Tagger(chain).label([w])[0] for w in words]
    assert [w[0] for w in whole] == [w[0] for w in one]
    assert np.allclose([w[1] for w in whole], [w[1] for w in one], atol=1e-6)
    assert [w[2] for w in whole] == [w[2] for w in one]


def test_flat_trees_against_walking_them():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    forest = Q.fit(x, y, trees=25)
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.97

    def walk(row):
        total = forest.start
        for f, c, v in zip(forest.feature, forest.cut, forest.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))
    assert np.allclose(forest.score(x[:50]), [walk(r) for r in x[:50]])


def test_quality_of_held_out_texts(spark, docs_of):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = prose(rng, "en", rng.randrange(3, 80))
        rows.append((i, text if good else " ".join(w + rng.choice(["!!", "%%%", "&&&"]) for w in text.upper().split())))
        labels.append((i, int(good)))
    truth = dict(labels)
    labels += [(3, None), (9999, 1), (None, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    rows += [(700, None), (701, ""), (1, rows[1][1])]
    held = fold("doc_id", 3) == 1
    got = Q.score(docs_of(rows), Q.train(docs_of(rows), table, ~held)).select("doc_id", "score", held.alias("held")).collect()
    assert len(got) == len(rows)
    out = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert len(out) > 80 and sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_quality_without_labels_and_rows(spark, docs_of, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = clashing(docs_of([(1, "a b"), (2, None), (None, "x" * 300000)]))
    forest = Q.train(docs, none, F.lit(True))
    assert [r["score"] for r in Q.score(docs, forest).collect()] == [0.5] * 3
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r["score"] > 0.5 for r in Q.score(docs, Q.train(docs, one, F.lit(True))).collect())
    assert Q.score(docs_of([]), forest).count() == 0


def test_rows_to_learn_from_are_not_chosen_by_chance(spark):
    labels = spark.createDataFrame([(i, int(i == 0)) for i in range(5)], "doc_id long, quality int")
    others = [(i, f"text {i}") for i in range(1, 5)]

    def start(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        return Q.train(docs, labels, F.lit(True), sample=5).start

    assert start([(0, "same")] * 50 + others) == start([(0, "same")] + others)
    rows = [(0, f"other {i}") for i in range(12)] + others
    assert start(rows) == start(rows[::-1])
