import itertools
import random

from featforge.llm import decontaminate as D


def test_masks_miss_no_window_with_two_changed_words():
    sites = [{o + i for i, c in enumerate(m) if c == "1"} for m in D.MASKS for o in range(D.WINDOW - len(m) + 1)]
    allowed = D.WINDOW - D.needed(D.WINDOW)
    assert allowed == 2
    for changed in itertools.combinations(range(D.WINDOW), allowed):
        assert any(not site & set(changed) for site in sites)


def test_masks_of_short_items_miss_nothing():
    for n in range(D.SHORTEST, D.WINDOW):
        (mask,) = D.masks_for(n)
        for changed in itertools.combinations(range(n), n - D.needed(n)):
            assert any(not set(range(o, o + len(mask))) & set(changed) for o in range(n - len(mask) + 1))


def brute(docs, items):
    """Pairs that share a window at some alignment, by trying all alignments."""
    out = set()
    for d, text in docs:
        w = D.words_of((text or "").encode())
        for i, t in items:
            v = D.words_of((t or "").encode())
            if len(v) < D.SHORTEST:
                continue
            width = min(D.WINDOW, len(v))
            for diagonal in range(-len(v), len(w) + 1):
                same = [0 <= j + diagonal < len(w) and w[j + diagonal] == v[j] for j in range(len(v))]
                if any(sum(same[s:s + width]) >= D.needed(width) for s in range(len(v) - width + 1)):
                    out.add((d, i))
    return out


def tables(spark, docs_of):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "Straße"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 7, 9, 12, 13, 30, 60])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, items[5][1]), (None, items[6][1])]
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(0, 60))
        if rng.random() < 0.6:
            passage = (rng.choice(items[:40])[1]).split()
            a = rng.randrange(0, max(1, len(passage) - 13))
            passage = passage[a:a + rng.randrange(5, 40)]
            for _ in range(rng.randrange(0, 1 + len(passage) // 5)):
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary).upper()
            words[len(words) // 2:len(words) // 2] = [p + rng.choice(["", ",", "!"]) for p in passage]
        docs.append((d, " ".join(words)))
    docs += [(500, None), (501, ""), (None, items[8][1])]
    return docs, items, docs_of(docs), spark.createDataFrame(items, "item_id long, text string")


def test_overlaps_against_all_alignments(spark, docs_of):
    docs, items, df, benchmark = tables(spark, docs_of)
    got = D.overlaps(df, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got}) > 40
    texts = dict(docs)
    for r in got:
        assert 0 <= r["start"] < r["end"] <= len(D.words_of(texts[r["doc_id"]].encode()))


def test_blocks_give_the_same(spark, docs_of, monkeypatch):
    docs, items, df, benchmark = tables(spark, docs_of)
    want = {(r["doc_id"], r["item_id"]) for r in D.overlaps(df, benchmark).collect()}
    blocks = list(D.index_blocks(benchmark, "item_id", "text", 7))
    assert len(blocks) > 3
    monkeypatch.setattr(D.index_blocks, "__defaults__", (7,))
    assert {(r["doc_id"], r["item_id"]) for r in D.overlaps(df, benchmark).collect()} == want
    clean = {r["doc_id"] for r in D.drop_contaminated(df, benchmark).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_edge_cases(spark, docs_of, clashing):
    text = " ".join(f"word{i}" for i in range(30))
    benchmark = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = clashing(docs_of([(1, text), (1, text), (2, None), (3, "clean text of some words that nobody has asked for at all"), (None, text)]))
    out = D.drop_contaminated(docs, benchmark)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3]
    assert D.overlaps(docs, benchmark).count() == 3
    assert D.overlaps(docs_of([]), benchmark).count() == 0
    assert D.overlaps(docs, benchmark.limit(0)).count() == 0
    assert D.drop_contaminated(docs, benchmark.limit(0)).count() == 5
    assert D.overlaps(docs_of([(5, "x " * 200000 + text)]), benchmark).count() == 1
