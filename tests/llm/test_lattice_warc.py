import hashlib
import math
import random
import struct
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from featforge.llm import lattice as L
from featforge.llm import warc as A
from featforge.llm.common import fold


def every_segmentation(word, log_p):
    """Probability of a word, summed over its segmentations one by one."""
    @lru_cache(None)
    def rest(i):
        if i == len(word):
            return 1.0
        return sum(math.exp(log_p[word[i:j]]) * rest(j) for j in range(i + 1, len(word) + 1) if word[i:j] in log_p)
    return rest(0)


def small_vocabulary():
    rng = random.Random(2)
    pieces = [bytes([b]) for b in range(256)] + [b"th", b" th", b"the", b" the", b"he", b"ab", b"aba", "é".encode(), b"x" * 16]
    p = np.array([rng.random() for _ in pieces])
    return pieces, np.log(p / p.sum())


def test_forward_sums_all_segmentations():
    pieces, log_p = small_vocabulary()
    table = dict(zip(pieces, log_p))
    words = [b"the", b"t", b"ababa", "thé".encode(), b"theabthe", b"x" * 40, b"\xff\xfe", b"the"]
    got = L.Lattice(pieces, log_p).log_probability(words)
    assert np.allclose(got, [math.log(every_segmentation(b" " + w, table)) for w in words])


def test_pieces_of_any_length_take_part(spark, monkeypatch):
    pieces, log_p = small_vocabulary()
    pieces, log_p = pieces + [b" " + b"ab" * 16, b"the" * 7], np.append(log_p, [-2.0, -3.0])
    table = dict(zip(pieces, log_p))
    words = [b"ab" * 16, b"x" + b"the" * 7, b"ab" * 15]
    want = [math.log(every_segmentation(b" " + w, table)) for w in words]
    lattice = L.Lattice(pieces, log_p)
    assert np.allclose(lattice.log_probability(words), want)
    monkeypatch.setattr(L, "LONG_WORD", 5)
    assert np.allclose(lattice.log_probability(words), want)
    read = L.read_pieces(spark)
    assert b" responsibilities" in read and max(map(len, read)) == 33


def test_long_words_agree_with_batches(monkeypatch):
    pieces, log_p = small_vocabulary()
    lattice = L.Lattice(pieces, log_p)
    rng = random.Random(3)
    words = [bytes(rng.choices(b"theab", k=rng.randrange(1, 120))) for _ in range(60)]
    counts = np.array([rng.randrange(1, 9) for _ in words], float)
    a, b = lattice.log_probability(words), lattice.expected(words, counts)
    monkeypatch.setattr(L, "LONG_WORD", 5)
    assert np.allclose(lattice.log_probability(words), a)
    assert np.allclose(lattice.expected(words, counts), b)
    assert np.isfinite(lattice.log_probability([b"the" * 30000])[0])


def test_expected_uses_are_the_derivative():
    pieces, log_p = small_vocabulary()
    words, counts = [b"thethe", b"abab"], np.array([2.0, 3.0])
    uses = L.Lattice(pieces, log_p).expected(words, counts)
    for i in (pieces.index(b"the"), pieces.index(b"ab"), pieces.index(b" ")):
        moved = log_p.copy()
        moved[i] += 1e-5
        step = (L.Lattice(pieces, moved).log_probability(words) - L.Lattice(pieces, log_p).log_probability(words)) @ counts
        assert abs(step / 1e-5 - uses[i]) < 1e-3


def scored(docs, held=None):
    held = fold("doc_id", 7) == 2 if held is None else held
    model = L.train(docs, held)
    return model, L.score(docs, model).select("*", held.alias("held")).collect()


def test_base_score_and_counts_against_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(L, "FREQUENT", 40)
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "été", "ÉTÉ", "x" * 60] + [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))) for i in range(150)] + [(900, None), (901, " \t\n"), (902, "y" * 3000)]
    docs = docs_of(rows)
    model, got = scored(docs)
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", (fold("doc_id", 7) == 2).alias("h")).collect()}
    tokens = {k: (t or "").encode().lower().split() + ["end"] for k, t in rows}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.distinct) == (n, v)
    assert len(got) == len(rows)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert r["n_tokens"] == len(ws) and r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
        assert r["score"] < 0
    by_words = {r["word"]: r["lat"] for r in model.words.collect()}
    for r in got:
        want = sum(by_words[w if w != "end" else b""] for w in tokens[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-6 * max(1, abs(want))


def test_repeated_rows_null_keys_empty_tables(docs_of, clashing):
    docs = clashing(docs_of([(1, "a b")] * 3 + [(None, "a"), (2, None), (2, "other text")]))
    _, got = scored(docs)
    assert len(got) == 6
    ones = [r for r in got if r["doc_id"] == 1]
    assert len(ones) == 3 and len({r["score"] for r in ones}) == 1 and ones[0]["n_tokens"] == 3
    assert scored(docs_of([]))[1] == []
    _, untrained = scored(docs, F.lit(True))
    assert all(r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in untrained)


def test_training_raises_the_score_of_held_out_texts(docs_of):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices(["th", "ing", "er", "on"], k=3)) for _ in range(30))) for i in range(200)]
    docs = docs_of(rows)
    held = fold("doc_id", 7) == 2
    trained = [r["score"] for r in scored(docs)[1] if r["held"]]
    plain = [r["score"] for r in scored(docs, F.lit(True))[1] if r["doc_id"] in
             {d["doc_id"] for d in docs.filter(held).collect()}]
    assert sum(trained) > 0.8 * sum(plain)


PAGES = "page_id long, url string, html string"


def pages(spark):
    rng = random.Random(6)
    body = "<p>" + "same payload " * 20 + "</p>"
    rows = [(i, f"http://h/{i}?ä={i} x\r\n", f"<html>{i} " + "lorem ipsum " * rng.randrange(0, 200)) for i in range(60)]
    rows += [(100 + i, None, body) for i in range(30)] + [(200, "u", "short"), (201, "u", "short"), (202, "u", None), (203, "u", "é" * 50),
             (204, None, "é" * 50), (300, "twin", body + "2"), (300, "twin", body + "2"), (301, "x", "a" * 300000), (None, "n", body)]
    return rows, spark.createDataFrame(rows, PAGES).repartition(3)


def test_round_trip_and_revisits(spark):
    rows, df = pages(spark)
    got = A.resolved(A.archive_and_read(df)).collect()
    assert len(got) == len(rows)
    first = {}
    for k, _, html in rows:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    want = Counter()
    for k, _, html in rows:
        payload = (html or "").encode()
        refers = first[html or ""] if len(payload) >= 100 and first[html or ""] != k else None
        want[k, len(payload), hashlib.sha256(payload).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert Counter((r["key"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in got) == want


def test_payloads_come_back_whole(spark):
    rows, df = pages(spark)
    back = {r["key"]: bytes(r["payload"]) for r in A.archive_and_read(df).collect() if r["record_type"] == "response"}
    assert back[301] == b"a" * 300000 and back[202] == b"" and back[5].decode() == rows[5][2]


def test_archives_as_files(spark, tmp_path):
    _, df = pages(spark)
    stored = A.write_archives(A.with_revisits(df)).collect()
    for r in stored:
        (tmp_path / r["path"]).write_bytes(r["content"])
    assert any(r["content"][:4] == struct.pack("<I", A.DICTIONARY_FRAME) for r in stored)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(str(tmp_path))
    read = A.read_archives(files)
    assert read.count() == df.count() and read.filter("fault is not null").count() == 0


def records(n=40):
    return [A.record_bytes(i, f"http://h/{i}", (f"<p>{i}</p>" * 30).encode(), hashlib.sha256((f"<p>{i}</p>" * 30).encode()).hexdigest(), None)
            for i in range(n)]


def test_one_frame_per_record_and_compressed_dictionary():
    packed = A.pack(records())
    assert [r for r, _ in A.frames(packed)] == records()
    size = struct.unpack_from("<I", packed, 4)[0]
    inner = zstandard.compress(packed[8:8 + size])
    again = struct.pack("<II", A.DICTIONARY_FRAME, len(inner)) + inner + packed[8 + size:]
    assert [r for r, _ in A.frames(again)] == records()
    assert [r for r, _ in A.frames(A.pack(records(2)))] == records(2)


@pytest.mark.parametrize("spoil, fault", [
    (lambda p: p[:-3], "cut off"), (lambda p: p[:len(p) // 2] + b"\x00" * 40 + p[len(p) // 2 + 40:], ""), (lambda p: p[:10], "cut off")])
def test_broken_archives_give_faults(spoil, fault):
    out = list(A.frames(spoil(A.pack(records()))))
    assert out[-1][0] is None and fault in out[-1][1]


def test_records_are_validated():
    good = records(1)[0]
    assert A.parse(good)[2] is None
    assert A.parse(good[:-1])[2] == "wrong length"
    assert A.parse(b"nothing")[2] == "no WARC head"
    assert A.parse(good.replace(b"WARC-Date", b"X-Date"))[2] == "no warc-date"
    assert A.parse(good.replace(b"<p>0", b"<p>1"))[2] == "wrong digest"
    revisit = A.record_bytes(1, "u", b"x", "00", 5).replace(b"WARC-Refers-To:", b"X-Refers-To:")
    assert A.parse(revisit)[2] == "revisit without target"


def test_empty_inputs(spark):
    assert A.resolved(A.archive_and_read(spark.createDataFrame([], PAGES))).count() == 0
    assert A.read_archives(spark.createDataFrame([("a", None), ("b", b"")], "path string, content binary")).count() == 0


def test_archive_of_text_keys_is_refused(spark):
    pages = spark.createDataFrame([("a", "u", "x" * 200)], "page_id string, url string, html string")
    with pytest.raises(ValueError, match="integers"):
        A.with_revisits(pages)


def test_one_large_group_of_equal_payloads(spark):
    rows = [(i, f"u{i % 3}", "same " * 50 if i % 2 else f"page {i} " * 30) for i in range(1, 400)] + [(None, "u", "same " * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = A.resolved(A.archive_and_read(pages)).collect()
    assert len(got) == 400 and sum(r["record_type"] == "revisit" for r in got) == 200
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {1}
