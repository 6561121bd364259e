"""Tag rules and entity spans against row-by-row loops."""

import random

import pytest

from featforge.functions import fixed_values as V
from featforge.operators import tags

WORDS = ["ลิง", "นายพรานป่า", "ท้าว", "พญา", "เจ้า", "_", "เรา", "ที่", "12", "๓", "บ้าน", "ไป"]


def told_in_order(words, labels):
    """The rules as they are told: one row after the other, on the labels so far."""
    p = dict(enumerate(labels))
    n = len(words)
    for i, w in enumerate(words):
        if w in V.ANIMAL_WORDS or V.HUNTER_WORD in w:
            p[i] = "0"
        if w in V.TITLE_WORDS:
            p[i] = "9"
        if w in V.RULER_WORDS:
            p[i] = "11"
        if p[i] == "12" and i > 0:
            p[i - 1] = "3"
        if w in V.SELF_WORDS:
            p[i] = "0"
        if w == V.ORDINAL_WORD and i + 2 < n and words[i + 2].isdigit():
            p[i] = "4"
        if p[i] == "4" and i + 2 < n and p[i + 2] == "17":
            p[i + 1] = "15"
    return [p[i] for i in range(n)]


@pytest.mark.parametrize("size", [6, 1 << 20])
def test_name_rules(spark, size):
    rng = random.Random(3)
    rows, want = [], {}
    for doc in range(40):
        n = rng.choice([1, 2, 3, 30, 60])
        words = [rng.choice(WORDS) if rng.random() < 0.5 else "x" for _ in range(n)]
        labels = [rng.choice(["4", "17", "12", "1", "15", "4", "17"]) for _ in range(n)]
        want.update({(doc, i): v for i, v in enumerate(told_in_order(words, labels))})
        rows += [(doc, i, w, o) for i, (w, o) in enumerate(zip(words, labels))]
    df = spark.createDataFrame(rows, "doc int, pos long, w string, o string")
    got = tags.apply_rules(df, ["doc"], "pos", "w", "o", tags.name_rules(), block_rows=size).collect()
    assert len(got) == len(want)
    assert {(r["doc"], r["pos"]): r["fixed"] for r in got} == want


def walked(rules, words, labels):
    """Any rule list, applied row after row."""
    p, n = dict(enumerate(labels)), len(words)
    for i in range(n):
        for r in rules:
            word_hit = not (r.words or r.part is not None) or words[i] is not None and (
                words[i] in r.words or r.part is not None and r.part in words[i])
            number = r.number_at is None or i + r.number_at < n and (words[i + r.number_at] or "").isdigit()
            later = r.label_at is None or i + r.label_at[0] < n and p[i + r.label_at[0]] == r.label_at[1]
            if word_hit and number and later and (r.label is None or p[i] == r.label) and 0 <= i + r.sets[0] < n:
                p[i + r.sets[0]] = r.sets[1]
    return [p[i] for i in range(n)]


@pytest.mark.parametrize("size", [3, 10, 1 << 20])
def test_any_rules_in_any_blocks(spark, size):
    """Random rule lists, NULL words, classes and groups; chains that run over many blocks."""
    rng = random.Random(size)
    names, words = ["a", "b", "c", None], ["x", "y", "yz", "1", None]
    for trial in range(3):
        rules = []
        for _ in range(6):
            rules.append(tags.Rule((rng.choice([-1, 0, 1, 1]), rng.choice("abc")), words=rng.choice([(), (), ("x",), ("y", "1")]),
                                   part=rng.choice([None, None, "z"]), label=rng.choice([None, "a", "b", "c"]),
                                   number_at=rng.choice([None, None, 1, 2]), label_at=rng.choice([None, None, (2, "a"), (3, "b")])))
        rules.append(tags.Rule((1, "a"), label="a"))
        rows, want = [], {}
        for doc in [None, *range(8)]:
            n = rng.choice([1, 2, 15, 90])
            w, p = rng.choices(words, k=n), rng.choices(names, k=n)
            want.update({(doc, i): x for i, x in enumerate(walked(rules, w, p))})
            rows += [(doc, i, a, b, "kept") for i, (a, b) in enumerate(zip(w, p))]
        df = spark.createDataFrame(rows, "doc int, pos long, w string, o string, _row string").repartition(3)
        got = tags.apply_rules(df, ["doc"], "pos", "w", "o", rules, block_rows=size).collect()
        assert {(r["doc"], r["pos"]): r["fixed"] for r in got} == want and {r["_row"] for r in got} == {"kept"}


@pytest.mark.parametrize("dealt, moved", [(True, False), (False, True)])
def test_rows_that_lie_together_stay_where_they_are(spark, monkeypatch, dealt, moved):
    """A table dealt out by group is sorted in place; only another one is shuffled, and no row goes to the function."""
    plans, keep = {}, tags.stored
    monkeypatch.setattr(tags, "stored", lambda df, name: plans.setdefault(name, df) and keep(df, name))
    df = spark.createDataFrame([(d, i, "x", "a") for d in range(6) for i in range(9)], "doc int, pos long, w string, o string")
    df = df.repartition(5, "doc") if dealt else df
    got = tags.apply_rules(df, ["doc"], "pos", "w", "o", [tags.Rule((1, "b"), label="a")], block_rows=4).collect()
    assert {(r["pos"], r["fixed"]) for r in got} == {(0, "a"), *((i, "ab"[i % 2]) for i in range(9))}
    plan = plans["ruled"]._jdf.queryExecution().executedPlan().toString()
    assert ("ENSURE_REQUIREMENTS" in plan) == moved and "MapInArrow" not in plan


def test_many_rows_and_long_chains(spark):
    """Maps with one value and maps that hand a state on, over borders of Arrow batches."""
    rng = random.Random(8)
    rules = [tags.Rule((1, "b"), label="b"), tags.Rule((1, "b"), words=("go",)), tags.Rule((0, "c"), words=("stop",))]
    rows, want = [], {}
    for doc, n in enumerate((25_000, 1, 12_000)):
        w = rng.choices(["x", "go", "stop"], weights=[5000, 3, 1], k=n)
        want.update({(doc, i): x for i, x in enumerate(walked(rules, w, ["a"] * n))})
        rows += [(doc, i, a, "a") for i, a in enumerate(w)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc int, pos long, w string, o string")
    for size in (7_000, 1 << 20):
        got = tags.apply_rules(df, ["doc"], "pos", "w", "o", rules, block_rows=size).collect()
        assert {(r["doc"], r["pos"]): r["fixed"] for r in got} == want


def test_rules_that_reach_too_far(spark):
    df = spark.createDataFrame([], "d int, p long, w string, o string")
    for rule in (tags.Rule((2, "a")), tags.Rule((0, "a"), label_at=(1, "b"))):
        with pytest.raises(ValueError, match="reaches"):
            tags.apply_rules(df, ["d"], "p", "w", "o", [rule])
    assert tags.apply_rules(df, ["d"], "p", "w", "o", [tags.Rule((0, "a"))]).collect() == []


def spans_of(seq):
    """Entities of one tag list, found by walking over it."""
    out, start, prev = set(), None, ("O", "")
    for i, tag in enumerate([*seq, "O"]):
        kind, typ = tag[0], tag[1:]
        ends = prev[0] in "ES" or (prev[0] in "BI" and kind in "BSO") or (prev[0] != "O" and prev[1] != typ)
        begins = kind in "BS" or (prev[0] in "ESO" and kind in "EI") or (kind != "O" and prev[1] != typ)
        if i > 0 and ends:
            out.add((prev[1], start, i - 1))
        if begins:
            start = i
        prev = (kind, typ)
    return out


@pytest.mark.parametrize("size", [4, 1 << 20])
def test_entity_spans(spark, size):
    rng = random.Random(5)
    rows, want = [], set()
    for doc in range(30):
        seq = [rng.choice(["O", "B_P", "I_P", "E_P", "B_L", "I_L", "E_L"]) for _ in range(rng.choice([1, 5, 25]))]
        rows += [(doc, i, t) for i, t in enumerate(seq)]
        want |= {(doc, *s) for s in spans_of(seq)}
    df = spark.createDataFrame(rows, "doc int, pos long, tag string")
    got = {(r["doc"], r["type"], r["start"], r["end"])
           for r in tags.entity_spans(df, ["doc"], "pos", ["tag"], size).collect()}
    assert got == want


@pytest.mark.parametrize("size", [5, 1 << 20])
def test_spans_read_every_row_once(spark, size):
    """Two tag columns, NULL groups and tags, spans over several blocks."""
    rng = random.Random(size)
    rows, want = [], set()
    for doc in [None, *range(6)]:
        n = rng.choice([1, 7, 40])
        for name in ("p", "y"):
            seq = [rng.choice(["O", None, "B_P", "E_P"] + ["I_P"] * 12) for _ in range(n)]
            want |= {(doc, name, *s) for s in spans_of([t or "O" for t in seq])}
            rows.append(seq)
        rows[-2:] = [(doc, i, p, y) for i, (p, y) in enumerate(zip(*rows[-2:]))]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.createDataFrame(rows, "doc int, pos long, p string, y string").coalesce(1).mapInPandas(count, "doc double, pos long, p string, y string")
    spans = tags.entity_spans(df.withColumn("doc", df["doc"].cast("int")), ["doc"], "pos", ["p", "y"], size)
    assert {tuple(r) for r in spans.select("doc", "column", "type", "start", "end").collect()} == want
    assert read.value == len(rows)


def test_tag_list_order(spark):
    df = spark.createDataFrame([("['E_A', 'B_Z', 'O', 'X_Q', 'I_A', 'B_A']\n",)], "v string")
    got = df.select(tags.tag_list(df["v"]).alias("t")).first()["t"]
    assert got == ["O", "B_Z", "B_A", "I_A", "E_A"]
