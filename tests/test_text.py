import pytest
from pyspark.sql import functions as F

from featforge.functions import fixed_values as V
from featforge.functions import text as X
from featforge.operators import sequence
from featforge.sources import readers


def names_of(spark, text):
    df = spark.createDataFrame([(text,)], "c string")
    return df.select(X.clean_names(F.col("c")).alias("n")).first()["n"]


@pytest.mark.parametrize("text, want", [
    (None, []),
    ("", []),
    ("บัณฑิตา (Banthita) หล่อนิมิตดี (Lornimiddee)", ["บัณฑิตา หล่อนิมิตดี", "Banthita Lornimiddee"]),
    ("สมพร ใจดี (Somporn Jaidee)", ["สมพร ใจดี", "Somporn Jaidee"]),
    ("นัฏยา ประดับการ Nattaya Pradubkarn", ["นัฏยา ประดับการ", "Nattaya Pradubkarn"]),
    ("JEAN SMITH,bOB  jones , et al,et al, Vol.12 No.3", ["Jean Smith", "Bob Jones"]),
    ("กัลยา บุญหล้า และศศิธร โกฎสืบ", ["กัลยา บุญหล้า", "ศศิธร โกฎสืบ"]),
    ("Mr.Tom Ford, Dr. Ann Lee", ["Tom Ford", "Ann Lee"]),
    ("A.B. McDaniel,LE-THANH Van", ["A.B. McDaniel", "Le-Thanh Van"]),
    ("Ann MA, MAX Lee", ["Ann", "Max Lee"]),
    ("นายสมชาย ดีงาม,ผศ.ดร.สุดา งามดี", ["สมชาย ดีงาม", "สุดา งามดี"]),
    ("Ann Lee [Editor] Bob Ray", ["Ann Lee", "Editor Bob Ray"]),
    ("X and Other Y", ["X Y"]),
])
def test_clean_names(spark, text, want):
    assert names_of(spark, text) == want


def test_stop_entry_is_compared_before_trimming(spark):
    df = spark.createDataFrame([(["   ", " ", "", "a"],)], "e array<string>")
    kept = df.select(F.transform(X.not_stopped(F.col("e")), X.strip).alias("e")).first()["e"]
    assert kept == ["", "a"]


@pytest.mark.parametrize("entry, want", [
    ("a (b)", ["a", "b"]), ("a (b c)", ["a", "b c"]), ("a (b-c)", ["a (b-c)"]), ("a (b-c d)", ["a", "b-c d"]),
    ("a (b", ["a (b"]), ("(b)", ["(b)"]), ("a (b) c (d) e (f)", ["a (b) c (d) e (f)"]), ("a (b) rest ) tail", ["a", "b"]),
    ("a (b) c (d tail", ["a", "b"]), ("a () b (c)", [") b", "c"]),
])
def test_split_aliases(spark, entry, want):
    df = spark.createDataFrame([([entry],)], "e array<string>")
    assert df.select(X.split_aliases(F.col("e")).alias("e")).first()["e"] == want


def test_long_text_without_alias_is_fast(spark):
    df = spark.range(1).select(F.array(F.concat(F.lit("a (b) "), F.repeat(F.lit("word "), 100_000))).alias("e"))
    assert df.select(F.size(X.split_aliases(F.col("e"))).alias("n")).first()["n"] == 2


def test_name_case(spark):
    df = spark.createDataFrame([(" JEAN-marc  o'BRIEN\tof McDaniel ßen ",)], "n string")
    assert df.select(X.name_case(F.col("n")).alias("n")).first()["n"] == "Jean-marc O'brien of McDaniel Ssen"


def test_literal_rules_collapse_blanks_without_trimming(spark):
    df = spark.createDataFrame([("Phra  A    B .",), (None,)], "n string")
    assert [r["n"] for r in df.select(X.apply_literals(F.col("n")).alias("n")).collect()] == [" A B", None]


def test_strip_and_marks(spark):
    df = spark.createDataFrame([("  a b  ",), ("",), (None,)], "w string")
    got = df.select(X.blank_to_mark(X.strip_line(F.col("w"))).alias("w")).collect()
    assert [r["w"] for r in got] == ["ab", "_", "_"]


def test_all_digits(spark):
    df = spark.createDataFrame([("12",), ("๓๔",), ("1a",), ("",)], "w string")
    assert [r[0] for r in df.select(X.all_digits(F.col("w"))).collect()] == [True, True, False, False]


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.d.txt",), ("x",)], "p string")
    got = df.select(X.base_name(F.col("p")), X.stem(X.base_name(F.col("p"))), X.extension(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("c.d.txt", "c", "txt"), ("x", "x", None)]
    df = spark.createDataFrame([("a\\b\\c.txt",)], "p string")
    assert df.select(X.base_name(F.col("p"), "\\")).first()[0] == "c.txt"


def test_read_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\n\n two  \nlast", encoding="utf-8")
    got = readers.read_lines(spark, str(tmp_path), drop_last=True).orderBy("pos").collect()
    assert [(r["pos"], r["word"]) for r in got] == [(0, "one"), (1, "_"), (2, "two")]
    (tmp_path / "t.txt").write_text("one\n two\n", encoding="utf-8")
    for drop_last, want in ((True, ["one", "two"]), (False, ["one", "two", "_"])):
        assert [r["word"] for r in readers.read_lines(spark, str(tmp_path), drop_last).orderBy("pos").collect()] == want


def test_read_lines_of_a_file_larger_than_a_split(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(5000)), encoding="utf-8")
        (tmp_path / "b.txt").write_text("x\ny", encoding="utf-8")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = readers.read_lines(spark, str(tmp_path), drop_last=True).orderBy("source_file", "pos").collect()
        assert [(r["pos"], r["word"]) for r in got] == [(i, f"line {i}") for i in range(5000)] + [(0, "x")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("n, want", [(49, None), (50, (0, 50)), (51, (1, 51)), (52, (1, 51)), (53, (2, 52)), (55, (3, 53))])
def test_clip(spark, n, want):
    df = spark.createDataFrame([(list(range(n)),)], "a array<int>")
    got = df.select(sequence.clip(F.col("a"), 50).alias("c")).first()["c"]
    assert got == (None if want is None else list(range(*want)))


def test_chunks_pad_argmax_one_hot(spark):
    df = spark.createDataFrame([(list("abcde"), [1, 3, 3]), ([], [])], "w array<string>, s array<int>")
    got = df.select(sequence.chunk_array(F.col("w"), 2).alias("c"), sequence.pad(F.col("s"), 5, 0).alias("p"),
                    sequence.argmax(F.col("s")).alias("a"), sequence.one_hot(F.lit(1), 3).alias("h")).collect()
    assert got[0]["c"] == [["a", "b"], ["c", "d"], ["e"]] and got[1]["c"] == []
    assert got[0]["p"] == [1, 3, 3, 0, 0] and got[0]["a"] == 1 and got[0]["h"] == [0, 1, 0]


def test_quick_patterns_are_the_same_patterns(spark):
    """Every alternative of the name rules, at the start, inside, at the end and cut short: as the pattern alone."""
    patterns = list(V.STARTS)
    assert {V.DEGREES, V.TITLES_FIRST, V.TITLES_SECOND, V.SECOND_DELIMITERS, V.ISOLATED_MA} <= set(patterns)
    parts = {a.replace("\\", "").strip("()^$") for p in patterns for a in p.replace("\\|", "|").split("|")} | {" MA ", "MA", "xMAx"}
    texts = sorted({t for a in parts if a for t in (a, f"x {a} y", f"{a} y", f" x {a}", f"x{a}y", a[:-1], f"{a}{a}")})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        plain, quick = (F.regexp_replace("t", F.lit(x), F.lit("<>")) for x in (p, X._quick(p)))
        assert df.filter(plain != F.col("t")).count() > 0
        assert df.filter(~plain.eqNullSafe(quick)).collect() == []


def test_blanks_are_unicode_white_space(spark):
    rows = [(chr(i),) for i in [*range(1, 0xD800), *range(0xE000, 0x11000)]]
    df = spark.createDataFrame(rows, "t string")
    assert df.filter(F.col("t").rlike(r"^(?U)\s+$") != F.col("t").rlike(f"^{X.BLANKS}$")).collect() == []


def test_lines_are_numbered_through_the_files_of_a_folder(spark, tmp_path):
    files = {"a/1.txt": "x\ny\n", "a/2.txt": "z\nopen", "a/3.txt": "v\n", "b/1.txt": "w\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    for drop_last, want in ((True, ["x", "y", "z", "v"]), (False, ["x", "y", "_", "z", "open", "v", "_"])):
        got = readers.read_lines(spark, f"{tmp_path}/*/*.txt", drop_last, by_folder=True).collect()
        lines = {(r["source_file"].split("/")[-2], r["pos"]): r["word"] for r in got}
        assert [lines["a", i] for i in range(len(want))] == want
        assert [lines["b", i] for i in range(len(got) - len(want))] == (["w"] if drop_last else ["w", "_"])


def test_chain_reads_names_that_are_cleaned_already(spark):
    """The rules stand in no plan of the joins: names were cleaned once, before."""
    from featforge.plans import catalog

    plan = catalog.QUERIES["chain_author_names"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cover SNRUJST" not in plan
