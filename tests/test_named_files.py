from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from featforge.session import scratch_path
from featforge.sources import named_files, readers


def test_files_are_named_and_read_back(spark):
    path = scratch_path(spark, "named")
    rows = spark.createDataFrame([("a.txt", b"one"), ("b.txt", b" "), ("c c.txt", b"x"), ("é.txt", b"\x00\xff")], "n string, c binary")
    named_files.write_named_files(rows.repartition(3), "n", "c", path)
    named_files.write_named_files(rows.filter("n = 'a.txt'").withColumn("c", F.lit(b"two")), "n", "c", path)  # added, not replaced
    got = spark.read.format("binaryFile").load(path).select("path", "content").collect()
    assert {unquote(r["path"].rsplit("/", 1)[-1]): bytes(r["content"]) for r in got} == {
        "a.txt": b"two", "b.txt": b" ", "c c.txt": b"x", "é.txt": b"\x00\xff"}


def test_missing_content_is_an_empty_file(spark):
    """Spark's reader passes over empty files; they are there."""
    path = scratch_path(spark, "named")
    named_files.write_named_files(spark.createDataFrame([("e", None), ("f", b"1")], "n string, c binary"), "n", "c", path)
    system, folder = named_files._opened(path)
    assert {(f.base_name, f.size) for f in system.get_file_info(named_files.fs.FileSelector(folder))} == {("e", 0), ("f", 1)}


@pytest.mark.parametrize("name", ["../x", "", ".hidden", None])
def test_other_names_fail_and_leave_nothing(spark, name):
    path = scratch_path(spark, "named")
    rows = spark.createDataFrame([("good", b"1"), (name, b"2")], "n string, c binary").coalesce(1)
    with pytest.raises(Exception, match="not a file name"):
        named_files.write_named_files(rows, "n", "c", path)
    assert spark.read.format("binaryFile").load(path).count() == 0


def test_array_files_of_several_shapes(spark):
    import io

    path = scratch_path(spark, "arrays")
    arrays = {"one": np.arange(3.0), "two": np.arange(6).reshape(3, 2), "cube": np.ones((2, 2, 2), "float32")}
    rows = []
    for name, a in arrays.items():
        buffer = io.BytesIO()
        np.save(buffer, a)
        rows.append((f"{name}.npy", buffer.getvalue()))
    named_files.write_named_files(spark.createDataFrame([*rows, ("note.txt", b"no array")], "n string, c binary"), "n", "c", path)
    got = readers.read_array_files(spark, path).groupBy("id").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()
    assert {(r["id"], r["n"], r["s"]) for r in got} == {(k, a.size, float(a.sum())) for k, a in arrays.items()}


def test_files_in_many_folders_are_listed_by_tasks(spark):
    """Every name lies in one folder of its own, also when it is written again; the driver sees no file."""
    path = scratch_path(spark, "spread")
    rows = spark.range(200).selectExpr("concat('d', id, '.v1.jpg') AS n", "cast(repeat('.', cast(id AS int)) AS binary) AS c")
    named_files.write_named_files(rows.repartition(3), "n", "c", path, folders=7)
    named_files.write_named_files(rows.filter("id = 5").withColumn("c", F.lit(b"other length")), "n", "c", path, folders=7)
    assert named_files.list_files(spark, path).count() == 0  # all lie below
    got = named_files.list_files(spark, path, recursive=True)
    assert "FileScan binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
    found = got.collect()
    assert {(r["name"], r["length"]) for r in found} == {(f"d{i}.v1.jpg", 12 if i == 5 else i) for i in range(1, 200)} and len(found) == 199
    assert 1 < len({r["path"].rsplit("/", 2)[1] for r in found}) <= 7


def test_writer_of_folders_leaves_nothing_when_it_fails(spark):
    path = scratch_path(spark, "spread")
    rows = spark.createDataFrame([("good", b"1"), ("../x", b"2")], "n string, c binary").coalesce(1)
    with pytest.raises(Exception, match="not a file name"):
        named_files.write_named_files(rows, "n", "c", path, folders=3)
    assert named_files.list_files(spark, path, recursive=True).count() == 0


def test_manifest_of_folders_below(spark, tmp_path):
    for n in ("x/a.jpg", "x/y/b.jpeg", "c.JPG", "x/_d.jpg", "x/.e.jpg", "x/empty.jpg", "x/f,1.jpg"):
        (tmp_path / "i" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "i" / n).write_bytes(b"" if "empty" in n else b"123")
    for pattern, names in (("*.jpg", {"a.jpg", "f,1.jpg"}), ("*.{jpg,jpeg}", {"a.jpg", "b.jpeg", "f,1.jpg"}), ("[a-c].*", {"a.jpg", "b.jpeg", "c.JPG"}), ("?,1.jpg", {"f,1.jpg"})):
        got = readers.read_image_manifest(spark, str(tmp_path / "i"), pattern=pattern, recursive=True).collect()
        spark_reads = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(str(tmp_path / "i")).collect()
        assert {r["file_name"] for r in got} == names == {unquote(r["path"].rsplit("/", 1)[-1]) for r in spark_reads}
