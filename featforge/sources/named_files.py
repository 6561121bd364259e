"""Files with given names: a sink, one file per row, and a listing, both by the tasks."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import stored

#: Files of a folder that go out together.
LISTED = 10_000


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class NamedFiles(DataSource):
    """Format ``named_files``: rows (name, content) go to files of those names below the option ``path``, in as many
    folders there as the option ``folders`` says (0: in the path itself)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("named files are added to a folder; nothing is overwritten but files of the same name")
        return _Writer(self.options["path"], int(self.options.get("folders", 0)))


class _Writer(DataSourceWriter):
    """Each file is written beside its place and moved there when it is whole, so that a task can run again."""

    def __init__(self, path: str, folders: int = 0):
        self.path, self.folders = path, folders

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        names: list[str] = []
        made: set[str] = set()
        try:
            for row in iterator:
                if not row["name"] or "/" in row["name"] or row["name"].startswith("."):
                    raise ValueError(f"not a file name: {row['name']!r}")
                below = f"{zlib.crc32(row['name'].encode()) % self.folders:04d}/" if self.folders else ""
                if below not in made:
                    system.create_dir(f"{folder}/{below}", recursive=True)
                    made.add(below)
                beside = f"{folder}/{below}.{row['name']}.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as out:
                    out.write(row["content"] or b"")
                system.move(beside, f"{folder}/{below}{row['name']}")
                names.append(f"{below}{row['name']}")
        except Exception:
            self.abort([_Written(names)])
            raise
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files are in their place already."""

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _opened(self.path)
        for message in messages:
            for name in message.names if message else []:
                system.delete_file(f"{folder}/{name}")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Files of a folder (path, name, length), listed by tasks: each lists some folders, no name reaches the driver.

    As in Spark's readers empty files and names that begin with a dot or an underscore are passed over. The folder must
    lie in a file system that Arrow opens and that all executors share.
    """
    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, path = _opened(folder)
                found = [f for f in system.get_file_info(fs.FileSelector(path)) if not f.base_name.startswith((".", "_"))]
                for i in range(0, len(found), LISTED):
                    part = found[i:i + LISTED]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{folder}/{f.base_name}" for f in part], pa.string()), pa.array([f.base_name for f in part], pa.string()),
                         pa.array([f.size for f in part], pa.int64()), pa.array([f.type == fs.FileType.Directory for f in part], pa.bool_())],
                        ["path", "name", "length", "is_folder"])

    # One round for each level of folders; a level is a table like any other.
    level, files = spark.createDataFrame([(folder.rstrip("/"),)], "folder string"), None
    while True:
        found = stored(level.mapInArrow(entries, "path string, name string, length long, is_folder boolean"), "listed")
        here = found.filter("not is_folder and length > 0").select("path", "name", "length")
        files = here if files is None else files.unionByName(here)
        below = found.filter("is_folder").select(F.col("path").alias("folder"))
        if not recursive or below.isEmpty():
            return files
        level = below.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder")


def write_named_files(df: DataFrame, name: str, content: str, path: str, folders: int = 0) -> None:
    """One file per row, called by ``name``, with the bytes of ``content`` (NULL: empty), below the folder ``path``.

    ``folders`` deals the files by their names out to so many folders there: tasks that add to one large folder wait for
    each other, and one task lists it.

    The folder must be shared by all executors and lie in a file system that Arrow opens (local or mounted, HDFS, S3,
    GCS). Names must be plain and differ; of rows with the same name any one stays. Spark's own writers cannot name
    binary files.
    """
    df.sparkSession.dataSource.register(NamedFiles)
    df.selectExpr(f"cast(`{name}` as string) AS name", f"cast(`{content}` as binary) AS content").write.format("named_files").mode("append").option("path", path).option("folders", folders).save()
