"""Samples of three files each (12_cot.txt, 12_story.txt, 12_metadata.txt) as a Spark data source, to read and to write."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

KINDS = ("cot", "story", "metadata")
SCHEMA = "idx bigint, cot string, story string, metadata string"
_NAME = re.compile(r"(\d+)_(cot|story|metadata)\.txt")
#: Samples that one task reads.
RANGE = 1000
_STAGING = "_staging-"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a path or URI."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _complete(store: fs.FileSystem, folder: str) -> list[int]:
    """The ids in a folder that have all three files, in order; from names alone."""
    found: dict[int, set[str]] = {}
    for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        name = _NAME.fullmatch(info.base_name)
        if name and info.is_file and str(int(name[1])) == name[1]:
            found.setdefault(int(name[1]), set()).add(name[2])
    return sorted(i for i, kinds in found.items() if len(kinds) == len(KINDS))


@dataclass
class IdRange(InputPartition):
    """Ids that one task reads, next to each other among those of the folder."""

    ids: tuple[int, ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path, most

    def partitions(self) -> list[IdRange]:
        ids = _complete(*_place(self.path))
        return [IdRange(tuple(ids[k : k + self.most])) for k in range(0, len(ids) or 1, self.most)]

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        store, folder = _place(self.path)
        for i in partition.ids:
            texts = []
            for kind in KINDS:
                with store.open_input_stream(f"{folder}/{i}_{kind}.txt") as f:
                    texts.append(f.read().decode("utf-8", errors="replace"))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *(pa.array([t]) for t in texts)], ["idx", *KINDS])


@dataclass
class Written(WriterCommitMessage):
    samples: int
    skipped: int


class _Writer(DataSourceArrowWriter):
    """Files are written aside and moved when a task is done, metadata last, so a sample with all three files is whole.

    A task that is run again writes the same names; what a lost one left aside goes with the job's end.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.aside = f"{_STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _place(self.path)
        mine = f"{folder}/{self.aside}/{uuid.uuid4().hex}"
        store.create_dir(mine)
        done, skipped = [], 0
        for batch in iterator:
            rows = {name.lower(): batch.column(name) for name in batch.schema.names}
            for k in range(len(batch)):
                i = rows["idx"][k].as_py()
                if i is None or i < 0:
                    raise ValueError("a sample needs an id of 0 or more")
                names = [f"{i}_{kind}.txt" for kind in KINDS]
                if not self.overwrite and all(f.is_file for f in store.get_file_info([f"{folder}/{n}" for n in names])):
                    skipped += 1
                    continue
                for kind, name in zip(KINDS, names, strict=True):
                    with store.open_output_stream(f"{mine}/{name}") as f:
                        f.write((rows[kind][k].as_py() or "").encode())
                done.append(names)
        for names in done:
            for name in names:
                store.move(f"{mine}/{name}", f"{folder}/{name}")
        return Written(len(done), skipped)

    def _clear(self) -> None:
        store, folder = _place(self.path)
        if store.get_file_info(f"{folder}/{self.aside}").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/{self.aside}")

    def commit(self, messages: list[Written | None]) -> None:
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class SampleSource(DataSource):
    """``spark.read.format("samples").load(folder)`` and ``df.write.format("samples").mode("append" or "overwrite").save(folder)``.

    Reading gives idx, cot, story and metadata of samples that have all three files, about ``range`` (an option) of them a task;
    incomplete samples and other files are passed over.  Writing with append skips samples that are there as a whole, and
    completes others; overwrite writes every sample anew.  Null texts are written as empty.  The folder is of a store that
    driver and executors share, named by a path or a URI.
    """

    @classmethod
    def name(cls) -> str:
        return "samples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        missing = {"idx", *KINDS} - {n.lower() for n in schema.names}
        if missing:
            raise ValueError(f"samples need the columns {', '.join(sorted(missing))}")
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SampleSource)


def read_sample_files(spark: SparkSession, folder: str, most: int = RANGE) -> DataFrame:
    register(spark)
    return spark.read.format("samples").option("range", most).load(folder)


def write_sample_files(samples: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write idx, cot, story and metadata as files; an id must stand in one row."""
    register(samples.sparkSession)
    samples.select("idx", *KINDS).write.format("samples").mode("overwrite" if overwrite else "append").save(folder)
