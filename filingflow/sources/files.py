"""A sink of plain files: one Markdown or text file for each name, its parts in order, committed as a whole.

``write_text_files`` goes through a Python data source. A task writes the files of its names into a folder of its own attempt
and reports it; the driver gathers one short message for each task, moves the winning folders together and makes the
run visible with one rename, the commit. A task that fails or runs twice leaves nothing that a reader sees, a run that
fails leaves what was there before. Files are written as a stream, so a task holds one part at a time; a name with very
many parts is cut into volumes, which spread over tasks.

``read_files`` reads them back where they lie: each task takes the files of some folders, the driver sees no file.

Paths are local (or mounted) folders, or addresses that pyarrow's file systems open (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "filingflow_files"
SAFE = " #()[],;=@~+!$&'"  # besides letters, digits and _.-; everything else is written as %XX


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def file_of(name: str) -> str:
    """A file name that no other name has and that stays in its folder."""
    safe = quote(name, safe=SAFE)
    return "%2E" + safe[1:] if safe.startswith(".") else "%5F" + safe[1:] if safe.startswith("_") else safe


@dataclass
class Written(WriterCommitMessage):
    partition: int
    folder: str
    files: int
    size: int


class TextFiles(DataSource):
    """Rows (name, part, content) sorted by name and part in their partition -> files ``name``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, part int, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], uuid.uuid4().hex[:12])


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path.rstrip("/"), run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = file_system(self.path)
        partition = TaskContext.get().partitionId()
        folder = f"{root}/_run-{self.run}/attempt-{partition:06d}-{uuid.uuid4().hex[:8]}"
        files = size = 0
        stream, last = None, None
        try:
            for batch in iterator:
                names, contents = batch.column("name").to_pylist(), batch.column("content")
                for i, name in enumerate(names):
                    if name != last:
                        if stream:
                            stream.close()
                        if not files:
                            fs.create_dir(folder, recursive=True)
                        stream, last, files = fs.open_output_stream(f"{folder}/{file_of(name)}"), name, files + 1
                    piece = contents[i].as_buffer()
                    if piece is not None:
                        stream.write(piece)
                        size += piece.size
        finally:
            if stream:
                stream.close()
        return Written(partition, folder, files, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        done, staged = [m for m in messages if m is not None and m.files], f"{root}/_run-{self.run}"
        fs.create_dir(f"{staged}/done", recursive=True)
        for m in done:
            fs.move(m.folder, f"{staged}/done/part-{m.partition:06d}")
        with fs.open_output_stream(f"{staged}/done/_SUCCESS") as s:
            s.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())
        fs.move(f"{staged}/done", f"{root}/run-{self.run}")  # the commit
        fs.delete_dir(staged)  # attempts that lost

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        if fs.get_file_info(f"{root}/_run-{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_run-{self.run}")


def write_text_files(parts: DataFrame, path: str, name: str = "name", order: str = "part", content: str = "text", volume: int = 1000) -> None:
    """One file for each ``name`` with its ``content`` (text or binary, null: nothing) by ascending ``order`` (int).

    A file holds ``volume`` values of ``order`` at most; the others are in further files, the number of the volume before the ending
    (``a.md``, ``a.2.md``, ...). Rows without a name are left out. Written rows join what the folder held before.
    """
    spark = parts.sparkSession
    spark.dataSource.register(TextFiles)
    data = F.col(content).cast("binary")
    nth = F.floor(F.col(order) / F.lit(volume)).cast("int")
    stem, ending = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    full = F.when(nth < 1, F.col(name)).otherwise(F.concat(stem, F.lit("."), (nth + 1).cast("string"), ending))
    rows = parts.where(F.col(name).isNotNull()).select(full.alias("name"), F.col(order).cast("int").alias("part"), data.alias("content"))
    rows.repartition("name").sortWithinPartitions("name", "part").write.format(FORMAT).mode("append").save(path)


READ_BYTES = 8 << 20  # contents that a reading task holds at a time


def committed_folders(path: str) -> list[str]:
    """The folders of all committed runs below ``path``, one for each task that wrote files."""
    fs, root = file_system(path.rstrip("/"))
    below = lambda folder: [i for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if i.type == pafs.FileType.Directory]
    runs = [r for r in below(root) if r.base_name.startswith("run-")]
    return sorted(part.path for r in runs for part in below(r.path))


def read_files(spark: SparkSession, path: str, glob: str = "*", content: bool = True) -> DataFrame:
    """(``name``, ``size``, ``content``) of every committed file below ``path`` that is not empty and whose name on disk fits
    ``glob`` (``*``, ``?``, ``[...]``); without ``content`` that column is null and no file is opened.

    The driver lists the folders of the writing tasks only, a task lists and reads the files of a folder, so the number of
    files costs the driver nothing.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(path.rstrip("/"))
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows, held = [], 0
                for info in fs.get_file_info(pafs.FileSelector(folder)):
                    if info.type != pafs.FileType.File or not info.size or not fnmatchcase(info.base_name, glob) or info.base_name[0] in "._":
                        continue
                    data = None
                    if content:
                        with fs.open_input_stream(info.path) as s:
                            data = s.read()
                        held += len(data)
                    rows.append((unquote(info.base_name), info.size, data))
                    if held >= READ_BYTES or len(rows) >= 10_000:
                        yield _files_batch(rows)
                        rows, held = [], 0
                yield _files_batch(rows)

    folders = committed_folders(path)
    listed = spark.createDataFrame(spark.sparkContext.parallelize([(f,) for f in folders], max(1, len(folders))), "folder string")
    return listed.mapInArrow(read, "name string, size long, content binary")


def _files_batch(rows: list[tuple]) -> pa.RecordBatch:
    names, sizes, contents = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())], names=["name", "size", "content"]
    )
