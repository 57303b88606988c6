"""Point clouds as a data source: files of fixed records that many tasks read by offset and write side by side.

``register(spark)`` makes the format ``point_cloud`` known:

    spark.read.format("point_cloud").load(folder)      # path, x, y, z, r, g, b
    points.write.format("point_cloud").mode("append").save(folder)

A folder of files is one cloud. A file of any size is read by as many tasks as it has splits; each finds the records that begin in its stretch. A task
writes files of a bounded number of points, each with its own count in its header; they appear when the job commits, and those of failed or repeated attempts never do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .captures import PLY_POINT, ply_bytes

NAME = "point_cloud"
SCHEMA = "path string, x double, y double, z double, r double, g double, b double"
#: Bytes of a split, points of a file that is written, and points of a batch.
SPLIT, FILE_POINTS, BATCH = 64 << 20, 4 << 20, 1 << 16
#: Bytes in which a header must end.
HEAD = 1 << 12


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header(raw: bytes, path: str) -> tuple[int, int]:
    """Where the records begin, and how many there are."""
    end = raw.find(b"end_header\n")
    count = next((line.split()[2] for line in raw[: max(end, 0)].split(b"\n") if line.startswith(b"element vertex ")), None)
    if not raw.startswith(b"ply\n") or end < 0 or count is None:
        raise ValueError(f"{path} is no cloud file")
    return end + 11, int(count)


@dataclass
class Stretch(InputPartition):
    """Bytes of a file: the records that begin there are one task's."""

    path: str
    first: int
    last: int


class CloudReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))

    def partitions(self) -> list[Stretch]:
        system, path = located(self.path)
        found = system.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda name: any(part.startswith(("_", ".")) for part in name[len(path) :].split("/") if part)
        clouds = sorted((f for f in files if f.type == fs.FileType.File and f.path.endswith(".ply") and not hidden(f.path)), key=lambda f: f.path)
        return [Stretch(f.path, at, min(at + self.split, f.size)) for f in clouds for at in range(0, max(f.size, 1), self.split)]

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without clouds
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.path) as file:
            begin, count = header(file.read_at(HEAD, 0), partition.path)
            size = PLY_POINT.itemsize
            if begin + count * size > file.size():
                raise ValueError(f"{partition.path} ends before its {count} points do")
            first, last = (min(max(-(-(x - begin) // size), 0), count) for x in (partition.first, partition.last))
            for at in range(first, last, BATCH):
                n = min(BATCH, last - at)
                p = np.frombuffer(file.read_at(n * size, begin + at * size), PLY_POINT)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), *[pa.array(p[c].astype(np.float64)) for c in "xyzrgb"]], ["path", *"xyzrgb"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    points: int


class CloudWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.most, self.overwrite = options["path"], int(options.get("filepoints", FILE_POINTS)), overwrite
        self.stage = f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        import pandas as pd

        system, path = located(self.path)
        system.create_dir(f"{path}/{self.stage}", recursive=True)
        held: list = []
        done = Written([], 0)

        def close(points) -> None:
            name = f"part-{uuid.uuid4().hex}.ply"
            with system.open_output_stream(f"{path}/{self.stage}/{name}") as out:
                out.write(ply_bytes(points))
            done.files.append(name)
            done.points += len(points)

        rows = 0
        for batch in batches:
            pdf = batch.to_pandas()
            while len(pdf):
                part = pdf.iloc[: self.most - rows]
                held.append(part)
                rows, pdf = rows + len(part), pdf.iloc[len(part) :]
                if rows == self.most:
                    close(pd.concat(held))
                    held, rows = [], 0
        if held:
            close(pd.concat(held))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """Moves the files of the tasks that count to their place; what other attempts wrote goes with the stage."""
        system, path = located(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.path.endswith(".ply"):
                    system.delete_file(f.path)
        for message in messages:
            for name in message.files if message else []:
                system.move(f"{path}/{self.stage}/{name}", f"{path}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, path = located(self.path)
        if system.get_file_info(f"{path}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.stage}")


class CloudSource(DataSource):
    """Options: path; splitBytes (of a task that reads); filePoints (of a file that is written)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CloudReader:
        return CloudReader(_plain(self.options))

    def writer(self, schema, overwrite: bool) -> CloudWriter:
        missing = set("xyzrgb") - set(schema.fieldNames())
        if missing:
            raise ValueError(f"points have no {sorted(missing)}")
        return CloudWriter(_plain(self.options), overwrite)


def _plain(options) -> dict:
    return {str(k).lower(): v for k, v in options.items()}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CloudSource)
