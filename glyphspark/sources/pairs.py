"""Data files and the manifest lines that name them, written together or not at all.

A task writes each row's data to a file of its own and, when all of these are closed, its manifest lines to
one part. The driver then writes one commit, which names the parts of the tasks that ended well, under a name that
did not exist. Readers see the lines of committed parts only: no line without its file, and a task that fails half-way or is run
twice leaves files that no line names, never a line twice. swept() deletes these.

The folder must be one that all executors see: local ones on one machine, else any that Arrow reaches by its URI.

Edge cases: null data makes an empty file; empty frames make a commit without parts; a column called like the path
option's column is an error; names of files are new, so rows that are alike make a file each.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import ship

#: Folders below the one written to.
DATA, PARTS, COMMITS = "data", "parts", "commits"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _put(store: fs.FileSystem, path: str, data: bytes) -> None:
    with store.open_output_stream(path) as out:
        out.write(data)


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its name and how many lines."""

    name: str
    lines: int


class PairWriter(DataSourceWriter):
    def __init__(self, path: str, data: str, suffix: str, overwrite: bool) -> None:
        self.path, self.data, self.suffix, self.overwrite = path, data, suffix, overwrite

    def write(self, rows: Iterator[Row]) -> Part:
        store, top = _store(self.path)
        name, lines = uuid.uuid4().hex, []
        folder = f"{top}/{DATA}/{name}"
        store.create_dir(folder, recursive=True)
        store.create_dir(f"{top}/{PARTS}", recursive=True)
        for i, row in enumerate(rows):
            kept = row.asDict(recursive=True)
            file = f"{folder}/{i:07d}{self.suffix}"
            _put(store, file, bytes(kept.pop(self.data) or b""))
            lines.append(json.dumps({"image": file} | kept, ensure_ascii=False, default=str))
        # only now that every file is closed
        _put(store, f"{top}/{PARTS}/{name}.jsonl", "".join(f"{x}\n" for x in lines).encode())
        return Part(name, len(lines))

    def commit(self, messages: list[Part | None]) -> None:
        store, top = _store(self.path)
        store.create_dir(f"{top}/{COMMITS}", recursive=True)
        before = _commits(store, top)
        # one name after all that are there; a rename shows it whole
        name = f"{top}/{COMMITS}/{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        _put(store, f"{name}.new", json.dumps({"replaces": [c for c, _ in before] if self.overwrite else [], "parts": [m.name for m in messages if m], "lines": sum(m.lines for m in messages if m)}).encode())
        store.move(f"{name}.new", name)

    def abort(self, messages: list[Part | None]) -> None:
        store, top = _store(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{top}/{PARTS}/{m.name}.jsonl")
                store.delete_dir(f"{top}/{DATA}/{m.name}")


class PairSink(DataSource):
    """df.write.format("pairs").option("data", column).option("suffix", ".png").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "pairs"

    def schema(self) -> str:
        return "image string"

    def writer(self, schema: StructType, overwrite: bool) -> PairWriter:
        data = self.options.get("data", "data")
        if data not in schema.names or "image" in schema.names:
            raise ValueError(f"pairs need a column {data} and none called image")
        return PairWriter(self.options["path"], data, self.options.get("suffix", ""), overwrite)


def _commits(store: fs.FileSystem, top: str) -> list[tuple[str, dict]]:
    """Commits that hold, in order."""
    found = store.get_file_info(fs.FileSelector(f"{top}/{COMMITS}", allow_not_found=True))
    all_ = []
    for f in sorted(x.path for x in found if x.path.endswith(".json")):
        with store.open_input_stream(f) as s:
            all_.append((f.rsplit("/", 1)[-1], json.loads(s.read())))
    gone = {c for _, said in all_ for c in said["replaces"]}
    return [(c, said) for c, said in all_ if c not in gone]


def write_pairs(df: DataFrame, path: str, data: str = "data", suffix: str = "", mode: str = "append") -> None:
    """Write each row's data to a file, and image (its path) with the other columns to the manifest, as one commit."""
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(PairSink)
    df.write.format("pairs").option("data", data).option("suffix", suffix).mode(mode).save(path)


def read_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed manifest lines: image and the other columns, as schema says."""
    store, top = _store(path)
    parts = [p for _, said in _commits(store, top) for p in said["parts"]]
    scheme = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else "file://"
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{scheme}{top}/{PARTS}/{p}.jsonl" for p in parts])


def swept(path: str, older_s: float = 86_400.0) -> int:
    """Delete what no commit names and is older, such as a failed task's files; returns how many folders and parts went.

    Tasks that still write must be younger.
    """
    store, top = _store(path)
    live = {p for _, said in _commits(store, top) for p in said["parts"]}
    gone = 0
    for folder in (DATA, PARTS):
        for f in store.get_file_info(fs.FileSelector(f"{top}/{folder}", allow_not_found=True)):
            if f.base_name.split(".")[0] not in live and time.time() - f.mtime.timestamp() > older_s:
                (store.delete_dir if f.type == fs.FileType.Directory else store.delete_file)(f.path)
                gone += 1
    return gone


def with_data(lines: DataFrame, image: str = "image") -> DataFrame:
    """lines with the bytes of their files, joined by path."""
    spark = lines.sparkSession
    folders = lines.select(F.regexp_extract(image, "^(.*)/[^/]*$", 1).alias("d")).distinct()
    paths = [r.d for r in folders.collect()]  # one a task that wrote
    if not paths:
        return lines.withColumn("content", F.lit(None).cast("binary"))
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias(image), "content")
    return lines.join(files, image)
