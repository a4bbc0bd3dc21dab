"""What the training-data operators share: the shared folder, written tables, packed arrays."""

from __future__ import annotations

import contextlib
import ctypes
import json
import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/glyphspark"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{LOCAL_CHECKPOINTS}"


#: While a table is written: a statement's shuffle files go at its end, and texts, which are long, are read and sent to Python few at a time.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.columnarReaderBatchSize": "1024", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: Files that a task has open, so that rows need not be sorted by their folder.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: What a task of a written table reads at least, where there is more than one a core; and a row group, which a writer holds in memory.
TASK_BYTES, ROW_GROUP = 512 << 20, 16 << 20

#: Folders that this process has made, for clear().
_MADE: list[str] = []


def files(df: DataFrame) -> int:
    """How many files to make of df at most: one a core, and one for so many bytes that it reads.

    Each file costs requests to the store, and on a local one processes; a lost task costs what it read.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    # an unknown size is Spark's largest
    return max(df.sparkSession.sparkContext.defaultParallelism, min(read // TASK_BYTES, 1_000_000))


def few(df: DataFrame) -> DataFrame:
    """df in so many partitions at most."""
    return df.coalesce(files(df))


class Scratch:
    """Written tables in the shared folder; each cuts lineage and outlives a lost executor.

    A result may read them until it is consumed, so they stay; clear() deletes them afterwards.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _MADE.append(self.root)

    def keep(self, df: DataFrame, name: str, compression: str = "zstd", by: str | None = None) -> DataFrame:
        """Write df once, in a folder for each value of by (a few), and return the table as written.

        Shuffle files of the write go when it ends, for nothing reads them again. A task that makes a
        file of several partitions works on one after the other.
        """
        path = f"{self.root}/{name}"
        schema, conf = df.schema, self.spark.conf
        ours = SETTINGS | ({WRITERS: "16"} if by else {})
        before = {k: conf.get(k) for k in ours}
        for k, v in ours.items():
            conf.set(k, v)
        try:
            writer = few(df).write.mode("overwrite").options(compression=compression, **{"parquet.block.size": ROW_GROUP})
            (writer.partitionBy(by) if by else writer).parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete written tables that no later step reads."""
        _delete(self.spark, *[f"{self.root}/{name}" for name in names])


def _delete(spark: SparkSession, *paths: str) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def made() -> int:
    """How many folders this process has made so far."""
    return len(_MADE)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete all written tables of this process made since then; only when no result that reads them is needed."""
    _delete(spark, *_MADE[since:])
    del _MADE[since:]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value.

    Integers take the narrowest type that holds them and are stored byte plane by byte plane (all
    low bytes, then all next ones), which compresses well; floats, whose values repeat, stay whole.
    """
    kinds, planes = [], []
    for a in arrays:
        if a.dtype.kind in "iu" and a.size:
            lo, hi = int(a.min()), int(a.max())
            kind = np.min_scalar_type(hi) if lo >= 0 else np.promote_types(np.min_scalar_type(lo), np.min_scalar_type(hi))
            a = a.astype(kind) if kind.kind in "iu" else a
        flat = np.ascontiguousarray(a).reshape(-1)
        kinds.append((a.dtype.str, a.shape))
        planes.append(flat.tobytes() if a.dtype.kind == "f" else flat.view(np.uint8).reshape(a.size, a.itemsize).T.tobytes())
    head = json.dumps(kinds).encode()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(head).to_bytes(4, "little"), head, *planes]))


def unpack(value: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(value)
    at = 4 + int.from_bytes(data[:4], "little")
    out = []
    for kind, shape in json.loads(data[4:at]):
        dtype = np.dtype(kind)
        size = math.prod(shape)
        if dtype.kind == "f":
            flat = np.frombuffer(data, dtype, size, at)
        else:
            flat = np.ascontiguousarray(np.frombuffer(data, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)
        at += size * dtype.itemsize
        out.append(flat.reshape(shape))
    return out


def trim() -> None:
    """Give freed memory back to the system: a worker outlives its tasks, and would keep the most it ever used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def bucket(column: Column, modulus: int) -> Column:
    """crc32 of the value's text, modulo; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A well-spread unsigned 64-bit mix of two integer arrays (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = np.asarray(a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
