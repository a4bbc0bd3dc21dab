"""The folder that the driver and all executors see, and tables written there to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/glyphspark"

#: Tables that this process has written, for forget().
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{LOCAL_CHECKPOINTS}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, written once and read again: drawn numbers stay, and lost executors cost nothing made before."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete all tables of written(); only when no result that reads them is needed."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    _WRITTEN.clear()
