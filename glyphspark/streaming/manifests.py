"""Manifests that grow: new rows as they are appended, and metrics kept up to date.

A label is appended right after its image; a file stream over the manifest folder picks up each
committed file once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.recognition import measured
from ..sources.files import MANIFEST


def stream_manifest(spark: SparkSession, path: str, schema: str = MANIFEST, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def running_recognition(pairs: DataFrame) -> DataFrame:
    """Recognition metrics over a stream of pairs(ref, hyp): sums that any batch can add to."""
    m = measured(pairs)
    sums = m.agg(F.count("*").alias("n"), F.sum("dist").alias("d"), F.sum("ref_n").alias("r"), F.avg("aer").alias("aer_mean_per_word"), F.avg(F.col("exact").cast("int")).alias("word_accuracy"))
    return sums.select("n", (F.col("d") / F.greatest(F.col("r"), F.lit(1))).alias("aer_corpus"), "aer_mean_per_word", "word_accuracy")


def keep_metrics(pairs: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Latest metrics in an in-memory table of that name."""
    return running_recognition(pairs).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def copy_manifest(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of manifest rows to a folder, each exactly once."""
    return rows.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
