"""Order by place: rows numbered as they stand in files, or in a stated order, without one task that holds all.

A file of Parquet says each row's number in it; a split of a text file gives its lines one after the other. So only
counts are put together: rows of each file or split, and running sums of these, one row a file or
split. Rows get the sum before theirs and their own number inside. Files come in order of their paths.

Place is what first-seen order and pairing by position need: of equal counts the one seen first comes
first, and the i-th reference goes with the i-th reading.

Edge cases: an empty file has no rows and moves nothing; an empty table gives no rows; rows equal in the
stated order are numbered in any order, but once and for all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written
from .prefix import fresh

#: Files or splits whose sums are broadcast, at most; some 200 bytes each.
PARTS = 100_000


def _with_offsets(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of sums for their file or split."""
    sums = written(sums, "offsets")
    side = F.broadcast(sums) if sums.count() <= PARTS else sums
    return rows.join(side, keys)


def table_places(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of Parquet files with place, from 0: file after file in order of path, row after row."""
    read = spark.read.parquet(*paths)
    file, row = fresh(read, "file"), fresh(read, "row")
    marked = read.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    # as many rows as files
    before = F.coalesce(F.sum("n").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = marked.groupBy(file).agg(F.count("*").alias("n")).select(file, before.alias(fresh(read, "before")))
    return _with_offsets(marked, sums, [file]).withColumn("place", F.col(row) + F.col(fresh(read, "before"))).select(*read.columns, "place")


def line_places(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, line_no, place, value): lines of all text files below a folder, numbered from 0 in each file and over all.

    A split's lines get rising numbers as they are read; these are written with the lines, so that they stay.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    raw = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("id"), "value")
    kept = written(raw, "lines")
    # as many rows as splits
    ahead = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("path", "begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = kept.groupBy("path", "begin").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    sums = sums.select("path", "begin", (ahead("path") - F.col("first")).alias("in_file"), (ahead(F.lit(1)) - F.col("first")).alias("in_all"))
    out = _with_offsets(kept, sums, ["path", "begin"])
    return out.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), (F.col("id") + F.col("in_file")).alias("line_no"), (F.col("id") + F.col("in_all")).alias("place"), "value")


def order_places(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with place, from 0, in order of columns: ranges of the order, counted, then rows inside each.

    Ranges are drawn by sampling, so they are written before they are counted.
    """
    part, inside, before = fresh(df, "part"), fresh(df, "inside"), fresh(df, "before")
    spread = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    # a range is one partition already
    kept = written(spread.withColumn(inside, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1), "ranges")
    sums = kept.groupBy(part).agg(F.count("*").alias("n"))
    # as many rows as partitions
    sums = sums.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return _with_offsets(kept, sums, [part]).withColumn("place", F.col(inside) + F.col(before)).drop(part, inside, before)


def zipped(*sides: DataFrame) -> DataFrame:
    """Rows of the same place together, as far as the shortest side goes; columns besides place must differ."""
    return reduce(lambda a, b: a.join(b, "place"), sides)


def most_common_first(values: DataFrame, k: int, *keys: str, seen: tuple[str, ...] = ("place",)) -> DataFrame:
    """(keys, n): the k largest counts of values' keys; of equal counts what is seen first comes first.

    Counts and first places are summed in each task before their shuffle.
    """
    counted = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*seen)).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(k).select(*keys, "n")
