"""Joins whose keys may be hot: frequent keys are found by their share and kept apart.

Of keys that hold more than one HOT-th of all rows there are fewer than HOT, whatever the data; they and what a table
has for them are broadcast. All other rows are joined by key, and none of these keys holds more than that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import fresh

#: A key is hot if it holds more than one HOT-th of the rows, so there are fewer hot keys than that.
HOT = 1_000


def hot_keys(rows: DataFrame, keys: list[str], hot: int = HOT) -> DataFrame:
    """The keys that hold more than one `hot`-th of the rows, counted now: fewer than `hot` rows, as literals."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("rows_of_key"))
    total = rows.count()
    found = counts.where(F.col("rows_of_key") * hot > total).select(*keys)
    return rows.sparkSession.createDataFrame(found.collect(), found.schema)


def parted(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that have one of the few keys found, and the rest, which those with a null key are in."""
    mark = fresh(rows, "hot")
    marked = rows.join(F.broadcast(found.withColumn(mark, F.lit(True))), found.columns, "left")
    return marked.where(mark).drop(mark), marked.where(F.col(mark).isNull()).drop(mark)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], hot: int = HOT) -> DataFrame:
    """rows with the further columns of a table that has each key once; null where it has none.

    rows are read three times: better a written table than a long plan.
    """
    found = hot_keys(rows, keys, hot)
    frequent, rest = parted(rows, found)
    values = table.join(F.broadcast(found), keys)
    return frequent.join(F.broadcast(values), keys, "left").unionByName(rest.join(table, keys, "left"))
