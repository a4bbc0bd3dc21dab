"""What the two vector searches share: valid vectors, query blocks, and merging of partial results.

A vector takes part if it is neither null nor empty and no component is null or non-finite.
Vectors of unequal length meet as if the shorter one ended in zeros. Rows that repeat a vec_id are
candidates of their own; such a query is asked once, with the smallest of its vectors, and no row
with its vec_id is a candidate for it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_STEP = 20


def valid(rows: DataFrame) -> DataFrame:
    """vec_id and vec (array of doubles) of rows(vec_id, embedding) that take part."""
    vec = F.col("embedding").cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad)


def queries_of(rows: DataFrame, step: int = QUERY_STEP) -> DataFrame:
    """The stated query set: every row whose vec_id divides by step."""
    return rows.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(column: list, dims: int) -> np.ndarray:
    """Rows of vectors, zeros behind the shorter ones."""
    if all(len(v) == dims for v in column):
        return np.array(column, float).reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def merged(partial: DataFrame, k: int) -> DataFrame:
    """rank 1..k of partial(query_id, vec_id, score) by score, ties to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
