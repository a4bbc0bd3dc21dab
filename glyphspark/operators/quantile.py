"""Exact percentiles by selection: counts by range, then only the range that holds the place.

An aggregate that is exact holds every distinct value in one task. Here a sketch cuts the values into RANGES ranges,
their rows are counted, and the search goes on in the range that holds the place, until it has one value or at
most ROWS rows, which one task sorts. The sketch only chooses where to cut: counts decide, so the result is exact.

Edge cases: nulls are left out, NaN is above all numbers; without any value the result is null; any number of rows may be equal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import sliced

#: Ranges of a round, and rows that one task sorts in the end.
RANGES, ROWS = 256, 100_000


def _within(values: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """values above low and not above high."""
    v = F.col("v")
    out = values if low is None else values.where(v > F.lit(low))
    return out if high is None else out.where(v <= F.lit(high))


def _cuts(values: DataFrame) -> list[float]:
    """Upper ends of ranges that hold about as many rows each, by one sketch; the last is the largest value."""
    at = [i / RANGES for i in range(1, RANGES)]
    found, top = values.agg(F.percentile_approx("v", at, 8 * RANGES), F.max("v")).first()
    return sorted({*found, top})


def _range_of(cuts: list[float]) -> Column:
    """The first range whose upper end isn't below v, by halving."""
    # sliced() counts the edges at or below its key; of the negated values these are the ends not below v
    ends = [-c for c in reversed(cuts[:-1])]
    return (F.lit(len(cuts) - 1) - sliced(-F.col("v"), ends)).cast("int")


def value_at(values: DataFrame, place: int, n: int) -> float:
    """The value at a place, from 0, of the n rows of values(v) in order."""
    low = high = None
    while True:
        inside = _within(values, low, high)
        if n <= ROWS:
            return inside.agg(F.get(F.sort_array(F.collect_list("v")), F.lit(place))).first()[0]
        cuts = _cuts(inside)
        counts = {r.k: r for r in inside.groupBy(_range_of(cuts).alias("k")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        for k in sorted(counts):
            if place < counts[k].n:
                break
            place -= counts[k].n
        if counts[k].lo == counts[k].hi or len(cuts) == 1:
            return counts[k].hi
        low, high, n = cuts[k - 1] if k else low, cuts[k], counts[k].n


def percentile(df: DataFrame, column: str | Column, share: float) -> float | None:
    """The exact percentile of a numeric column, between neighbours linearly."""
    every = df.select((F.col(column) if isinstance(column, str) else column).cast("double").alias("v")).where("v is not null")
    total, n = every.agg(F.count("*"), F.count_if(~F.isnan("v"))).first()
    if not total:
        return None
    at = share * (total - 1)
    place = math.floor(at)
    if math.ceil(at) >= n:
        return math.nan
    values = every.where(~F.isnan("v"))
    value = value_at(values, place, n)
    if at == place:
        return value
    # the next place has the same value, or the least above it
    upto, above = values.agg(F.count_if(F.col("v") <= F.lit(value)), F.min(F.when(F.col("v") > F.lit(value), F.col("v")))).first()
    after = value if upto > place + 1 else above
    return (place + 1 - at) * value + (at - place) * after
