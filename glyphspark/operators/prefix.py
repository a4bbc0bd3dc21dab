"""Running sums over a total order, without one task that holds all rows.

A window without partitions puts every row into one task. Here rows fall into slices by quantiles
of the leading key (constants in the plan, so every task cuts alike), a slice is summed by window,
and the sums of the slices before it, one row a slice, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a slice, about, and how many slices there are at least and at most.
ROWS, LEAST, MOST = 1_000_000, 64, 1_024


def edges(df: DataFrame, key: str) -> list[float]:
    """Approximate quantiles of a numeric column that cut its rows into slices, by one aggregate."""
    at = [i / MOST for i in range(1, MOST)]
    n, found = df.agg(F.count(key), F.percentile_approx(F.col(key).cast("double"), at, 4 * MOST)).first()
    step = MOST // min(MOST, max(LEAST, 1 << (n // ROWS).bit_length()))
    return sorted(set((found or [])[step - 1 :: step]))


def sliced(key: Column, at: list[float]) -> Column:
    """How many of the edges lie at or below key, found by halving."""

    def halve(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(float(at[mid])), halve(mid + 1, hi)).otherwise(halve(lo, mid))

    return halve(0, len(at)).cast("int")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often later steps and filters use them.

    A filter on a plain column would be pushed below it with a copy of what makes the column; a generator keeps it above.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def running(df: DataFrame, key: str, then: list[str], sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """df with running totals, in order of key (numeric, no nulls) and then ascending columns.

    sums maps a new column to what it sums, this row included. Rows with one key share a slice:
    where a key may repeat without bound, sum by key first.
    """
    side = sliced(F.col(key).cast("double"), edges(df, key))
    at = fresh(df, "slice")
    placed = df.withColumn(at, -side if descending else side)
    order = [F.col(key).desc() if descending else F.col(key).asc(), *then]
    inside = Window.partitionBy(at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = placed.groupBy(at).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    # at most MOST rows
    ahead = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    names = {n: fresh(df, f"before_{n}") for n in sums}
    before = whole.select(at, *[F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(names[n]) for n in sums])
    out = placed.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(before), at)
    return out.withColumns({n: F.col(n) + F.col(names[n]) for n in sums}).drop(at, *names.values())
