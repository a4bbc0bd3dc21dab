"""Calibration of confidences: ECE, Brier score, reliability bins, risk and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import linspace
from .prefix import edges, running, sliced

BINS = 10


def bin_of(conf: Column, bins: int = BINS, closed: str = "left") -> Column:
    """Number of the bin that holds conf; null outside all.

    left: [lo, hi), the last closed. right: (lo, hi], so that 0 is in none. Comparisons with the
    edges, as literals, are a range join with a table of edges that needs no join.
    """
    e = linspace(bins)
    inside = lambda i: (conf >= e[i]) & ((conf <= e[i + 1]) if i == bins - 1 else (conf < e[i + 1])) if closed == "left" else (conf > e[i]) & (conf <= e[i + 1])
    return F.coalesce(*[F.when(inside(i), F.lit(i)) for i in range(bins)])


def _double(df: DataFrame, conf: str, correct: str) -> DataFrame:
    return df.select(F.col(conf).cast("double").alias("conf"), F.col(correct).cast("double").alias("correct"))


def expected_calibration_error(df: DataFrame, conf: str = "conf", correct: str = "correct", bins: int = BINS) -> DataFrame:
    """Mean gap of confidence and accuracy over bins, by their share of rows; 0 if there are none."""
    d = _double(df, conf, correct)
    by = d.groupBy(bin_of(F.col("conf"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg("correct").alias("a"))
    return by.agg(F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("c") - F.col("a")))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def brier(df: DataFrame, conf: str = "conf", correct: str = "correct") -> DataFrame:
    d = _double(df, conf, correct)
    return d.agg(F.avg((F.col("conf") - F.col("correct")) * (F.col("conf") - F.col("correct"))).alias("brier"))


def reliability_bins(df: DataFrame, conf: str = "conf", correct: str = "correct", bins: int = BINS) -> DataFrame:
    """Bins (lo, hi] that hold rows: n, mean confidence, accuracy."""
    d = _double(df, conf, correct).withColumn("bin", bin_of(F.col("conf"), bins, "right")).where("bin is not null")
    e = F.array(*map(F.lit, linspace(bins)))
    by = d.groupBy("bin").agg(F.count("*").alias("n"), F.avg("conf").alias("mean_confidence"), F.avg("correct").alias("actual_accuracy"))
    return by.select("bin", F.get(e, F.col("bin")).alias("lo"), F.get(e, F.col("bin") + 1).alias("hi"), "n", "mean_confidence", "actual_accuracy")


def calibration_summary(df: DataFrame, conf: str = "conf", correct: str = "correct") -> DataFrame:
    d = _double(df, conf, correct)
    return d.agg(F.avg("conf").alias("mean_confidence"), F.avg("correct").alias("actual_accuracy"), (F.avg("conf") - F.avg("correct")).alias("overconfidence_gap"))


def risk_coverage(df: DataFrame, conf: str = "conf", correct: str = "correct", key: str = "row_id") -> DataFrame:
    """Rows by falling confidence (ties by key): coverage i / n and the error rate of the first i.

    A row without a confidence or without an outcome is no part of the curve, nor of n.

    Rows meet as groups of one confidence and one range of keys; running sums go over the groups,
    then inside each, so a confidence that a third of all rows share is many groups.
    """
    d = df.select(F.col(key).alias("key"), F.col(conf).cast("double").alias("conf"), (1 - F.col(correct).cast("double")).alias("wrong")).where("conf is not null and wrong is not null")
    d = d.withColumn("part", sliced(F.col("key").cast("double"), edges(d, "key")))
    groups = d.groupBy("conf", "part").agg(F.count("*").alias("n"), F.sum("wrong").alias("w"))
    before = running(groups, "conf", ["part"], {"upto": F.col("n"), "wrong_upto": F.col("w")}, descending=True)
    before = before.select(F.col("conf").alias("_conf"), F.col("part").alias("_part"), (F.col("upto") - F.col("n")).alias("before"), (F.col("wrong_upto") - F.col("w")).alias("wrong_before"))
    total = d.agg(F.count("*").alias("total"))
    own = Window.partitionBy("conf", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    inside = d.withColumns({"i": F.row_number().over(Window.partitionBy("conf", "part").orderBy("key")), "wrongs": F.sum("wrong").over(own)})
    joined = inside.join(before, (F.col("conf") == F.col("_conf")) & (F.col("part") == F.col("_part"))).crossJoin(F.broadcast(total))
    rank = F.col("i") + F.col("before")
    return joined.select(F.col("key").alias(key), rank.alias("rank"), (rank / F.col("total")).alias("coverage"), ((F.col("wrongs") + F.col("wrong_before")) / rank).alias("risk"))


def risk_at(curve: DataFrame, coverages: tuple[float, ...] = (0.5, 0.7, 0.9, 1.0)) -> DataFrame:
    """Risk at the coverage nearest to each asked for, the first on a tie; one row, columns risk_50, ..."""
    return curve.agg(*[F.min_by("risk", F.struct(F.abs(F.col("coverage") - F.lit(c)), F.col("rank"))).alias(f"risk_{round(c * 100)}") for c in coverages])


def calibration_metrics(df: DataFrame, conf: str = "conf", correct: str = "correct", key: str = "row_id", bins: int = BINS) -> DataFrame:
    """All of the above in one row; bins as an array."""
    rows = reliability_bins(df, conf, correct, bins).agg(F.sort_array(F.collect_list(F.struct("bin", "lo", "hi", "n", "mean_confidence", "actual_accuracy"))).alias("reliability_bins"))
    # one row each
    out = expected_calibration_error(df, conf, correct, bins)
    for other in (brier(df, conf, correct), calibration_summary(df, conf, correct), rows, risk_at(risk_coverage(df, conf, correct, key))):
        out = out.crossJoin(F.broadcast(other))
    return out
