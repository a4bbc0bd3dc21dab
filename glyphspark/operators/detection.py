"""Error detection: confusion counts, precision, recall, F-scores, ROC and PR areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running


def detection_metrics(df: DataFrame, threshold: float, beta: float = 2.0, label: str = "y", score: str = "score") -> DataFrame:
    """tp, fp, fn, tn at score >= threshold, and precision, recall, f1 and f<beta>."""
    y, p = F.col(label).cast("int") == 1, F.col(score) >= F.lit(threshold)
    n = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    r = n.withColumns({"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))})
    b2 = beta**2
    f = lambda b: (1 + b) * F.col("precision") * F.col("recall") / F.greatest(F.lit(b) * F.col("precision") + F.col("recall"), F.lit(1e-12))
    return r.withColumns({"f1": f(1.0), f"f{beta:g}": f(b2)})


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row a distinct score: positives and negatives."""
    return df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label).cast("int") == 1).alias("pos"), F.count_if(F.col(label).cast("int") == 0).alias("neg"))


def _areas(df: DataFrame, label: str, score: str, descending: bool) -> DataFrame:
    by = _by_score(df, label, score)
    totals = by.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return running(by, "s", [], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, descending).crossJoin(F.broadcast(totals))


def roc_auc(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Chance that a positive scores above a negative, ties half; null with one class only."""
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    return _areas(df, label, score, False).agg((F.sum(F.col("pos") * below) / F.nullif(F.max("P") * F.max("N"), F.lit(0))).alias("roc_auc"))


def pr_auc(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Average precision: precision at each distinct score by the recall it adds; null with one class only."""
    at = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    area = F.sum(at) / F.nullif(F.max("P"), F.lit(0))
    return _areas(df, label, score, True).agg(F.when(F.max("N") > 0, area).alias("pr_auc"))
