"""Recognition metrics over pairs of a reference and a reading.

Pairs are a table with a key: a reading that has no reference is nobody's error, and a reference
without a reading counts as read empty. Lists without keys pair by place. Akshara arrays and distances are computed once, as columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import edit_distance, error_rate
from ..functions.text import aksharas
from ..shared import written
from .place import zipped
from .prefix import running


def join_pairs(refs: DataFrame, hyps: DataFrame, key: str = "row_id") -> DataFrame:
    """refs(key, ref) with hyps(key, hyp, ...); every reference stays."""
    return refs.join(hyps, key, "left").withColumn("hyp", F.coalesce("hyp", F.lit("")))


def zip_pairs(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """(place, ref, hyp): the i-th of refs(place, ref) with the i-th of hyps(place, hyp), as far as the shorter side goes.

    Places are those of place.line_places, table_places or order_places.
    """
    return zipped(refs.select("place", "ref"), hyps.select("place", "hyp"))


def measured(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", prefix: str = "", normal: bool = True) -> DataFrame:
    """pairs with akshara arrays, sizes, distance, error rate, and whether they agree."""
    arrays = pairs.withColumns({"ref_a": aksharas(F.col(ref)), f"{prefix}hyp_a": aksharas(F.col(hyp))})
    sized = arrays.withColumns({"ref_n": F.size("ref_a"), f"{prefix}hyp_n": F.size(f"{prefix}hyp_a"), f"{prefix}dist": edit_distance(F.col("ref_a"), F.col(f"{prefix}hyp_a"))})
    return sized.withColumns({
        f"{prefix}aer": error_rate(F.col(f"{prefix}dist"), F.col("ref_n"), F.col(f"{prefix}hyp_n")),
        f"{prefix}exact": F.col("ref_a") == F.col(f"{prefix}hyp_a"),
        f"{prefix}raw_exact": F.col(ref) == F.col(hyp),
    })


def recognition_metrics(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, corpus and per-word akshara error rate, word accuracy and word error rate; one row (a group)."""
    m = measured(pairs)
    ok = F.avg(F.col("exact").cast("int"))
    return m.groupBy(*(by or [])).agg(F.count("*").alias("n"), (F.sum("dist") / F.greatest(F.sum("ref_n"), F.lit(1))).alias("aer_corpus"), F.avg("aer").alias("aer_mean_per_word"), ok.alias("word_accuracy"), (1 - ok).alias("wer"))


def training_metrics(pairs: DataFrame) -> DataFrame:
    """Macro error rate, and word error and accuracy by equal strings, as during training."""
    m = measured(pairs)
    wrong = F.avg((~F.col("raw_exact")).cast("int"))
    return m.agg(F.avg("aer").alias("aer"), wrong.alias("wer"), (1 - wrong).alias("word_accuracy"))


def exact_counts(pairs: DataFrame) -> DataFrame:
    """How many readings agree by akshara arrays, and by raw strings."""
    return measured(pairs).agg(F.count("*").alias("n"), F.count_if("exact").alias("n_exact"), F.count_if("raw_exact").alias("n_raw_exact"))


def running_metrics(pairs: DataFrame, key: str = "row_id", every: int = 500) -> DataFrame:
    """Accuracy and mean error rate of the first 500, 1000, ... rows in order of key."""
    # read for the slices' edges, their sums and the rows
    m = written(measured(pairs).select(key, F.col("exact").cast("int").alias("ok"), "aer"), "measured")
    cumulated = running(m, key, [], {"seen": F.lit(1), "right": F.col("ok"), "errors": F.col("aer")})
    return cumulated.where(F.col("seen") % every == 0).select("seen", (F.col("right") / F.col("seen")).alias("accuracy"), (F.col("errors") / F.col("seen")).alias("mean_aer"))
