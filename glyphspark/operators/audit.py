"""What correction changed: audit, confusions, histograms, examples, the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import aksharas
from .calibration import calibration_metrics
from .detection import detection_metrics, pr_auc, roc_auc
from .place import most_common_first
from .recognition import measured, recognition_metrics


def category() -> Column:
    """Of a row measured before (dist, exact) and after (after_dist, after_exact)."""
    same = F.col("hyp_a") == F.col("after_hyp_a")
    return (
        F.when(same, "unchanged")
        .when(~F.col("exact") & F.col("after_exact"), "fixed")
        .when(F.col("exact") & ~F.col("after_exact"), "damaged")
        .when(F.col("after_dist") < F.col("dist"), "improved")
        .when(F.col("after_dist") > F.col("dist"), "worsened")
        .otherwise("changed_equal")
    )


def audited(triples: DataFrame, ref: str = "ref", hyp: str = "hyp", after: str = "after") -> DataFrame:
    """triples(ref, hyp, after) measured before and after, with category."""
    return measured(measured(triples, ref, hyp), ref, after, "after_").withColumn("category", category())


def correction_audit(triples: DataFrame) -> DataFrame:
    """Counts by category, accuracy and error rate before and after; one row.

    A word that changed, is still wrong and is as far off as before is counted in n_changed and in
    changed_equal, in no other bucket.
    """
    a = audited(triples)
    n = lambda c: F.count_if(F.col("category") == c)
    share = lambda c: F.avg(F.col(c).cast("int"))
    out = a.agg(
        F.count("*").alias("n"), n("unchanged").alias("unchanged"), n("fixed").alias("fixed"), n("damaged").alias("damaged"), n("improved").alias("improved_not_fixed"), n("worsened").alias("worsened_still_wrong"), n("changed_equal").alias("changed_equal"),
        share("exact").alias("word_accuracy_before"), share("after_exact").alias("word_accuracy_after"), F.avg("aer").alias("aer_before"), F.avg("after_aer").alias("aer_after"),
    )
    return out.withColumns({
        "net_change": F.col("word_accuracy_after") - F.col("word_accuracy_before"),
        "n_changed": F.col("n") - F.col("unchanged"),
        "precision_of_changes": F.col("fixed") / F.greatest(F.col("n") - F.col("unchanged"), F.lit(1)),
        "fix_damage_ratio": F.col("fixed") / F.greatest(F.col("damaged"), F.lit(1)),
    })


def correction_examples(triples: DataFrame, key: str = "row_id", k: int = 10) -> DataFrame:
    """The first k fixed and the first k damaged words, in order of key."""
    a = audited(triples).select(key, "ref", "hyp", "after", "category")
    first = lambda c: a.where(F.col("category") == c).orderBy(key).limit(k)
    both = first("fixed").unionByName(first("damaged"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(key))
    return both.select("category", rank.alias("rank"), key, F.col("ref").alias("truth"), F.col("hyp").alias("before"), "after")


def _differing(pairs: DataFrame, *keep: str) -> DataFrame:
    """(keep, at, expected, read_as): aksharas that differ at one place of both words, up to the shorter's end."""
    arrays = pairs.select(*keep, aksharas(F.col("ref")).alias("r"), aksharas(F.col("hyp")).alias("h"))
    both = F.least(F.size("r"), F.size("h"))
    zipped = F.zip_with(F.slice("r", 1, both), F.slice("h", 1, both), lambda r, h: F.struct(r.alias("expected"), h.alias("read_as")))
    each = F.transform(zipped, lambda p, i: F.struct(i.alias("at"), p["expected"].alias("expected"), p["read_as"].alias("read_as")))
    return arrays.select(*keep, F.explode(F.filter(each, lambda p: p["expected"] != p["read_as"])).alias("p")).select(*keep, "p.*")


def akshara_confusions(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """(expected, read_as, n): aksharas that differ at one place of both words.

    Most common first, ties by the pair. k keeps the top ones.
    """
    counted = _differing(pairs).groupBy("expected", "read_as").agg(F.count("*").alias("n"))
    return counted if k is None else counted.orderBy(F.desc("n"), "expected", "read_as").limit(k)


def first_seen_confusions(pairs: DataFrame, k: int = 25, place: str = "place") -> DataFrame:
    """(expected, read_as, n): the k most common confusions of pairs(place, ref, hyp), ties in the order in which they first appear."""
    return most_common_first(_differing(pairs, place), k, "expected", "read_as", seen=(place, "at"))


def incorrect(pairs: DataFrame) -> DataFrame:
    """Rows whose aksharas differ, with arrays, distance and lengths."""
    return measured(pairs).where(~F.col("exact"))


def distance_histogram(pairs: DataFrame) -> DataFrame:
    """Incorrect rows by edit distance."""
    return incorrect(pairs).groupBy("dist").agg(F.count("*").alias("n"))


def length_histogram(pairs: DataFrame) -> DataFrame:
    """Incorrect rows by (length of the reference, length of the reading)."""
    return incorrect(pairs).groupBy("ref_n", "hyp_n").agg(F.count("*").alias("n"))


def error_rows(pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Incorrect rows as the error analysis lists them."""
    return incorrect(pairs).select(*keep, F.col("ref").alias("truth"), F.col("hyp").alias("prediction"), F.col("ref_a").alias("truth_aksharas"), F.col("hyp_a").alias("prediction_aksharas"), F.col("dist").alias("distance"), F.col("ref_n").alias("truth_length"), F.col("hyp_n").alias("prediction_length"))


def changed_readings(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that two runs read differently (null safe)."""
    joined = a.select(key, F.col("hyp").alias("hyp_a")).join(b.select(key, F.col("hyp").alias("hyp_b")), key)
    return joined.where(~F.col("hyp_a").eqNullSafe(F.col("hyp_b")))


def build_report(rows: DataFrame, threshold: float | None = None, corrected: bool = False, key: str = "row_id", top: int = 25) -> DataFrame:
    """One row of nested results over rows(key, ref, hyp, conf[, score][, after]).

    Detection needs threshold and score (a chance of error); correction needs after.
    """
    m = measured(rows).withColumn("correct", F.col("exact").cast("int"))
    parts = {"recognition": recognition_metrics(rows), "calibration": calibration_metrics(m, key=key)}
    if threshold is not None:
        wrong = m.withColumn("y", 1 - F.col("correct"))
        areas = roc_auc(wrong).crossJoin(F.broadcast(pr_auc(wrong)))
        parts["detection"] = detection_metrics(wrong, threshold).crossJoin(F.broadcast(areas))
    if corrected:
        parts["final"] = recognition_metrics(rows.select(key, "ref", F.col("after").alias("hyp")))
        parts["correction"] = correction_audit(rows)
    confusions = akshara_confusions(rows, top).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "expected", "read_as", "n"))).alias("c"))
    out = confusions.select(F.transform("c", lambda c: F.struct(c["expected"].alias("expected"), c["read_as"].alias("read_as"), c["n"].alias("n"))).alias("confusions"))
    for name, part in parts.items():  # one row each
        out = out.crossJoin(F.broadcast(part.select(F.struct("*").alias(name))))
    return out.select(*parts, "confusions")


def rounded(report: DataFrame, places: int = 4) -> DataFrame:
    """A report with its floating numbers rounded, also those inside structs and arrays, as reports are printed."""

    def of(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.round(value, places)
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*[of(value[f.name], f.dataType).alias(f.name) for f in kind]))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: of(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda _, x: of(x, kind.valueType))
        return value

    return report.select(*[of(F.col(f.name), f.dataType).alias(f.name) for f in report.schema])
