"""One-dimensional ink profiles: bands, gaps, adaptive gap thresholds, words.

A profile is a table (profile_id, i, v), one row a place. All steps are windows by profile; a profile
is a page's or a line's width, so a window partition is bounded by an image's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "profile_id"


def explode_profiles(rows: DataFrame, values: str = "profile") -> DataFrame:
    """rows(profile_id, profile array) as (profile_id, i, v)."""
    return rows.select(KEY, F.posexplode(values).alias("i", "v")).select(KEY, "i", F.col("v").cast("double").alias("v"))


def smooth(profile: DataFrame, width: int, sigma: float | None = None) -> DataFrame:
    """Gaussian smoothing of odd width, edges mirrored without repeating the edge value."""
    half = width // 2
    sigma = sigma or 0.3 * ((width - 1) * 0.5 - 1) + 0.8
    weights = [2.718281828459045 ** (-(d * d) / (2 * sigma * sigma)) for d in range(-half, half + 1)]
    total = sum(weights)
    by = Window.partitionBy(KEY)
    n = F.max("i").over(by)
    spread = profile.withColumn("n", n).select(KEY, "n", "v", "i", F.explode(F.array(*map(F.lit, range(-half, half + 1)))).alias("d"))
    # where value i lands: at i + d, and where the mirrored copies beyond either end do
    place = F.col("i") + F.col("d")
    weight = F.element_at(F.array(*[F.lit(w / total) for w in weights]), F.col("d") + (half + 1))
    inside = spread.where((place >= 0) & (place <= F.col("n"))).select(KEY, place.alias("i"), (weight * F.col("v")).alias("p"))
    left = spread.where((F.col("i") > 0) & (F.col("d") - F.col("i") >= 0) & (F.col("d") - F.col("i") <= F.col("n"))).select(KEY, (F.col("d") - F.col("i")).alias("i"), (weight * F.col("v")).alias("p"))
    mirrored = 2 * F.col("n") - F.col("i") + F.col("d")
    right = spread.where((F.col("i") < F.col("n")) & (mirrored >= 0) & (mirrored <= F.col("n"))).select(KEY, mirrored.alias("i"), (weight * F.col("v")).alias("p"))
    return inside.unionByName(left).unionByName(right).groupBy(KEY, "i").agg(F.sum("p").alias("v"))


def runs(profile: DataFrame, inked: Column) -> DataFrame:
    """Maximal runs of places where inked holds: (profile_id, start, end), half open."""
    at = Window.partitionBy(KEY).orderBy("i")
    marked = profile.withColumn("_on", inked).where("_on").withColumn("_island", F.col("i") - F.row_number().over(at))
    return marked.groupBy(KEY, "_island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end")).drop("_island")


def bands(profile: DataFrame, share: float = 0.08, least: int = 0) -> DataFrame:
    """Runs above share of the profile's peak, at least `least` long; none if the peak is not above 0."""
    peak = profile.withColumn("_peak", F.max("v").over(Window.partitionBy(KEY)))
    return runs(peak, (F.col("_peak") > 0) & (F.col("v") > F.lit(share) * F.col("_peak"))).where(F.col("end") - F.col("start") >= least)


def interior_gaps(profile: DataFrame) -> DataFrame:
    """Runs without ink between the first and the last ink: (profile_id, start, end, gap)."""
    w = Window.partitionBy(KEY)
    ink = F.when(F.col("v") > 0, F.col("i"))
    inside = profile.withColumns({"_first": F.min(ink).over(w), "_last": F.max(ink).over(w)})
    found = runs(inside, (F.col("v") <= 0) & (F.col("i") > F.col("_first")) & (F.col("i") < F.col("_last")))
    return found.withColumn("gap", F.col("end") - F.col("start"))


def gap_threshold(gaps: DataFrame, heights: DataFrame) -> DataFrame:
    """(profile_id, threshold): the gap from which on words part, for profiles of heights(profile_id, height).

    The largest jump between neighbouring distinct gaps, if at least 1.6 times (the first such),
    cuts at the geometric mean. Else all gaps part words, if their median is at least 0.3 of the
    height (0.6 of the median), or none do (infinity).
    """
    at = Window.partitionBy(KEY).orderBy("gap")
    ratio = gaps.select(KEY, "gap").distinct().withColumn("b", F.lead("gap").over(at)).where("b is not null").withColumn("ratio", F.col("b") / F.greatest(F.col("gap"), F.lit(1)))
    jump = ratio.groupBy(KEY).agg(F.max_by(F.struct("ratio", F.sqrt(F.col("gap") * F.col("b")).alias("cut")), F.struct("ratio", -F.col("gap"))).alias("best"))
    middle = gaps.groupBy(KEY).agg(F.median("gap").alias("median"))
    none = F.lit(float("inf"))
    joined = heights.join(jump, KEY, "left").join(middle, KEY, "left")
    found = F.when(F.col("best.ratio") >= 1.6, F.col("best.cut")).when(F.col("median") >= 0.30 * F.col("height"), F.col("median") * 0.6).otherwise(none)
    return joined.select(KEY, found.alias("threshold"))


def words(profile: DataFrame, heights: DataFrame, least: int = 8) -> DataFrame:
    """(profile_id, word_no from 1, start, end): ink parted by gaps of at least the threshold.

    Words narrower than least go, but the last one that reaches the profile's end open-ended stays
    and ends with the profile.
    """
    limit = gap_threshold(interior_gaps(profile), heights).withColumn("threshold", F.greatest("threshold", F.lit(float(least))))
    size = profile.groupBy(KEY).agg((F.max("i") + 1).alias("size"))
    at = Window.partitionBy(KEY).orderBy("i")
    ink = profile.where("v > 0").select(KEY, "i").join(limit, KEY).withColumn("before", F.lag("i").over(at))
    opens = F.when(F.col("before").isNull() | (F.col("i") - F.col("before") - 1 >= F.col("threshold")), 1).otherwise(0)
    numbered = ink.withColumn("opens", opens).withColumn("w", F.sum("opens").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy(KEY, "w", "threshold").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end")).join(size, KEY)
    # the rest of the line after its last ink closes a word only if it is as long as a gap
    open_end = (F.col("w") == F.max("w").over(Window.partitionBy(KEY))) & (F.col("size") - F.col("end") < F.col("threshold"))
    closed = spans.withColumns({"open": open_end}).withColumn("end", F.when(F.col("open"), F.col("size")).otherwise(F.col("end")))
    kept = closed.where(F.col("open") | (F.col("end") - F.col("start") >= least))
    return kept.select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("start")).alias("word_no"), "start", "end")


def meaningful_words(boxes: DataFrame, share: float = 0.18) -> DataFrame:
    """(profile_id, n_words): boxes(profile_id, w, image_width) wider than share of the image; 1 if there are none."""
    wide = F.count_if(F.col("w") > F.lit(share) * F.col("image_width"))
    return boxes.groupBy(KEY).agg(F.greatest(wide, F.lit(1)).alias("n_words"))


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: int = 0) -> Column:
    """A box with padding, clipped to the image."""
    x0, y0 = F.greatest(x - pad, F.lit(0)), F.greatest(y - pad, F.lit(0))
    return F.struct(x0.alias("x"), y0.alias("y"), (F.least(x + w + pad, width) - x0).alias("w"), (F.least(y + h + pad, height) - y0).alias("h"))
