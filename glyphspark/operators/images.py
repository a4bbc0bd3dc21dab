"""Images as rows of Spark's image schema: quality, preparation, segmentation, augmentation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..functions import pixels

# Limits of the quality rules.
LEAST_INK, LEAST_ASPECT, LEAST_CONTRAST, LEAST_SHARPNESS, MOST_SHADOW, MOST_MARGIN = 40, 1.25, 60.0, 12.0, 25.0, 0.28

IMAGE = "origin string, height int, width int, nChannels int, mode int, data binary"
METRICS = "width int, height int, aspect double, sharpness double, contrast double, shadow double, ink_pixels int, margin double"


def to_array(row: dict | pd.Series) -> np.ndarray:
    """Pixels of an image row; a blank 384 x 384 page where there are none."""
    if row["data"] is None or not row["height"] or row["height"] < 0:
        return np.full((384, 384), 255, np.uint8)
    a = np.frombuffer(row["data"], np.uint8).reshape(int(row["height"]), int(row["width"]), int(row["nChannels"]))
    return a[:, :, 0] if a.shape[2] == 1 else a


def to_row(origin: str, a: np.ndarray) -> dict:
    channels = 1 if a.ndim == 2 else a.shape[2]
    return {"origin": origin, "height": a.shape[0], "width": a.shape[1], "nChannels": channels, "mode": {1: 0, 3: 16, 4: 24}[channels], "data": np.ascontiguousarray(a).tobytes()}


def _mapped(images: DataFrame, schema: str, each: Callable[[dict], list[dict]]) -> DataFrame:
    """One image after another; pixels leave the task only if each() returns them."""
    ship(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for frame in frames:
            out = [r for row in frame.to_dict("records") for r in each(row)]
            yield pd.DataFrame(out, columns=names)

    return images.select("origin", "height", "width", "nChannels", "mode", "data").mapInPandas(run, schema)


def load(spark, path: str, drop_invalid: bool = False) -> DataFrame:
    """Images below a path; invalid ones as rows without pixels (blank pages to later steps)."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).load(path).select("image.*")


def inspect(images: DataFrame) -> DataFrame:
    """origin and METRICS of each image."""
    return _mapped(images, f"origin string, {METRICS}", lambda r: [{"origin": r["origin"], **pixels.inspect(to_array(r))}])


def preflight_errors() -> Column:
    """Reasons to refuse, from METRICS; too little ink is the only one then."""
    return F.when(F.col("ink_pixels") < LEAST_INK, F.array(F.lit("no ink"))).otherwise(F.array_compact(F.array(
        F.when(F.col("aspect") < LEAST_ASPECT, "not a word"), F.when(F.col("contrast") < LEAST_CONTRAST, "low contrast"), F.when(F.col("sharpness") < LEAST_SHARPNESS, "blurred"),
    )))


def preflight_warnings() -> Column:
    return F.when(F.col("ink_pixels") < LEAST_INK, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.when(F.col("shadow") > MOST_SHADOW, "shadow"), F.when(F.col("margin") > MOST_MARGIN, "wide margin"))))


def preflight(metrics: DataFrame) -> DataFrame:
    """metrics with ok, errors and warnings; native, so it prunes before any model runs."""
    return metrics.withColumns({"errors": preflight_errors(), "warnings": preflight_warnings()}).withColumn("ok", F.size("errors") == 0)


def prepare(images: DataFrame, shadow: float = 12.0) -> DataFrame:
    """Images with lighting evened out where needed, and a report of it."""

    def each(r: dict) -> list[dict]:
        out, report = pixels.prepared(pixels.capped(to_array(r)), shadow)
        return [{**to_row(r["origin"], out), "lighting": report["lighting"], "original": report["original"], "final": report["final"]}]

    return _mapped(images, f"{IMAGE}, lighting boolean, original array<int>, final array<int>", each)


def auto_crop(images: DataFrame, pad: float = 0.20) -> DataFrame:
    return _mapped(images, IMAGE, lambda r: [to_row(r["origin"], pixels.auto_crop(to_array(r), pad))])


def augment(images: DataFrame, seed: int = 42, p: float = 0.5) -> DataFrame:
    """Seeded by origin, so a rerun of a task gives the same pixels."""
    import zlib

    return _mapped(images, IMAGE, lambda r: [to_row(r["origin"], pixels.augmented(to_array(r), seed ^ zlib.crc32(str(r["origin"]).encode()), p))])


def skew_scores(images: DataFrame) -> DataFrame:
    """(origin, angle, score) over the grid of angles."""
    return _mapped(images, "origin string, angle double, score double", lambda r: [{"origin": r["origin"], "angle": a, "score": s} for a, s in pixels.skew_scores(pixels.binarize(to_array(r)))])


def skew(scores: DataFrame) -> DataFrame:
    """(origin, angle): the best angle, the first on a tie; under 0.2 degrees none."""
    best = scores.groupBy("origin").agg(F.max_by("angle", F.struct("score", -F.col("angle"))).alias("angle"))
    return best.withColumn("angle", F.when(F.abs("angle") < 0.2, 0.0).otherwise(F.col("angle")))


def ink_profiles(images: DataFrame) -> DataFrame:
    """(origin, height, rows, cols): ink sums of each row and column."""

    def each(r: dict) -> list[dict]:
        bw = pixels.binarize(to_array(r)) > 0
        return [{"origin": r["origin"], "height": bw.shape[0], "rows": bw.sum(1).astype(float).tolist(), "cols": bw.sum(0).astype(float).tolist()}]

    return _mapped(images, "origin string, height int, rows array<double>, cols array<double>", each)


def segment_pages(images: DataFrame, level: bool = True) -> DataFrame:
    """One row a word: origin, angle, line_no, word_no (from 1), box, and the crop's pixels."""

    def each(r: dict) -> list[dict]:
        img = pixels.grey(pixels.capped(to_array(r)))
        found = pixels.segment(img, level)
        turned = pixels.rotated(img, found["angle"], 255) if found["angle"] else img
        return [{"origin": r["origin"], "angle": found["angle"], "line_no": n, "word_no": k, "x": x, "y": y, "w": w, "h": h, "data": np.ascontiguousarray(turned[y : y + h, x : x + w]).tobytes()} for n, k, x, y, w, h in found["words"]]

    return _mapped(images, "origin string, angle double, line_no int, word_no int, x int, y int, w int, h int, data binary", each)


def overlay(images: DataFrame, level: bool = True) -> DataFrame:
    """Pages with the outlines of their lines and words, for tuning."""
    return _mapped(images, IMAGE, lambda r: [to_row(r["origin"], pixels.overlay(pixels.capped(to_array(r)), level))])
