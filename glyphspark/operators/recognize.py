"""Recognition end to end: quality rules, preparation, an injected model, word results, page text.

Words are images of Spark's image schema, told apart by origin. An image that the rules refuse is
read all the same, as it is, and its result says so; the others are cropped and evened out first.
Pixels stay in the rows that Python steps pass on; results join by origin alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from .images import IMAGE, METRICS, _mapped, preflight, segment_pages, to_array, to_row
from .uncertainty import predict, sequence_features, word_results

LOW = 0.60
IMAGE_COLUMNS = [f.split()[0] for f in IMAGE.split(", ")]


def checked(images: DataFrame) -> DataFrame:
    """images with METRICS (of these, the image's own width and height), errors, warnings and ok."""
    kept = ", ".join(f for f in METRICS.split(", ") if f.split()[0] not in IMAGE_COLUMNS)

    def each(row: dict) -> list[dict]:
        return [{**pixels.inspect(to_array(row)), **row}]

    return preflight(_mapped(images, f"{IMAGE}, {kept}", each))


def readable(found: DataFrame) -> DataFrame:
    """Images as the model sees them: prepared where found (see checked) is ok, else as they are."""

    def each(row: dict) -> list[dict]:
        return [to_row(row["origin"], pixels.prepared(pixels.capped(to_array(row)))[0])]

    good = _mapped(found.where("ok"), IMAGE, each)
    return good.unionByName(found.where(~F.col("ok")).select(IMAGE_COLUMNS))


def read_words(images: DataFrame, load: Callable[[], Callable], name: str, references: DataFrame | None = None, low: float = LOW, mc_passes: int = 0) -> DataFrame:
    """A result for each of images: final and raw text, confidence, characters, flags, errors, warnings, rejected.

    references(origin, reference) gives error rates. load and name: see predict().
    """
    found = checked(images)
    read = sequence_features(predict(readable(found), load, name, "origin string", mc_passes=mc_passes))
    if references is not None:
        read = read.join(references.select("origin", "reference"), "origin", "left")
    words = word_results(read, low).withColumnsRenamed({"weakest": "weakest_position", "token_entropies": "entropy_per_char"})
    told = found.select("origin", "errors", "warnings", (~F.col("ok")).alias("rejected"), F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    columns = ["confidence", "char_probs", "entropy_per_char", "weakest_position", "flagged", "reasons", "error_rate", "word_length", "character_count"]
    return words.join(told, "origin").select("origin", F.col("text").alias("final"), F.col("text").alias("raw"), *columns, "rejected", "errors", "warnings", "image_width", "image_height")


def as_detected(words: DataFrame) -> DataFrame:
    """words of whole images as detections: the box is the image, found for certain."""
    box = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("image_width").alias("w"), F.col("image_height").alias("h"))
    return words.withColumns({"recognition_accuracy": F.round("confidence", 4), "detection_accuracy": F.lit(1.0), "box": box, "line_number": F.lit(1), "word_number": F.lit(1)})


def word_origin() -> Column:
    return F.format_string("%s#%d-%d", "origin", "line_no", "word_no")


def read_pages(pages: DataFrame, load: Callable[[], Callable], name: str, low: float = LOW, level: bool = True) -> DataFrame:
    """A result for each word of pages: origin (the page's), box, line_number, word_number and what read_words gives."""
    found = segment_pages(pages, level).withColumn("word", word_origin())
    crops = found.select(F.col("word").alias("origin"), F.col("h").alias("height"), F.col("w").alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), "data")
    where = found.select("word", F.col("origin").alias("page"), "angle", F.struct("x", "y", "w", "h").alias("box"), F.col("line_no").alias("line_number"), F.col("word_no").alias("word_number"))
    words = read_words(crops, load, name, low=low).join(where, F.col("origin") == F.col("word"))
    return words.drop("origin", "word", "image_width", "image_height").withColumnRenamed("page", "origin").withColumn("recognition_accuracy", F.round("confidence", 4))


def page_texts(words: DataFrame) -> DataFrame:
    """(origin, text, n_words, n_flagged, n_corrected, mean_confidence): lines of words of each page, in order.

    words(origin, line_number, word_number, raw, final, confidence, flagged) of one page meet in one task, as their text must.
    """
    lines = words.groupBy("origin", "line_number").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_number", "final"))), lambda w: w["final"]), " ").alias("line"),
        F.count("*").alias("n"), F.count_if("flagged").alias("f"), F.count_if(F.col("final") != F.col("raw")).alias("c"), F.sum("confidence").alias("s"),
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_number", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("origin").agg(text.alias("text"), F.sum("n").alias("n_words"), F.sum("f").alias("n_flagged"), F.sum("c").alias("n_corrected"), (F.sum("s") / F.sum("n")).alias("mean_confidence"))
