"""Dataset preparation end to end: annotation files and images to manifests, vocabulary, lexicon, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import dataset_stats, parse_annotations, resolve_images, skip_counts, split_by_label, split_of_name
from ..operators.vocab import build_vocab, itos_of, unique_labels
from ..sources.files import annotation_lines, image_files, write_json_lines, write_lexicon, write_value


def manifest(lines: DataFrame, files: DataFrame, raw: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows(image, text, split), skip counts) of annotation lines(value, path).

    A file's name gives its split; if none says train, the rows of unnamed files are split by label.
    """
    parsed = parse_annotations(lines.withColumn("ann_dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    resolved = resolve_images(parsed.where("reason is null"), files, raw)
    bad = parsed.where("reason is not null").select("reason").unionByName(resolved.select(F.when(F.col("image").isNull(), "image").alias("reason")))
    named = resolved.where("image is not null").select("image", "text", split_of_name(F.substring_index("path", "/", -1)).alias("split"))
    if named.where("split = 'train'").isEmpty():
        rows = split_by_label(named.where("split = 'unknown'").select("image", "text"), seed)
    else:
        rows = named.where("split <> 'unknown'")
    return rows.select("image", "text", "split"), skip_counts(bad)


def prepare(spark: SparkSession, raw: str, out: str, min_freq: int = 2, seed: int = 42) -> DataFrame:
    """Write manifests by split, charset, lexicon and statistics below out; returns the manifest rows."""
    rows, _ = manifest(annotation_lines(spark, raw), image_files(spark, raw), raw, seed)
    write_json_lines(rows, f"{out}/manifest", by="split")
    written = spark.read.schema("image string, text string, split string").json(f"{out}/manifest")
    train = written.where("split = 'train'")
    write_value(itos_of(build_vocab(train, min_freq=min_freq)), f"{out}/charset")
    write_lexicon(unique_labels(train), f"{out}/lexicon")
    write_value(dataset_stats(written, min_freq), f"{out}/stats")
    return written
