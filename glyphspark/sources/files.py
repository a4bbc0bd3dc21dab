"""Files in and out: JSON lines, annotations, word lists, charsets, images, fonts, configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import SPECIALS
from ..operators.dataset import IMAGE_SUFFIXES
from ..operators.place import line_places

MANIFEST = "image string, text string"


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are no rows."""
    return spark.read.schema(schema).json(path)



def annotation_lines(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """(path, value): lines of all text files below a folder that aren't empty; with places also line_no and place."""
    if places:
        return line_places(spark, path)
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    return lines.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), "value")


def discover(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of files below a folder that aren't empty; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.where("length > 0").select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length").orderBy("path")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of image files below a folder."""
    any_case = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in IMAGE_SUFFIXES)
    return discover(spark, path, f"*.{{{any_case}}}").select("path")


def photos(spark: SparkSession, path: str) -> DataFrame:
    """(path) of .jpg and .jpeg files."""
    return discover(spark, path, "*.{jpg,jpeg}").select("path")


def uploads(spark: SparkSession, path: str, most_mb: float = 10.0) -> DataFrame:
    """Files with contents, and a status: 413 if too large (contents null), else 200."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= int(most_mb * 1024 * 1024)
    return files.select("path", "length", F.when(fits, F.col("content")).alias("content"), F.when(fits, 200).otherwise(413).alias("status"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): a file's white-space separated words."""
    return spark.read.text(path).select(F.explode(F.split("value", r"(?U)\s+")).alias("word")).where("word <> ''")


def read_charset(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a charset file: its special tokens go and the standard ones come first."""
    itos = spark.read.option("multiLine", "true").schema("itos array<string>").json(path)
    specials = F.array(*map(F.lit, SPECIALS))
    rest = F.filter("itos", lambda t: ~F.array_contains(specials, t))
    return itos.select(F.posexplode(F.concat(specials, rest)).alias("id", "token")).select("token", "id")


def fonts(lines: DataFrame) -> DataFrame:
    """(font) of lines as fc-list prints them: Devanagari fonts in TrueType or OpenType files."""
    path = F.substring_index("value", ":", 1)
    return lines.where(F.lower("value").contains("deva") & path.rlike(r"\.(ttf|otf)$")).select(path.alias("font")).distinct().orderBy("font")


def read_config(path: str) -> dict:
    """Nested settings of a YAML or JSON file, on the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def write_json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """One object a line; by partitions the folder by a column, which stays a column on reading."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Add rows; a job's rows appear together when it commits."""
    df.write.mode("append").json(path)


def write_lexicon(labels: DataFrame, path: str) -> None:
    """Sorted words, one a line."""
    labels.select(F.col(labels.columns[0]).alias("value")).orderBy("value").write.mode("overwrite").text(path)


def write_value(one: DataFrame, path: str) -> None:
    """A one-row frame as one JSON object."""
    one.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_value(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def with_base64(df: DataFrame, data: str = "data") -> DataFrame:
    """df with its bytes as base64 text, as responses carry images."""
    return df.withColumn(f"{data}_base64", F.base64(data)).drop(data)
