"""Data files and manifest lines, written together."""

import os

import pytest
from pyspark.sql import functions as F

from glyphspark.sources import pairs

SCHEMA = "image string, row_id long, text string"


def rows(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("row_id"), F.concat(F.lit("कल "), F.col("id").cast("string")).alias("text"), F.encode(F.concat(F.lit("data of "), F.col("id").cast("string")), "UTF-8").alias("data")).repartition(3)


def lines(spark, path):
    return sorted((r.row_id, r.text, r.image) for r in pairs.read_pairs(spark, path, SCHEMA).collect())


def failing(df, at):
    """df with an error when row `at` is read."""
    return df.withColumn("text", F.when(F.col("row_id") == at, F.raise_error(F.lit("half-way"))).otherwise(F.col("text")))


@pytest.mark.parametrize("uri", [False, True])
def test_every_line_has_its_file(spark, tmp_path, uri):
    path = f"file://{tmp_path}/m" if uri else f"{tmp_path}/m"
    assert lines(spark, path) == []
    pairs.write_pairs(rows(spark, 0, 50), path, suffix=".png")
    pairs.write_pairs(rows(spark, 50, 60), path, suffix=".png")
    got = lines(spark, path)
    assert [r[0] for r in got] == list(range(60)) and got[7][1] == "कल 7"
    assert all(open(image, "rb").read() == f"data of {i}".encode() and image.endswith(".png") for i, _, image in got)
    joined = pairs.with_data(pairs.read_pairs(spark, path, SCHEMA)).collect()
    assert {r.row_id: bytes(r.content) for r in joined} == {i: f"data of {i}".encode() for i in range(60)}


def test_a_failed_task_leaves_no_line(spark, tmp_path):
    path = f"{tmp_path}/m"
    pairs.write_pairs(rows(spark, 0, 20), path)
    before = lines(spark, path)
    with pytest.raises(Exception, match="half-way"):
        pairs.write_pairs(failing(rows(spark, 100, 200), 150), path)
    assert lines(spark, path) == before and pairs.read_pairs(spark, path, SCHEMA).count() == 20
    # what it had written is there, but no line names it
    assert pairs.swept(path, 3600) == 0
    pairs.swept(path, -1)
    held = {os.path.basename(os.path.dirname(image)) for _, _, image in before}
    assert set(os.listdir(f"{path}/data")) == held and lines(spark, path) == before
    assert all(os.path.exists(image) for _, _, image in before)


def test_overwrite_and_odd_rows(spark, tmp_path):
    path = f"{tmp_path}/m"
    pairs.write_pairs(rows(spark, 0, 9), path)
    odd = spark.createDataFrame([(1, None, None), (1, "", b""), (1, "", b"")], "row_id long, text string, data binary")
    pairs.write_pairs(odd, path, mode="overwrite")
    got = pairs.read_pairs(spark, path, SCHEMA).collect()
    assert sorted((r.row_id, r.text or "") for r in got) == [(1, ""), (1, ""), (1, "")] and len({r.image for r in got}) == 3
    pairs.write_pairs(odd.limit(0), path, mode="overwrite")
    assert pairs.read_pairs(spark, path, SCHEMA).count() == 0
    with pytest.raises(Exception, match="image"):
        pairs.write_pairs(odd.withColumn("image", F.lit("x")), path)
