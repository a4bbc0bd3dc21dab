"""Packed arrays, the shared folder, written tables."""

import os

import numpy as np
from pyspark.sql import functions as F

from glyphspark.llm import common


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    arrays = [np.zeros(0, np.int64), rng.integers(-5, 300, 1000), rng.integers(0, 2**63, 50).astype(np.uint64), rng.random((7, 3)), np.arange(12).reshape(3, 4), np.array([True, False]), np.array([-1, 2**40]), np.array([2**64 - 1], np.uint64)]
    for a, b in zip(arrays, common.unpack(common.pack(*arrays)), strict=True):
        assert a.shape == b.shape and (a == b).all()


def test_bucket_is_crc32_of_the_text(spark):
    import zlib

    rows = spark.createDataFrame([(7,), (None,), (-12,)], "doc_id long").select("doc_id", common.bucket(F.col("doc_id"), 5).alias("b")).collect()
    assert [r.b for r in rows] == [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 for r in rows]


def test_scratch(spark):
    scratch = common.Scratch(spark, "test")
    kept = scratch.keep(spark.range(5), "five")
    assert kept.count() == 5 and scratch.root.startswith(common.shared_dir(spark))
    path = scratch.root.removeprefix("file://")
    assert os.path.isdir(f"{path}/five")
    common.clear(spark)
    assert not os.path.exists(path)
