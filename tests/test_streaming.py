"""Running metrics over a stream against the batch operator."""

import math
import random

import pytest
from pyspark.sql import functions as F

from glyphspark.operators import recognition
from glyphspark.streaming import running

SCHEMA = "row_id long, run string, ref string, hyp string"


def made(n, run, seed):
    rng = random.Random(seed)
    words = ["किताब", "कल", "स्कूल", "x", ""]
    return [(i, run, rng.choice(words[:4]), rng.choice(words)) for i in range(n)]


def feed(spark, path, rows, name):
    """One file, rows in any order."""
    rows = rows[:]
    random.Random(name).shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


@pytest.mark.parametrize("every", [7, 50])
def test_uneven_batches_and_a_restart_give_the_batch_result(spark, tmp_path, every):
    running.with_rocks(spark)
    a, b = made(333, "a", 1), made(120, "b", 2)
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    stream = lambda: running.running_lines(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(src), run="run", every=every)
    for k, part in enumerate((a[:13] + b[:1], a[13:14], a[14:200])):
        feed(spark, src, part, str(k))
    running.run_to_end(stream(), out, check)
    for k, part in enumerate((a[200:210] + b[1:100], a[210:], b[100:])):
        feed(spark, src, part, f"more{k}")
    running.run_to_end(stream(), out, check)
    running.run_to_end(stream(), out, check)
    got = spark.read.parquet(out)
    for name, rows in (("a", a), ("b", b)):
        want = recognition.running_metrics(spark.createDataFrame(rows, SCHEMA), every=every).orderBy("seen").collect()
        have = got.where(F.col("run") == name).orderBy("seen").collect()
        assert [r.seen for r in have] == [r.seen for r in want] == list(range(every, len(rows) + 1, every))
        for x, y in zip(have, want, strict=True):
            assert math.isclose(x.accuracy, y.accuracy) and math.isclose(x.mean_aer, y.mean_aer, rel_tol=1e-12)
