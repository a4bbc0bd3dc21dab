"""Models inside tasks: loads counted, names and contents told apart, passes as rows."""

import os

import pytest
from pyspark.sql import functions as F

from glyphspark.operators import models, uncertainty

KEEP = "row_id long"


def loader(folder):
    """A load function that leaves a note of each call, and of the process."""

    def load(path: str):
        import os
        import uuid

        with open(path) as f:
            words = f.read().split()
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{os.getpid()} {words[0]}")

        def model(rows, passes=0):
            return [{"text": words[r["row_id"] % len(words)], "tokens": [1], "token_probs": [0.5], "token_entropies": [0.0], "token_margins": [0.1], "mc_variants": [words[0]] * passes} for r in rows]

        return model

    return load


def notes(folder):
    return [open(f"{folder}/{f}").read() for f in os.listdir(folder)]


def test_a_worker_loads_once_for_many_tasks(spark, tmp_path):
    load = loader(str(tmp_path))
    rows = spark.range(400).withColumnRenamed("id", "row_id").repartition(40)
    for _ in range(2):
        got = uncertainty.predict(rows, load, "m", KEEP, weights=b"a b").collect()
        assert {r.row_id: r.text for r in got} == {i: "ab"[i % 2] for i in range(400)}
    found = notes(tmp_path)
    assert len(found) == len(set(found)) <= 16


def test_two_models_of_one_name(spark, tmp_path):
    rows, load = spark.range(20).withColumnRenamed("id", "row_id").repartition(4), loader(str(tmp_path))
    path = tmp_path / "weights"
    path.write_bytes(b"y")
    (tmp_path / "notes").mkdir()
    load = loader(str(tmp_path / "notes"))
    first, second = uncertainty.predict(rows, load, "same", KEEP, weights=b"x"), uncertainty.predict(rows, load, "same", KEEP, weights=str(path))
    assert {r.text for r in first.collect()} == {"x"} and {r.text for r in second.collect()} == {"y"} and {r.text for r in first.union(second).collect()} == {"x", "y"}


def test_the_model_used_longest_ago_goes(monkeypatch):
    monkeypatch.setattr(models, "_LOADED", models.OrderedDict())
    calls = []
    made = [models.Model(k, False, models.cloudpickle.dumps(lambda: None)) for k in "abc"]
    monkeypatch.setattr(models.cloudpickle, "loads", lambda _: lambda: calls.append(1) or object())
    a, b, c = made
    assert a.get() is a.get() and len(calls) == 1
    b.get(), a.get(), c.get()
    assert list(models._LOADED) == ["a", "c"] and len(calls) == 3
    b.get()
    assert list(models._LOADED) == ["c", "b"] and len(calls) == 4


def seeded():
    def model(rows):
        import random

        return [{"text": str(random.Random(r["seed"]).randrange(3)) if r["pass"] else "0", "tokens": [r["pass"]], "token_probs": [0.5], "token_entropies": [0.0], "token_margins": [0.1]} for r in rows]

    return model


@pytest.mark.parametrize("passes", [0, 1, 7])
def test_passes_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch, passes):
    rows = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 9).alias("width"))
    first = None
    for parts, cost in ((1, 20_000), (7, 11), (13, 1_000)):
        monkeypatch.setattr(uncertainty, "TASK_COST", cost)
        got = uncertainty.predict_passes(rows.repartition(parts), seeded, "s", "row_id", passes, "row_id long, width long", batch=5, cost=F.col("width") + 1)
        found = sorted(got.withColumn("d", uncertainty.mc_disagreement(F.col("mc_variants"), F.col("text"))).collect())
        first = first or found
        assert found == first and len(found) == 60 and all(len(r.mc_variants) == passes and r.tokens == [0] and r.width == r.row_id % 9 for r in found)
    if passes == 7:
        assert 0 < sum(r.d for r in first) / 60 < 1 and len({tuple(r.mc_variants) for r in first}) > 40
    with pytest.raises(ValueError, match="seed"):
        uncertainty.predict_passes(rows.withColumn("seed", F.lit(1)), seeded, "s", "row_id", 1)


def test_no_rows(spark):
    none = spark.range(0).withColumnRenamed("id", "row_id")
    assert uncertainty.predict_passes(none, seeded, "s", "row_id", 2, KEEP).count() == 0
