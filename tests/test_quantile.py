"""Percentiles by selection against NumPy."""

import numpy as np
import pytest

from glyphspark.operators import quantile, uncertainty


@pytest.mark.parametrize("kind", ["uniform", "few", "wide", "hot", "one"])
def test_equals_numpy(spark, monkeypatch, kind):
    monkeypatch.setattr(quantile, "ROWS", 50)
    monkeypatch.setattr(quantile, "RANGES", 8)
    rng = np.random.default_rng(3)
    n = 1 if kind == "one" else 4001
    values = {"uniform": rng.random(n), "few": rng.integers(0, 11, n) / 10, "wide": rng.choice([-1.0, 1.0], n) * 10.0 ** rng.uniform(-300, 300, n), "hot": np.where(rng.random(n) < 0.4, 0.5, rng.random(n)), "one": rng.random(1)}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 7, "v double").repartition(5)
    for share in (0.0, 0.2, 0.5, 0.8, 0.99999, 1.0):
        assert np.isclose(quantile.percentile(df, "v", share), np.quantile(values, share), rtol=1e-12, atol=0), share


def test_rounds_read_less_and_less(spark, monkeypatch):
    monkeypatch.setattr(quantile, "ROWS", 20)
    monkeypatch.setattr(quantile, "RANGES", 8)
    seen, cuts = [], quantile._cuts
    monkeypatch.setattr(quantile, "_cuts", lambda values: seen.append(values.count()) or cuts(values))
    assert quantile.percentile(spark.range(10_000), "id", 0.8) == pytest.approx(7999.2)
    assert len(seen) >= 3 and all(b < a / 4 for a, b in zip(seen, seen[1:]))


def test_odd_values(spark, monkeypatch):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (2.0,)], "v double")
    monkeypatch.setattr(quantile, "ROWS", 0)
    assert quantile.percentile(df, "v", 0.5) == 2.0 and quantile.percentile(df.where("v < 3"), "v", 0.5) == 1.5
    assert quantile.percentile(df.where("v is null"), "v", 0.5) is None and np.isnan(quantile.percentile(df, "v", 1.0))


def test_threshold_and_clashing_columns(spark):
    df = spark.createDataFrame([(0.1, "a", "b", 9), (0.5, "c", "d", 9), (None, "e", "f", 9), (0.9, "g", "h", 9)], "conf double, hyp string, corrected string, threshold int")
    limit = uncertainty.low_confidence_threshold(df, 50.0)
    assert limit.first().threshold == 0.5
    got = uncertainty.correct_below(df, limit)
    assert got.columns == [*df.columns, "after"] and {r.hyp: (r.after, r.threshold) for r in got.collect()} == {"a": ("b", 9), "c": ("c", 9), "e": ("e", 9), "g": ("g", 9)}
    assert [r.after for r in uncertainty.correct_below(df, uncertainty.low_confidence_threshold(df.limit(0))).collect()] == ["a", "c", "e", "g"]
