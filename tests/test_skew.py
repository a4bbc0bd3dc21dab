"""Lookups with hot keys against a plain join."""

import math
import random

from pyspark.sql import functions as F

from glyphspark.operators import correction, skew


def test_lookup_equals_a_join_and_bounds_every_key(spark):
    rng = random.Random(0)
    rows = [(i, "hot" if rng.random() < 0.4 else "warm" if rng.random() < 0.1 else f"k{rng.randrange(900)}", rng.randrange(3), "x") for i in range(5000)] + [(9000, None, 1, "x")]
    df = spark.createDataFrame(rows, "i int, k string, n int, hot string")
    table = spark.createDataFrame([(k, n, k + str(n)) for k in ["hot", *(f"k{i}" for i in range(0, 900, 2))] for n in range(3)], "k string, n int, v string")
    want = {(r.i, r.v) for r in df.join(table, ["k", "n"], "left").collect()}
    got = skew.lookup(df, table, ["k", "n"], 20)
    assert {(r.i, r.v) for r in got.collect()} == want and got.count() == len(rows) and set(got.columns) == {*df.columns, "v"}
    found = skew.hot_keys(df, ["k", "n"], 20)
    frequent, rest = skew.parted(df, found)
    assert found.count() < 20 and {r.k for r in found.collect()} == {"hot"} and frequent.count() + rest.count() == len(rows)
    assert rest.groupBy("k", "n").count().agg(F.max("count")).first()[0] <= len(rows) / 20
    assert skew.lookup(df.limit(0), table, ["k", "n"]).count() == 0


def test_hot_contexts_leave_probabilities_as_they_are(spark, monkeypatch):
    rng = random.Random(1)
    texts = [rng.choices("abcd", [9, 3, 2, 1], k=rng.randint(1, 6)) for _ in range(80)]
    model = correction.NgramModel.fit(spark.createDataFrame([(t,) for t in texts], "units array<string>"), 3)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:20], ["z"], [], ["a"] * 40])], "k int, units array<string>")
    found = []
    for hot in (1, 30, 10**9):
        monkeypatch.setattr(skew.lookup, "__defaults__", (hot,))
        found.append({r.k: (r.logprob, r.n) for r in model.logprob(asked, "k").collect()})
    for other in found[1:]:
        assert other.keys() == found[0].keys() and all(math.isclose(other[k][0], v[0]) and other[k][1] == v[1] for k, v in found[0].items())
