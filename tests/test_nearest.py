"""Lexicon search by segments against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from glyphspark.functions.distance import edit_distance
from glyphspark.functions.text import aksharas
from glyphspark.operators import correction

# aksharas of one and of several code points
UNITS = ["क", "त", "न", "कि", "स्त्री", "क्ष", "a", "É"]


def words_of(rng, n, longest, units):
    return sorted({"".join(rng.choices(units, k=rng.randint(1, longest))) for _ in range(n)})


def edited(rng, word, units, times):
    out = list(word)
    for _ in range(times):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randint(0, 1)] = rng.choices(units, k=rng.randint(0, 1))
    return "".join(out)


def all_pairs(asked, lex, most):
    a, b = asked.withColumn("a", aksharas(F.col("word"))), lex.select(F.col("word").alias("candidate"), aksharas(F.col("word")).alias("b"))
    near = a.crossJoin(b).withColumn("distance", edit_distance(F.col("a"), F.col("b"))).where(F.col("distance") <= most)
    return {(r.word, r.candidate): r.distance for r in near.select("word", "candidate", "distance").collect()}


@pytest.mark.parametrize(("most", "longest", "units"), [(0, 5, UNITS[:3]), (1, 6, UNITS[:3]), (2, 4, UNITS[:2]), (2, 9, UNITS), (3, 11, UNITS[:3]), (4, 8, UNITS[:2])])
def test_equals_all_pairs(spark, most, longest, units):
    rng = random.Random(most * 100 + longest)
    entries = words_of(rng, 130, longest, units)
    asked = sorted({*words_of(rng, 60, longest, units), *(edited(rng, rng.choice(entries), units, most) for _ in range(60))} - {""})
    q, lex = spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(w, i) for i, w in enumerate(entries)], "word string, freq long")
    got = {(r.word, r.candidate): r.distance for r in correction.nearest(q, lex, most, limit=None).collect()}
    assert got == all_pairs(q, lex, most)


def test_keys_of_a_word_do_not_grow_with_it(spark):
    df = spark.createDataFrame([("क" * n, n) for n in (1, 2, 3, 8, 60, 500)] + [("".join(random.Random(n).choices(UNITS[:6], k=n)), n) for n in (8, 60, 500)], "word string, n int")
    for most, kept, asked in ((1, 6, 5), (2, 15, 10), (3, 30, 22)):
        entries = correction.search_keys(df, "word", most, True).groupBy("word", "n").count().collect()
        assert max(r["count"] for r in entries if r.n > most) <= kept and max(r["count"] for r in correction.search_keys(df, "word", most, False).groupBy("word", "n").count().collect() if r.n > most) <= asked


def test_ranks_and_limit(spark):
    lex = spark.createDataFrame([("abcd", 5), ("abce", 9), ("abcf", 9), ("abxy", 1), ("zzzz", 99)], "word string, freq long")
    got = correction.nearest(spark.createDataFrame([("abcd",), ("abcd",)], "word string"), lex, 2, 3).orderBy("rank").collect()
    assert [(r.candidate, r.distance, r.rank) for r in got] == [("abcd", 0, 1), ("abce", 1, 2), ("abcf", 1, 3)]
    assert correction.nearest(lex.select("word").limit(0), lex).count() == 0
