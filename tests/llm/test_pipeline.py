"""The pipeline's stages against what their operators say, row by row."""

from collections import Counter

import math
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphspark.llm import simhash
from tests.llm.test_simhash import jaccard, plain_print

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        path = f"{root}/{name}"
        f(spark, docs, D).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def _radius(similarity, bits):
    """Bits in which fingerprints of sets with that Jaccard similarity differ, and one standard deviation."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + math.sqrt(bits * p * (1 - p)))



def test_quality_stage(spark, stages):
    before, after = stages[0]
    assert after.columns == before.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    ids = {r.doc_id for r in before.select("doc_id").collect()}
    good, bad = ({d for d, q in labels.items() if q == v and d in ids} for v in (1, 0))
    assert len(good & kept) / len(good) > 0.97 and len(bad & kept) / len(bad) < 0.1


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    assert after.columns == before.columns
    rows = {r.doc_id: r.text for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    narrow = {d: plain_print(t) for d, t in rows.items()}
    wide = {d: simhash.fingerprints_of(t.encode(), ((5, 4),))[0] for d, t in rows.items()}
    ids, radius = sorted(rows), _radius(0.8, 256)
    w = np.array([wide[d] for d in ids])
    linked, alike = {d: {d} for d in ids}, []
    for i, d in enumerate(ids):
        near = np.bitwise_count(w[i] ^ w).sum(1) <= radius
        for j in range(len(ids)):
            if j != i and (near[j] or (narrow[d] ^ narrow[ids[j]]).bit_count() <= 3):
                linked[d].add(ids[j])
                if d < ids[j] and jaccard(rows[d], rows[ids[j]]) >= 0.8:
                    alike.append((d, ids[j]))
    # brute-force groups, of which the stage may part few
    group = {}
    for d in ids:
        if d not in group:
            stack = [d]
            while stack:
                x = stack.pop()
                if x not in group:
                    group[x] = d
                    stack += linked[x]
    assert set(group.values()) <= kept and len(kept) <= 1.02 * len(set(group.values()))
    # nothing goes that isn't in a group with an earlier document; exact and near copies do go
    assert all(group[d] < d for d in rows.keys() - kept)
    assert len(alike) > 10 and sum(not {a, b} <= kept for a, b in alike) / len(alike) > 0.95
    assert not any((narrow[a] ^ narrow[b]).bit_count() <= 3 for a in kept for b in kept if a < b)


def test_mix_stage(stages):
    before, after = stages[2]
    assert after.columns == before.columns
    there = {r.doc_id: r for r in before.collect()}
    times = Counter()
    for r in after.collect():
        assert r == there[r.doc_id]
        times[r.doc_id] += 1
    assert max(times.values()) <= 2
    words = {d: len(r.text.encode().split()) for d, r in there.items()}
    total = sum(words.values())
    assert sum(words[d] * n for d, n in times.items()) == pytest.approx(1.5 * total, abs=len({r.source for r in there.values()}))


def test_pack_stage(stages):
    before, after = stages[3]
    words = Counter()
    for r in before.collect():
        words[r.doc_id] += len(r.text.encode().split())
    got = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == dict(words)
    full = after.where("bin_id is not null").groupBy("bin_id").agg(F.sum("length").alias("n"), F.count_distinct("source").alias("s"), F.count_distinct("doc_id").alias("d"), F.count("*").alias("k"))
    assert full.where("n > 2048 or s <> k or d <> k").count() == 0


def test_run_and_edges(spark, stages, tmp_path):
    assert sorted(map(str, corpus_pipeline.run(spark, D).select("doc_id", "piece", "length").collect())) == sorted(map(str, stages[3][1].select("doc_id", "piece", "length").collect()))
    odd = spark.createDataFrame([(1, None, "s", 3, "x"), (1, None, "s", 3, "x"), (None, "", None, 1, "y"), (2, "a b c " * 3000, None, 0, "z"), (3, "A b  c " * 3000, "s", 0, "z")], "doc_id long, text string, source string, size int, row string")
    for name, f in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            got = f(spark, docs, D)
            if name != "pack":
                assert got.columns == docs.columns
            got.collect()
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd, D).collect()) == [1, 2]


def test_a_text_stays_whatever_else_has_its_doc_id(spark):
    words = ["w%d" % i for i in range(300)]
    other, third = " ".join("o%d" % i for i in range(200)), " ".join("t%d" % i for i in range(200))
    near = lambda n: " ".join(words[n:])
    rows = [(4, near(0)), (5, near(9)), (5, other), (6, third), (6, third + " end"), (None, "alone"), (None, other + " x"), (None, "alone too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, D).collect()
    assert Counter(r.doc_id for r in kept) == {4: 1, 5: 1, 6: 1, None: 2}
    assert {r.text for r in kept} >= {near(0), other, "alone", "alone too"}
