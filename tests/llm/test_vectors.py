"""Vector searches against brute force."""

import math

import numpy as np
import pandas as pd
import pytest

from glyphspark.llm import ball_tree, cross_polytope
from glyphspark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, score string, part int"


def brute(ids, vectors, k=20):
    out = []
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            best = sorted(((-float(vectors[i] @ v), int(j)) for j, v in zip(ids, vectors) if j != ids[i]))[:k]
            out += [(int(ids[i]), r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return out


def rows(spark, vectors, extra=()):
    data = [(i, [float(x) for x in v], 0, "clash", 1) for i, v in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(data, SCHEMA).repartition(3)


BAD = [(20_000, None, 0, "", 0), (20_020, [], 0, "", 0), (20_040, [1.0, None], 0, "", 0), (20_060, [float("nan"), 1.0], 0, "", 0), (20_080, [float("inf")], 0, "", 0), (None, [1.0], 0, "", 0)]


@pytest.mark.parametrize("shard,block,leaf", [(50, 7, 4), (10_000, 1000, 16)])
def test_top_k_equals_brute_force(spark, shard, block, leaf):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 6)).astype(np.float32)
    v[40:90] = v[7]  # ties
    v[100] = 0
    got = ball_tree.top_k(rows(spark, v, BAD), shard=shard, block=block, leaf=leaf).collect()
    want = brute(range(300), np.floor(64 * v.astype(float)))
    assert sorted(map(tuple, got)) == sorted((a, b, c, int(d)) for a, b, c, d in want)


def test_large_components_are_exact_and_use_the_tree(spark):
    rng = np.random.default_rng(3)
    v = [[int(x) for x in r] for r in rng.integers(-(2**24), 2**24, size=(120, 5))]
    v[30:40] = [v[7]] * 10
    got = ball_tree.top_k(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>"), shard=40, leaf=4).collect()
    want = []
    for i in range(0, 120, 20):
        best = sorted((-sum(64 * a * 64 * b for a, b in zip(v[i], v[j])), j) for j in range(120) if j != i)[:20]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    huge = [(i, [1e305 * (i + 1), -1e305]) for i in range(30)] + [(40, [1.0, 0.0])]
    top = {r.vec_id: r.score for r in ball_tree.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).where("query_id = 40").collect()}
    assert top == {i: 2**63 - 1 for i in range(20)}


def test_rows_of_one_id_are_spread(spark):
    rows_ = [(1, [1.0, 2.0])] * 400 + [(20, [1.0, 0.0]), (21, [9.0, 9.0])]
    got = ball_tree.top_k(spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(4), shard=50).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(21, 64 * 64 * 9)] + [(1, 64 * 64)] * 19


def test_branch_and_bound_skips_leaves():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 100
    v = np.floor(np.repeat(centres, 50, 0) + rng.normal(size=(2000, 8)))
    ids = np.arange(2000)
    _, _, scored = ball_tree.search(ball_tree.BallTree(v, 32), v, ids, v[::100], ids[::100], np.full(20, -np.inf))
    assert scored.mean() < 1000
    best = np.sort(v[::100] @ v.T, axis=1)[:, -21]
    _, _, shared = ball_tree.search(ball_tree.BallTree(v, 32), v, ids, v[::100], ids[::100], best)
    assert shared.sum() <= scored.sum()


def test_edges(spark):
    few = rows(spark, [[1, 2], [3, 4], [0, 0]])
    assert [tuple(r) for r in ball_tree.top_k(few).orderBy("rank").collect()] == [(0, 1, 1, 64 * 64 * 11), (0, 2, 2, 0)]
    assert [tuple(r)[:3] for r in cross_polytope.nearest(few).orderBy("rank").collect()] == [(0, 1, 1)]
    for f in (ball_tree.top_k, cross_polytope.nearest):
        assert f(few.limit(0)).count() == 0
        assert f(few.where("vec_id > 0")).count() == 0
    uneven = spark.createDataFrame([(0, [1.0]), (1, [1.0, 5.0]), (1, [2.0, 9.0]), (2, [1e9, 1e9]), (20, [3e12, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ball_tree.top_k(uneven).collect()}
    assert got[0, 2] == 64 * 64 * 10**9 and got[20, 0] == 64 * 64 * 3 * 10**12 and got[20, 2] == min(2**63 - 1, 64 * 64 * (3 * 10**21 + 10**9))


def test_blocks_bound_the_queries_of_a_task(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    whole = sorted(map(tuple, cross_polytope.nearest(d).collect()))
    met, scored = [], cross_polytope._probe_rows

    def probe_rows(h, where, blocks):
        met.append(blocks)
        return scored(h, where, blocks)

    monkeypatch.setattr(cross_polytope, "_probe_rows", probe_rows)
    monkeypatch.setattr(cross_polytope, "PART_ROWS", 700)
    monkeypatch.setattr(cross_polytope, "BLOCK", 4)
    assert sorted(map(tuple, cross_polytope.nearest(d).collect())) == whole and met == [7]


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = cross_polytope.hadamard(x)
    assert np.allclose((x**2).sum(1), (y**2).sum(1)) and np.allclose(cross_polytope.hadamard(y), x)
    h = cross_polytope.Hashes(16, 3, 2, 5)
    unit = h.lifted(x, False)
    # the first bucket probed is the vector's own
    assert (h.probed(unit)[:, :, 0] == h.buckets(unit)).all()


def recall(got, want):
    truth = pd.DataFrame(want, columns=["q", "rank", "v", "s"])
    found = set(zip(got.query_id, got.vec_id))
    return np.mean([(q, v) in found for q, v in zip(truth.q, truth.v)])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    v = np.array(df.embedding.tolist(), float)
    got = QUERIES["op5_cross_polytope"](spark, f"/root/testdata/{sf}").toPandas()
    assert got.groupby("query_id").size().eq(20).all()
    score = dict(zip(df.vec_id, range(len(df))))
    for r in got.sample(50, random_state=0).itertuples():
        assert math.isclose(r.score, v[score[r.query_id]] @ v[score[r.vec_id]], rel_tol=1e-12)
    assert recall(got, brute(df.vec_id.to_numpy(), v)) >= 0.9


@pytest.mark.parametrize("uneven", [False, True])
def test_recall_at_two_rotations(spark, uneven):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(6000, 32))
    v[1000:3000] = v[5]  # a large bucket, split over parts
    v = (v / np.linalg.norm(v, axis=1)[:, None] * (rng.uniform(0.5, 2, (6000, 1)) if uneven else 1)).astype(np.float32)
    got = cross_polytope.nearest(rows(spark, v, BAD)).toPandas()
    assert recall(got, brute(range(6000), v.astype(float))) >= 0.9
    same = got[got.query_id == 1000].sort_values("rank")
    if not uneven:
        assert same.vec_id.tolist() == [5, *range(1001, 1020)]
