"""Exact top-k inner products by ball-tree branch and bound in each shard.

Components become integers floor(64 x). Vectors are dealt to shards of about SHARD rows by a hash
of their place, so no vector, group of equal vectors or repeated vec_id makes a shard large; each shard builds a ball
tree (median splits along the widest direction; a node knows its centre and radius). An inner
product of q with anything in a node is at most q.c + |q| r: nodes are opened in the order of
that bound, largest first, until it falls below the query's k-th score so far; equal bounds are
opened, for a tie may have a smaller vec_id.

The k-th score is shared. A first pass searches each query in its home shard alone; its k-th score
there is a lower bound for all, and goes with the query to every other shard, which often needs to
open a few nodes only. Within a shard it rises leaf by leaf.

The stated queries meet all rows in blocks: a task holds one shard and a block of about BLOCK
queries, whatever the table's size. A shard's tree is built once and written with its integers, a byte or
two each; that is what travels to its blocks. Every task returns at most k rows a query.

Scores are integers. Where sums may pass 2^53, to which double precision is exact, the same search
scores the leaves it opens with unbounded integers (held within the range of a long); bounds that
overflow open a node. Edge cases: see vectors.py; fewer than k
candidates give all; an empty table or one without queries gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pack, unpack
from .vectors import matrix, merged, queries_of, valid

K = 20
SCALE = 64
#: Larger components count as this.
MOST = 1e300
SHARD = 8_192
LEAF = 64
BLOCK = 2_048
FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes level by level in arrays; leaves are ranges of the reordered rows."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(rows))
        self.begin, self.end, self.left = [0], [len(rows)], []
        centres, radii = [], []
        node = 0
        while node < len(self.begin):
            b, e = self.begin[node], self.end[node]
            own = rows[self.order[b:e]]
            centre = own.mean(0)
            away = np.sqrt(((own - centre) ** 2).sum(1))
            centres.append(centre)
            radii.append(away.max())
            if e - b > leaf and away.max() > 0:
                # along the line between two far points
                p = own[away.argmax()]
                q = own[((own - p) ** 2).sum(1).argmax()]
                mid = b + (e - b) // 2
                self.order[b:e] = self.order[b:e][np.argpartition(own @ (q - p), mid - b)]
                self.left.append(len(self.begin))
                self.begin += [b, mid]
                self.end += [mid, e]
            else:
                self.left.append(-1)
            node += 1
        self.left, self.begin, self.end = map(np.array, (self.left, self.begin, self.end))
        self.centres, self.radii = np.array(centres), np.array(radii)

    @classmethod
    def of(cls, order: np.ndarray, begin: np.ndarray, end: np.ndarray, left: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> BallTree:
        """A tree from its arrays."""
        tree = cls.__new__(cls)
        tree.order, tree.begin, tree.end, tree.left = (x.astype(np.int64) for x in (order, begin, end, left))
        tree.centres, tree.radii = centres, radii
        return tree

    def leaf_bounds(self, queries: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves, and each query's bound for each; -inf below a node that its k-th score rules out."""
        norms = np.sqrt((queries**2).sum(1))
        # rounding must not rule out what is equal
        bound = queries @ self.centres.T + norms[:, None] * self.radii[None, :]
        bound += 1e-9 * (np.abs(bound) + norms[:, None] * (np.sqrt((self.centres**2).sum(1)) + self.radii)[None, :])
        bound[np.isnan(bound)] = np.inf
        level = np.array([0])
        bound[:, 0] = np.where(bound[:, 0] >= kth, bound[:, 0], -np.inf)
        while len(level):
            inner = level[self.left[level] >= 0]
            for side in (0, 1):
                child = self.left[inner] + side
                # a child's bound is never above its parent's
                bound[:, child] = np.minimum(bound[:, child], bound[:, inner])
                bound[:, child] = np.where(bound[:, child] >= kth[:, None], bound[:, child], -np.inf)
            level = np.concatenate([self.left[inner], self.left[inner] + 1])
        leaves = np.flatnonzero(self.left < 0)
        return leaves, bound[:, leaves]


def search(tree: BallTree, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best (score, id) of each query in one shard, k wide, -inf where none; and rows scored.

    kth is a lower bound of each query's k-th score, -inf if none is known.
    """
    leaves, bound = tree.leaf_bounds(queries, kth)
    first = np.argsort(-bound, axis=1, kind="stable")
    score = np.full((len(queries), k), -np.inf)
    vec = np.full((len(queries), k), np.iinfo(np.int64).max)
    scored = np.zeros(len(queries), np.int64)
    kth = kth.astype(float).copy()
    alive = np.arange(len(queries))
    for turn in range(len(leaves)):
        # every query opens its next best leaf; those that share one are scored together
        own = first[alive, turn]
        go = (bound[alive, own] >= kth[alive]) & (bound[alive, own] > -np.inf)
        alive, own = alive[go], own[go]
        if not len(alive):
            break
        by = np.argsort(own, kind="stable")
        cut = np.flatnonzero(np.diff(own[by], prepend=-1))
        for s, e in zip(cut, [*cut[1:], len(by)], strict=True):
            q = alive[by[s:e]]
            at = tree.order[tree.begin[leaves[own[by[s]]]] : tree.end[leaves[own[by[s]]]]]
            new = queries[q] @ rows[at].T
            new[query_ids[q, None] == ids[None, at]] = -np.inf
            scored[q] += len(at)
            up = (new >= kth[q, None]).any(1)  # the others' k best stay
            q, new = q[up], new[up]
            if not len(q):
                continue
            both, whose = np.concatenate([score[q], new], 1), np.concatenate([vec[q], np.broadcast_to(ids[at], new.shape)], 1)
            keep = np.lexsort((whose, -both))[:, :k]
            score[q], vec[q] = np.take_along_axis(both, keep, 1), np.take_along_axis(whose, keep, 1)
            kth[q] = np.maximum(kth[q], score[q, k - 1])
    return score, vec, scored


def search_large(tree: BallTree, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, kth: list[int | None], k: int = K) -> list[tuple[int, int, int]]:
    """As search(), in unbounded integers: (query_id, vec_id, score), those of at least kth."""
    # as doubles, no higher than they are
    low = np.array([-np.inf if x is None else np.nextafter(float(x), -np.inf) for x in kth])
    with np.errstate(over="ignore", invalid="ignore"):
        leaves, bound = tree.leaf_bounds(queries, low)
    whole = lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    out, known = [], {}
    for i, q in enumerate(whole(queries)):
        best, least = [], low[i]
        for leaf in np.argsort(-bound[i], kind="stable"):
            if float(bound[i, leaf]) < least or bound[i, leaf] == -np.inf:
                break
            at = tree.order[tree.begin[leaves[leaf]] : tree.end[leaves[leaf]]]
            if leaf not in known:
                known[leaf] = whole(rows[at])
            scores = ((max(-(2**63), min(2**63 - 1, s)), int(v)) for s, v in zip(known[leaf] @ q, ids[at], strict=True) if v != query_ids[i])
            best = heapq.nsmallest(k, [*best, *((-s, v) for s, v in scores)])
            if len(best) == k:
                least = max(least, -best[-1][0])
        out += [(int(query_ids[i]), v, -s) for s, v in best if kth[i] is None or -s >= kth[i]]
    return out


def _grown(leaf: int):
    """A shard's tree, packed: integers take the narrowest type that holds them."""

    def run(shard: pa.Table) -> pa.Table:
        vecs = shard.column("vec").to_pylist()
        rows = integers(vecs, max(map(len, vecs)))
        with np.errstate(over="ignore", invalid="ignore"):
            tree = BallTree(rows, leaf)
        held = rows.astype(np.int64) if np.abs(rows).max(initial=0) < 2.0**62 else rows
        payload = pack(shard.column("vec_id").to_numpy(), held, tree.order, tree.begin, tree.end, tree.left, tree.centres, tree.radii)
        return pa.table({"shard": [shard.column("shard")[0].as_py()], "tree": [payload]}, schema=pa.schema([("shard", pa.int32()), ("tree", pa.binary())]))

    return run


def integers(vecs: list, dims: int) -> np.ndarray:
    return np.floor(np.clip(SCALE * matrix(vecs, dims), -MOST, MOST))


FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(k: int, home: bool):
    def run(_key: tuple, trees: pa.Table, asked: pa.Table) -> pa.Table:
        if not trees.num_rows or not asked.num_rows:
            return FOUND_SCHEMA.empty_table()
        ids, rows, *nodes = unpack(trees.column("tree")[0].as_buffer())
        vecs = asked.column("vec").to_pylist()
        # the shorter ones end in zeros
        dims = max(rows.shape[1], *map(len, vecs))
        wide = lambda x: np.pad(x.astype(float), ((0, 0), (0, dims - x.shape[1])))
        tree = BallTree.of(*nodes[:4], wide(nodes[4]), nodes[5])
        rows, queries, ids = wide(rows), integers(vecs, dims), ids.astype(np.int64)
        query_ids = asked.column("query_id").to_numpy()
        known = [None] * len(vecs) if home else asked.column("kth").to_pylist()
        if np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * dims < 2.0**53:
            kth = np.array([-np.inf if x is None else x for x in known], float)
            score, vec, _ = search(tree, rows, ids, queries, query_ids, kth, k)
            # what the home shard's k-th score rules out need not travel
            got = (score > -np.inf) & (score >= kth[:, None])
            return pa.table([np.repeat(query_ids, got.sum(1)), vec[got], score[got].astype(np.int64)], schema=FOUND_SCHEMA)
        found = search_large(tree, rows, ids, queries, query_ids, known, k)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 3, schema=FOUND_SCHEMA)

    return run


def top_k(rows: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products."""
    scratch = Scratch(rows.sparkSession, "balltree")
    # written with its place, so that both passes deal alike
    data = scratch.keep(valid(rows).withColumn("place", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    asked = scratch.keep(queries_of(data).select(F.col("vec_id").alias("query_id"), "vec"), "queries")
    n, n_asked = data.count(), asked.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n_asked // block))
    dealt = data.select("vec_id", "vec", F.pmod("place", F.lit(shards)).cast("int").alias("shard"))
    trees = scratch.keep(dealt.groupBy("shard").applyInArrow(_grown(leaf), "shard int, tree binary"), "trees", "none")
    asked = asked.withColumns({"home": F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int"), "block": F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")})

    # home pass: a shard holds about 1/shards of the queries too
    home = trees.groupBy("shard").cogroup(asked.select(F.col("home").alias("shard"), "query_id", "vec").groupBy("shard")).applyInArrow(_searched(k, True), FOUND)
    found = scratch.keep(home, "home")
    kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    others = asked.join(kth, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    sent = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rest = sent.groupBy("shard", "block").cogroup(others.groupBy("shard", "block")).applyInArrow(_searched(k, False), FOUND)
    return merged(found.unionByName(rest), k)
