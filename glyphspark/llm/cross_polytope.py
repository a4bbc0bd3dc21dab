"""Approximate nearest neighbours by cross-polytope hashing with multiprobe.

A vector is turned by pseudo-rotations, each three rounds of random signs and a fast Hadamard
transform, and assigned to the signed axis it is nearest to. A table's bucket joins the axes of
`hashes` rotations. A query probes, in each table, the `probes` buckets whose axes its turned
vector is nearest to in sum (its own first); all members met are scored exactly, in double
precision, on the original vectors.

The index holds every vector. The number of rotations in a bucket follows from the number of
vectors, log(n) to base 2 d, so that a bucket's mean size stays bounded, and probes grow with it.
Vectors of unequal norm get one more component that brings all to the largest norm; queries get a
zero there, so that the largest inner product is the nearest vector.

A query must meet k of n vectors, so probes don't fall below SHARE k / n of the axes: where that is
all of them, every vector is met, and fewer than k candidates are all returned.

Scale. Table rows and probes are dealt to parts of about PART_ROWS table rows by a hash of (table,
bucket); a query sends one row a part with the buckets it probes there. Queries are dealt to blocks of about BLOCK, and
a task has one part and one block: some PART_ROWS vectors and BLOCK queries at most, whatever the table's size. So what is moved
is n / PART_ROWS times the queries and, beyond BLOCK queries, their number / BLOCK times the table rows. A bucket with more than
1/8 of a part's rows, and 1/HOT of all, is split over parts by vec_id and place, and probes of it go to all of
these; so there are fewer than HOT such buckets, and all tasks hear of all. A part returns at most k
rows a query. Few tables with many probes each meet as many vectors as many tables with few, and
move less: a vector travels once a table.

Edge cases: see vectors.py; zero vectors take no part; fewer than k candidates found give those; an
empty table or one without queries gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, pack, unpack
from .vectors import QUERY_STEP, matrix, merged, queries_of, valid

K = 20
TABLES = 8
#: Share of the buckets that are probed where one rotation makes a bucket, by what it falls with each further
#: rotation, and how fast it rises where these are few vectors for so many rotations (as a power of the axes).
PROBE, FALL, RISE = 0.28, 12.0, 0.33
#: Times k / n of the axes that are probed at least.
SHARE = 10
SEED = 5
PART_ROWS = 65_536
#: Queries of a task, about.
BLOCK = 65_536
HOT = 65_536
#: Probes found at a time.
PROBED = 1_000_000
#: Candidate pairs scored at a time.
PAIRS = 250_000
#: Queries in a task that finds probes.
QUERIES = 256
FOUND = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class Hashes:
    """Pseudo-rotations of all tables; the same on every machine."""

    def __init__(self, dims: int, tables: int, hashes: int, probes: int, seed: int = SEED, most: float = 0.0) -> None:
        self.dims, self.most, self.tables, self.hashes, self.probes = dims, most, tables, hashes, probes
        self.width = 1 << max(1, math.ceil(math.log2(dims + (most > 0))))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def _turned(self, x: np.ndarray, table: int, i: int) -> np.ndarray:
        for s in self.signs[table, i]:
            x = hadamard(x * s)
        return x

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """To unit vectors of the transform's width, with the component that evens out norms."""
        norm = np.sqrt((x**2).sum(1))
        out = np.zeros((len(x), self.width))
        out[:, : x.shape[1]] = x
        if self.most > 0 and not query:
            out[:, self.dims] = np.sqrt(np.maximum(self.most**2 - norm**2, 0))
            norm = np.sqrt((out**2).sum(1))
        return out / norm[:, None]

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for i in range(self.hashes):
                r = self._turned(x, t, i)
                axis = np.abs(r).argmax(1)
                out[:, t] = out[:, t] * (2 * self.width) + 2 * axis + (r[np.arange(len(r)), axis] < 0)
        return out

    def probed(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) buckets, nearest first; -1 where there are no more."""
        full = (2 * self.width) ** self.hashes
        m = min(self.probes, full)
        # of two falling lists' sums, the m largest lie at places (i, j) with (i + 1) (j + 1) <= m
        first, second = np.nonzero(np.multiply.outer(np.arange(1, m + 1), np.arange(1, 2 * self.width + 1)) <= m)
        out = np.full((len(x), self.tables, m), -1, np.int64)
        for t in range(self.tables):
            keys, near = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for i in range(self.hashes):
                r = self._turned(x, t, i)
                both = np.stack([r, -r], 2).reshape(len(x), -1)  # axis a, sign s at 2 a + s
                best = np.argsort(-both, axis=1)[:, :m]
                some = (first < near.shape[1]) & (second < best.shape[1])
                a, b = first[some], second[some]
                total = near[:, a] + np.take_along_axis(both, best, 1)[:, b]
                joined = keys[:, a] * (2 * self.width) + best[:, b]
                keep = np.argsort(-total, axis=1, kind="stable")[:, :m]
                near, keys = np.take_along_axis(total, keep, 1), np.take_along_axis(joined, keep, 1)
            out[:, t, : keys.shape[1]] = keys
        return out


class Parts:
    """Where a bucket's members lie; large buckets are split."""

    def __init__(self, parts: int, hot: dict[tuple[int, int], int]) -> None:
        self.parts = parts
        self.hot_keys = np.sort(np.array([self.key(np.array([t]), np.array([b]))[0] for t, b in hot], np.uint64))
        self.salts = np.array([hot[x] for x in sorted(hot, key=lambda x: self.key(np.array([x[0]]), np.array([x[1]]))[0])], np.int64)

    @staticmethod
    def key(table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return mix64(bucket, table)

    def split(self, key: np.ndarray) -> np.ndarray:
        """Into how many parts a bucket is split."""
        if not len(self.salts):
            return np.ones(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.hot_keys, key), len(self.salts) - 1)
        return np.where(self.hot_keys[at] == key, self.salts[at], 1)

    def part(self, key: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return ((mix64(key, 7) + salt.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return matrix(column.to_pylist(), dims)


def _hashed(hashes: Hashes):
    """Vectors with their bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = hashes.buckets(hashes.lifted(_vectors(batch.column(1), hashes.dims), False))
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * hashes.tables), pa.array(b.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), each], names=["vec_id", "vec", "buckets"])

    return run


def _grouped(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    for s, e in zip(cut, [*cut[1:], len(order)], strict=False):
        yield int(part[order[s]]), order[s:e]


def _table_rows(hashes: Hashes, parts: Parts):
    """One packed row a part: tables, buckets, ids, vectors of the entries of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _vectors(batch.column(1), hashes.dims), batch.column(0).to_numpy()
            b = batch.column(2).flatten().to_numpy()
            table = np.tile(np.arange(hashes.tables), len(x))
            key = parts.key(table, b)
            row = np.repeat(np.arange(len(x)), hashes.tables)
            # by place too, so that a row repeated any number of times is spread
            salt = mix64(ids[row], 3) + row.astype(np.uint64)
            part = parts.part(key, (salt % parts.split(key).astype(np.uint64)).astype(np.int64))
            small = x.astype(np.float32)
            x = small if (small == x).all() else x
            out = [(p, pack(table[at], b[at], ids[row[at]], x[row[at]])) for p, at in _grouped(part)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], names=["part", "payload"])

    return run


def _probe_rows(hashes: Hashes, parts: Parts, blocks: int):
    """One packed row a part and block: tables and buckets probed, by which query, and the queries' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, PROBED // (hashes.tables * hashes.probes))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                x, ids = _vectors(batch.column(1), hashes.dims), batch.column(0).to_numpy()
                b = hashes.probed(hashes.lifted(x, True))
                table = np.broadcast_to(np.arange(hashes.tables)[None, :, None], b.shape).ravel()
                row = np.repeat(np.arange(len(x)), b.shape[1] * b.shape[2])
                real = b.ravel() >= 0
                table, bucket, row = table[real], b.ravel()[real], row[real]
                key = parts.key(table, bucket)
                n = parts.split(key)
                key, table, bucket, row = (np.repeat(c, n) for c in (key, table, bucket, row))
                salt = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
                out = []
                block = mix64(ids, 11) % np.uint64(blocks)
                for p, at in _grouped(parts.part(key, salt) * blocks + block.astype(np.int64)[row]):
                    own, of = np.unique(row[at], return_inverse=True)
                    out.append((p // blocks, p % blocks, pack(table[at], bucket[at], of, ids[own], x[own])))
                kinds = [pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["part", "block", "payload"])

    return run


def best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller id; a pair counts once."""
    order = np.lexsort((vec, -score, query))
    q, v = query[order], vec[order]
    order = order[np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])])[: len(order)]]
    q = query[order]
    cut = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])[: len(q)])
    rank = np.arange(len(q)) - np.repeat(cut, np.diff(np.append(cut, len(q))))
    return order[rank < k]


def _scored(k: int):
    def run(_key, table: pa.Table, probes: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not table.num_rows or not probes.num_rows:
            return schema.empty_table()
        entries = [unpack(v) for v in table.column("payload").to_pylist()]
        key = np.concatenate([Parts.key(e[0], e[1]) for e in entries])
        ids, x = (np.concatenate([e[i] for e in entries]) for i in (2, 3))
        order = np.argsort(key, kind="stable")
        key, ids, x = key[order], ids[order].astype(np.int64), x[order].astype(float)
        out: list[list[np.ndarray]] = []
        for value in probes.column("payload").to_pylist():
            table_of, bucket, of, query_ids, queries = unpack(value)
            asked, of, query_ids = Parts.key(table_of, bucket), of.astype(np.int64), query_ids.astype(np.int64)
            lo, hi = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
            n = hi - lo
            hit = np.flatnonzero(n)
            # probes in runs of bounded pairs; one large bucket may make a run of its own
            run_of = np.cumsum(n[hit]) // PAIRS
            for r in np.unique(run_of):
                p = hit[run_of == r]
                q = np.repeat(of[p], n[p])
                at = np.arange(len(q)) - np.repeat(np.cumsum(n[p]) - n[p], n[p]) + np.repeat(lo[p], n[p])
                other = query_ids[q] != ids[at]
                q, at = q[other], at[other]
                score = np.einsum("ij,ij->i", queries[q], x[at])
                top = best(q, score, ids[at], k)
                out.append([query_ids[q[top]], ids[at[top]], score[top]])
        if not out:
            return schema.empty_table()
        q, v, s = (np.concatenate([o[i] for o in out]) for i in range(3))
        top = best(q, s, v, k)
        return pa.table([q[top], v[top], s[top]], schema=schema)

    return run


def shape(n: int, dims: int, k: int = K, probe: float = PROBE) -> tuple[int, int]:
    """Rotations in a bucket and probes a table for n vectors."""
    axes = 2 * (1 << max(1, math.ceil(math.log2(dims))))
    full = math.log(max(n, 2), axes)  # rotations that make a bucket of one vector
    hashes = max(1, math.floor(full + 0.2))
    share = probe / FALL ** (hashes - 1)
    if hashes > 1:
        share *= axes ** (RISE * max(0.0, hashes + 0.235 - full))
    return hashes, min(axes**hashes, math.ceil(axes**hashes * max(share, SHARE * k / n)))


def nearest(rows: DataFrame, k: int = K, tables: int = TABLES, probe: float = PROBE, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: each stated query's k nearest found."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "crosspolytope")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    data = scratch.keep(valid(rows).where(F.exists("vec", lambda x: x != 0)), "vectors")
    n, dims, largest, smallest = data.agg(F.count("*"), F.max(F.size("vec")), F.sqrt(F.max(norm)), F.sqrt(F.min(norm))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    uneven = largest - smallest > 1e-3 * largest
    hashes, each = shape(n, dims + uneven, k, probe)
    h = Hashes(dims, tables, hashes, each, seed, 1.0 * largest if uneven else 0.0)
    parts = max(1, -(-n * tables // PART_ROWS))
    large = max(1, min(PART_ROWS, n * tables // parts) // 8, n * tables // HOT)
    hashed = scratch.keep(data.mapInArrow(_hashed(h), "vec_id long, vec array<double>, buckets array<long>"), "buckets")
    counts = hashed.select(F.posexplode("buckets").alias("table", "bucket")).groupBy("table", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > large)
    # each holds more than 1/HOT of all entries, so there are fewer than HOT
    hot = {(r.table, r.bucket): min(parts, -(-r.n // large)) for r in counts.collect()}
    where = Parts(parts, hot)
    asked = queries_of(data)
    blocks = max(1, -(-asked.count() // BLOCK))
    members = hashed.mapInArrow(_table_rows(h, where), "part int, payload binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # few bytes but much work: small partitions, which Spark must not join
    probes = asked.repartition(max(1, -(-n // (QUERY_STEP * QUERIES))), "vec_id").mapInArrow(_probe_rows(h, where, blocks), "part int, block int, payload binary")
    found = members.groupBy("part", "block").cogroup(probes.groupBy("part", "block")).applyInArrow(_scored(k), FOUND)
    # a pair met in several tables is one
    return merged(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
