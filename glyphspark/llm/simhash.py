"""SimHash near-dedup by multi-index hashing.

Fingerprint. Words are `[^\\x20\\x09-\\x0D]+` of the whole text, A-Z lower-cased; shingles are runs
of `shingle` words, repeats included (fewer words: the whole sequence). A bit is 1 if set in over
half of the shingles' XXH64 values. Longer fingerprints go on with mixes of the same values.

Search. A fingerprint is cut into segments. Each segment has a table by its value; every fingerprint
enumerates the Hamming ball of `size` bits around its own value in each table, and complete
distances are verified on each match. Two fingerprints that differ in at most `radius` bits differ
in at most floor(radius / segments) bits in one segment, so with that size none is missed. Of two
values that differ, the lowest bit of the difference is 0 in exactly one, so half of the ball,
probed from that side, is enough to meet every neighbour.

near_duplicates() is complete: 3-word shingles, 64 bits, radius 3, two segments, balls of one bit.

similar_groups() joins texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.
The same fingerprints and links come first, each link checked by the sets themselves; what these
leave apart goes through a search that is complete at that similarity (jaccard.py).

Links, not pairs, leave a bucket: within one table entry the verified links join members by
union-find, and only a spanning forest is emitted, so a group of n near copies gives n - 1 links.
Where two members are joined already, no further link between them is looked for; groups are the
same. Components of the links come from alternating large-star and small-star steps; nothing about
fingerprints, links or components reaches the driver but counts.

Scale. Exact copies share a fingerprint and take part once. Tables are dealt by (segment, value). An
entry of more than MEMBERS fingerprints is split: each task has a share of its members, past which all
others stream.

Edge cases: null, empty and white-space texts have fingerprint zero and are linked like any other;
repeated doc_ids are rows of their own in the output and one document in near_duplicates' components
(similar_groups goes by text); a null doc_id gets its fingerprint's component, and never names one unless alone (then null); an empty table gives
no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64

SEED = 42
SHINGLE = 3
RADIUS = 3
WIDTH, SIZE = 32, 1
#: Members of one table entry compared at a time, in one task, and probes that a task holds; and large entries at most.
BUCKET, MEMBERS, PROBES, ENTRIES = 2_048, 4_096, 65_536, 65_536
#: Shingles whose bits are added up at a time.
CHUNK = 65_536

# similar_groups: shingles and similarity.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8


def _hashes(words: list[bytes], flat: bytes, ends: list[int], shingle: int) -> np.ndarray:
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    of = xxhash.xxh64_intdigest
    starts = [0, *ends]
    n = len(words) - shingle + 1
    return np.fromiter((of(flat[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, n)


def fingerprints_of(text: bytes | None, kinds: tuple[tuple[int, int], ...] = ((SHINGLE, 1),)) -> list[np.ndarray]:
    """For each (shingle, words) a fingerprint of so many 64-bit words."""
    words = text.lower().split() if text else []
    if not words:
        return [np.zeros(w, np.uint64) for _, w in kinds]
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
    out = []
    for shingle, width in kinds:
        hashes = _hashes(words, flat, ends, shingle)
        prints = np.zeros(width, np.uint64)
        for w in range(width):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(hashes), CHUNK):
                h = hashes[at : at + CHUNK] if not w else mix64(hashes[at : at + CHUNK], w)
                ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            prints[w] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
        out.append(prints)
    return out


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text, unsigned."""
    return int(fingerprints_of(text, ((shingle, 1),))[0][0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns to keep for each row of docs; with these also size, its words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *keep)
    names = ["doc_id", "fp", *keep, *(["size"] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            sizes = [pa.array([len(t.split()) if t else 0 for t in texts], pa.int64())] if keep else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:], *sizes], names=names)

    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"doc_id long, fp long{kinds}{', size long' if keep else ''}")


def ball(width: int, size: int) -> np.ndarray:
    """XOR masks of a segment's Hamming ball, from the centre outwards."""
    return np.array([sum(1 << b for b in bits) for n in range(size + 1) for bits in combinations(range(width), n)], np.uint64)


def _segments(words: np.ndarray, width: int, count: int) -> np.ndarray:
    """Values of the first `count` segments of `width` bits of fingerprints (n, words of 64 bits)."""
    bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1)
    padded = np.zeros((len(words), count, 64), np.uint8)
    padded[:, :, 64 - width :] = bits[:, : width * count].reshape(len(words), count, width)
    return np.packbits(padded, axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def _salts(hot: tuple[np.ndarray, ...], segment: int, keys: np.ndarray) -> np.ndarray:
    """Into how many parts each entry of a segment is split."""
    values, salts = hot[segment]
    if not len(values):
        return np.ones(len(keys), np.int64)
    at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
    return np.where(values[at] == keys, salts[at], 1)


def _tables(width: int, count: int, size: int, hot: list[tuple[np.ndarray, np.ndarray]]):
    """Rows (id, index, verify): an entry in each table, and probes around it.

    A large entry's members are dealt to salts; a member also probes the salts after its own, a probe all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = ball(width, size)
        low = masks & (~masks + np.uint64(1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                words = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u8").reshape(part.num_rows, -1)
                values = _segments(words, width, count)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for s in range(count):
                    # the lowest bit of the difference is 0 in the prober: each pair meets once
                    row, m = np.nonzero((values[:, s, None] & low[None, :]) == 0)
                    keys, probe = values[row, s] ^ masks[m], m > 0
                    n = _salts(hot, s, keys)
                    first = np.where(probe, 0, (mix64(ids[row], 5) % n.astype(np.uint64)).astype(np.int64))
                    each = n - first
                    row, keys, first, probe = (np.repeat(c, each) for c in (row, keys, first, probe))
                    step = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), s, np.int32)), pa.array(keys.view(np.int64)), pa.array((first + step).astype(np.int32)), pa.array(probe | (step > 0)), part.column(0).take(take), part.column(2).take(take)], names=["segment", "value", "salt", "probe", "id", "fp"])

    return run


def forest(prints: np.ndarray, probe: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of one table entry: members against members, and probers against members.

    prints: (n, words of 64 bits). Work is the product of rows and members, a block at a time, in
    NumPy; the loop goes over rows that have a near member, and over links.
    """
    members, group, out = np.flatnonzero(~probe), np.arange(len(prints)), []
    for a in range(0, len(prints), BUCKET):
        rows = np.arange(a, min(a + BUCKET, len(prints)))
        for b in range(0, len(members), BUCKET):
            cols = members[b : b + BUCKET]
            near = sum(np.bitwise_count(prints[rows, None, w] ^ prints[None, cols, w]).astype(np.int16) for w in range(prints.shape[1])) <= radius
            # a member meets each other member once
            near &= probe[rows, None] | (cols[None, :] > rows[:, None])
            for i in np.flatnonzero(near.any(1)):
                row, met = rows[i], cols[near[i]]
                met = met[group[met] != group[row]]
                while len(met):
                    out.append((int(row), int(met[0])))
                    x, y = group[row], group[met[0]]
                    group[group == max(x, y)] = min(x, y)
                    met = met[group[met] != group[row]]
    return out


def _links(radius: int, rows: int):
    """Verified links of each table entry; rows come sorted by (segment, value, salt, probe), and of one entry's probes about `rows` are held at a time."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.frombuffer(b"".join(batch.column(5).to_pylist()), ">u8").reshape(batch.num_rows, -1).astype(np.uint64)
            held.append((*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)), words))
            whole = [np.concatenate([h[i] for h in held]) for i in range(6)]
            seg, val, salt, probe, ids, words = whole
            cut = np.flatnonzero((np.diff(seg) != 0) | (np.diff(val) != 0) | (np.diff(salt) != 0)) + 1
            last = cut[-1] if len(cut) else 0
            if last:
                yield cut[:-1], probe[:last], ids[:last], words[:last]
                whole = [c[last:] for c in whole]
            if len(whole[0]) > rows and whole[3][-1]:  # members stay for the probes to come
                yield np.zeros(0, np.int64), *whole[3:]
                whole = [c[~whole[3]] for c in whole]
            held = [tuple(whole)]
        if held:
            yield np.zeros(0, np.int64), *held[0][3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, probe, ids, words in groups(batches):
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(ids)]])
            # an entry needs a member and another row
            useful = (ends - starts > 1) & (np.add.reduceat(~probe, starts) > 0)
            a, b = [], []
            for s, e in zip(starts[useful], ends[useful], strict=True):
                for i, j in forest(words[s:e], probe[s:e], radius):
                    a.append(min(ids[s + i], ids[s + j]))
                    b.append(max(ids[s + i], ids[s + j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _values(width: int, count: int):
    """Rows (segment, value) of fingerprints' own entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").reshape(batch.num_rows, -1)
            values = _segments(words, width, count)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(count, dtype=np.int32), len(values))), pa.array(values.ravel().view(np.int64))], names=["segment", "value"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, width: int = WIDTH, count: int = 64 // WIDTH, size: int = SIZE, bucket: int = MEMBERS) -> DataFrame:
    """Links a < b of ids over distinct prints(id, index, verify: fingerprints' bytes).

    Their closure is that of all pairs within radius that share an entry: all pairs within radius
    if these are one fingerprint and radius < count * (size + 1).
    """
    named = prints.select("id", "index", "verify")
    # entries of more than `bucket` members, and of more than a share of all, so that the driver hears of fewer than ENTRIES of them
    limit = max(bucket, named.count() * count // ENTRIES)
    large = named.select("index").mapInArrow(_values(width, count), "segment int, value long").groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()
    hot = []
    for s in range(count):
        own = sorted((r.value % 2**64, -(-r.n // limit)) for r in large if r.segment == s)
        hot.append((np.array([v for v, _ in own], np.uint64), np.array([n for _, n in own], np.int64)))
    rows = named.mapInArrow(_tables(width, count, size, hot), "segment int, value long, salt int, probe boolean, id long, fp binary")
    dealt = rows.repartition("segment", "value", "salt").sortWithinPartitions("segment", "value", "salt", "probe")
    return dealt.mapInArrow(_links(radius, PROBES), "a long, b long").where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges(a, b) are stars: no node has two of lower number, or one of lower and one of higher."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select("b", F.lit(0), F.lit(1)).toDF("node", "up", "down"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str = "edges", max_rounds: int = 60) -> DataFrame:
    """node and root, the smallest node reachable, for the nodes of edges(a, b) but the roots.

    Alternating large-star and small-star until the edges are stars. Each round is written to the
    shared folder, under name and its number. A node with many neighbours is only ever reduced to their least, which tasks
    do partly before the shuffle; the join back is one that Spark may split by skew. Rounds grow with
    the logarithm of the longest chain; more than max_rounds raise an error.
    """
    current = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}0")
    for i in range(1, max_rounds + 1):
        if _settled(current):
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # large star: every larger neighbour of a node links to the node's least neighbour or itself
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour and the node itself link to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        current = scratch.keep(small, f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _bytes(fp: str = "fp"):
    return F.unhex(F.lpad(F.hex(fp), 16, "0"))


def _with_roots(roots: DataFrame) -> DataFrame:
    """Components' rows and one for each root itself."""
    return roots.unionByName(roots.select("root").distinct().select(F.col("root").alias("node"), "root"))


def print_links(one: DataFrame, radius: int = RADIUS, width: int = WIDTH, size: int = SIZE) -> DataFrame:
    """Links a < b of distinct fingerprints one(fp, ...), whose closure is that of all within radius."""
    return links(one.select(F.col("fp").alias("id"), _bytes().alias("index"), _bytes().alias("verify")), radius, width, 64 // width, size)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, width: int = WIDTH, size: int = SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (64 bits as a signed long), the columns to keep, with size (words) beside them, and component_id for each row of docs(doc_id, text).

    component_id is the smallest doc_id of the documents linked to it, directly or through others.
    """
    if radius >= 64 // width * (size + 1):
        raise ValueError("these segments and balls could miss pairs within radius")
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, shingle, keep), "fingerprints")
    # one row a fingerprint, copies folded before the shuffle
    one = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = scratch.keep(print_links(one, radius, width, size), "links")
    roots = components(found, scratch)
    members = one.join(_with_roots(roots), F.col("fp") == F.col("node")).select("fp", "first", "root")
    # written, so that the join of a large group can be split
    named = scratch.keep(members.groupBy("root").agg(F.min("first").alias("least")), "named")
    grouped = members.join(named, "root").select(F.col("fp").alias("member"), "least")
    placed = one.join(grouped, one["fp"] == grouped["member"], "left").select(F.col("fp").alias("f"), F.when(F.col("member").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    by_print = scratch.keep(placed, "components")
    return prints.join(by_print, prints["fp"] == by_print["f"]).select(*prints.columns, "component_id")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """id, first (smallest doc_id), component_id and kept for each distinct text of docs(doc_id, text).

    A text is its words (jaccard.node). Groups join texts whose 5-word shingle sets are similar to
    `similarity` or more. Of each group one text is kept: the one with component_id, the group's
    smallest doc_id (of several, and of those without any, the one with the smallest id).
    """
    from .jaccard import similar_nodes

    scratch = Scratch(docs.sparkSession, "similar")
    nodes, roots = similar_nodes(docs, scratch, SIMILAR_SHINGLE, similarity)
    members = nodes.join(_with_roots(roots), F.col("id") == F.col("node")).select("id", "first", "root")
    order = F.struct(F.col("first").isNull(), "first", "id")
    # written, so that the join of a large group can be split
    named = scratch.keep(members.groupBy("root").agg(F.min(order).alias("least")), "named")
    grouped = members.join(named, "root").select(F.col("id").alias("member"), "least")
    alone = F.col("member").isNull()
    return nodes.join(grouped, F.col("id") == F.col("member"), "left").select("id", "first", F.when(alone, F.col("first")).otherwise(F.col("least.first")).alias("component_id"), (alone | (F.col("id") == F.col("least.id"))).alias("kept"))
