"""All pairs of texts whose sets of word shingles have a Jaccard similarity of at least a given one, up to links.

Order. SimHash by multi-index hashing (simhash.py) comes first: texts of one fingerprint, and of
fingerprints linked at 3 or fewer differing bits, are pairs, decided by their whole sets. Only texts
that these leave apart are pairs of the search below, which finds the similar ones that fingerprints miss.

Sets. Words are those of simhash.py; a set holds 64-bit values of the text's runs of `shingle` words
(fewer words: the whole sequence), each once: the words' XXH64 values, mixed in order. Texts of the
same words are one node, whose id is the XXH64 value of these words. Values of 64 bits stand for
words, shingles and texts.

Search. Shingles have one order: rarer ones first, by a table of how many sets hold them (CELLS cells,
counted over all sets), then by value. Of two sets with similarity t, the first n - ceil(t n) + 1
shingles of each, in that order, have one in common (prefix filter); any order is right, the table
only keeps common lines out of the prefixes. Where sets first meet, at places i and j, they share at
most n - i and m - j shingles, so a pair meets in the entry of a shared shingle only if both reach
the overlap that t needs; and it is kept if the shingles that met and all that follow the last one
reach it too. All that are kept are decided by their whole sets, in whole numbers.

Storage. Sets are never stored: they take more room than the texts. Each step that needs them makes
them from the documents again, and only texts that are in pairs are moved, compressed.

Large groups. First each member of an entry meets the entry's centre only: the member with the fewest
rarer shingles, which of many copies of one text is the least changed. That joins most of a group of
near copies. Of entries whose members are then in several components, each member outside the commonest
one meets the members of other components. The links' components are those of all similar pairs, and
a group of n near copies of one text costs about n pairs. An entry is streamed or joined, never held.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import Scratch, mix64, trim
from .simhash import _with_roots, components, fingerprint, print_links

SEED = 42
#: Cells of the table of counts, as bits of a value; and those of a block, in which tables are added up.
CELLS, BLOCK = 22, 12
#: Sets handled at a time.
ROWS = 256
#: Ids, and words, that a task remembers at a time.
SEEN = 200_000


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _id(words: list[bytes]) -> int:
    h = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return h - 2**64 if h >> 63 else h


def node_of(text: bytes | None) -> int:
    """The text's words as a signed long; null, empty and white-space texts are alike."""
    return _id(_words(text))


@F.arrow_udf(LongType())
def node(texts: pa.Array) -> pa.Array:
    return pa.array([node_of(t) for t in texts.to_pylist()], pa.int64())


class Hasher(dict):
    """XXH64 of words; those of the last SEEN distinct words are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= SEEN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h

    def shingles(self, words: list[bytes], shingle: int) -> np.ndarray:
        """Values of the words' shingles, in order of value, each once; none without words."""
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        k = min(shingle, len(words))
        n = len(words) - k + 1
        value = np.full(n, k, np.uint64)
        for i in range(k):
            value = mix64(value, h[i : i + n])
        return np.unique(value)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    return Hasher().shingles(_words(text), shingle)


def prefix(n, t: Fraction):
    """Shingles of a set of n of which a similar set has one; n may be an array."""
    return n - -(-n * t.numerator // t.denominator) + 1


class _Cells:
    """Counts of the cells that values fall into."""

    def __init__(self) -> None:
        self.counts, self.held, self.n = np.zeros(1 << CELLS, np.uint32), [], 0

    def add(self, values: np.ndarray) -> None:
        self.held.append((values >> np.uint64(64 - CELLS)).astype(np.uint32))
        self.n += len(values)
        if self.n >= 1 << 18:
            self._sum()

    def _sum(self) -> None:
        if self.n:
            cells, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.counts[cells] += n.astype(np.uint32)
        self.held, self.n = [], 0

    def blocks(self) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the blocks that hold something, and these, packed."""
        self._sum()
        blocks = self.counts.reshape(-1, 1 << BLOCK)
        some = np.flatnonzero(blocks.any(1))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return some, [squeeze(np.ascontiguousarray(blocks[i].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()) for i in some]


def _read(shingle: int):
    """A row (id, doc_id, fp) for each text, fp once a task; and how many of a task's sets hold a shingle of each cell, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen, of = _Cells(), set(), Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, ids, prints = batch.slice(at, ROWS), [], []
                for text in part.column(1).to_pylist():
                    words = _words(text)
                    ids.append(_id(words))
                    prints.append(None)
                    if ids[-1] not in seen:  # copies in one task count once
                        seen.add(ids[-1])
                        cells.add(of.shingles(words, shingle))
                        prints[-1] = int(np.uint64(fingerprint(text)).astype(np.int64))
                if len(seen) > SEEN:
                    seen.clear()
                none = [None] * len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), part.column(0), pa.array(prints, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=["id", "doc_id", "fp", "block", "counts"])
        some, packed = cells.blocks()
        none = pa.array([None] * len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["id", "doc_id", "fp", "block", "counts"])
        trim()

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of ids."""
    cells = _Cells()
    for batch in batches:
        cells.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    some, packed = cells.blocks()
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    spread = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            planes = np.frombuffer(spread(counts), np.uint8).reshape(4, -1)
            cells = np.ascontiguousarray(planes.T).view("<u4").ravel()
            total[block] = total.get(block, 0) + cells.astype(np.int64)
    # eighths of a doubling
    levels = [np.minimum(8 * np.log2(1 + c), 255).astype(np.uint8).tobytes() for c in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], names=["block", "levels"])


def rarity(counts: DataFrame) -> np.ndarray:
    """A byte a cell of counts(block, counts), higher for more: a table of fixed size, whatever the input's."""
    table = np.zeros((1 << (CELLS - BLOCK), 1 << BLOCK), np.uint8)
    for row in counts.repartition("block").mapInArrow(_levels, "block int, levels binary").collect():
        table[row.block] = np.frombuffer(row.levels, np.uint8)
    return table.ravel()


def _entries(levels: np.ndarray, shingle: int, t: Fraction):
    """Rows (shingle, pos, id, n): the shingles of each set's prefix with their places, and the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, of = set(), Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                taken, sizes, ids = [], [], []
                for text in batch.column(0).slice(at, ROWS).to_pylist():
                    words = _words(text)
                    one = _id(words)
                    if not words or one in seen:
                        continue
                    seen.add(one)
                    held = of.shingles(words, shingle)
                    # values are in order, so a stable order by level is one by level and value
                    order = np.argsort(levels[held >> np.uint64(64 - CELLS)], kind="stable")
                    taken.append(held[order[: prefix(len(held), t)]])
                    sizes.append(len(held))
                    ids.append(one)
                if len(seen) > SEEN:
                    seen.clear()
                if ids:
                    row = np.repeat(np.arange(len(ids)), [len(x) for x in taken])
                    pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in taken])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(taken).view(np.int64)), pa.array(pos), pa.array(np.array(ids)[row]), pa.array(np.array(sizes, np.int32)[row])], names=["shingle", "pos", "id", "n"])
        trim()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of more than one set, each row with the entry's centre; rows come sorted by shingle, pos and id."""
    last = None  # the row before: shingle, pos, id, n, and its entry's centre: id, n, pos
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, pos, ids, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if last is not None:
            shingle, pos, ids, n = (np.concatenate([[x], c]) for x, c in zip(last, (shingle, pos, ids, n), strict=False))
        first = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
        centre = [ids[start], n[start], pos[start]]
        if last is not None:  # the entry that goes on keeps its centre
            centre = [np.where(start == 0, x, c) for x, c in zip(last[4:], centre, strict=True)]
        # a set that comes from several tasks is one
        again = np.concatenate([[False], ~first[1:] & (ids[1:] == ids[:-1])])
        met = ids != centre[0]
        out = met & ~again
        # the centre comes out before the first that meets it
        out[:-1] |= ~met[:-1] & met[1:] & ~first[1:]
        if last is not None and met[0]:
            out[0] = False  # it came out with its batch
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (shingle, pos, ids, n, *centre)], names=["shingle", "pos", "id", "n", "centre", "n_centre", "pos_centre"])
        last = (shingle[-1], pos[-1], ids[-1], n[-1], *(c[-1] for c in centre))


def _alike(shingle: int, t: Fraction):
    """Pairs (a, b) of texts that are similar; rows of one a are near each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, spread = Hasher(), zstandard.ZstdDecompressor().decompress
        known, own = None, None
        for batch in batches:
            found = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != known:
                    known, own = a, of.shingles(spread(x.as_buffer()).split(), shingle)
                both = np.concatenate([own, of.shingles(spread(y.as_buffer()).split(), shingle)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                found.append(common * t.denominator >= (len(both) - common) * t.numerator)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(found, pa.bool_())) for i in range(2)], names=["a", "b"])
        trim()

    return run


def _can(t: Fraction, na: str, pa_: str, nb: str, pb: str) -> str:
    """Whether sets that meet first at these places can be similar: overlap is at least t / (1 + t) of both sizes' sum."""
    num, den = t.numerator, t.denominator
    return f"least({na} - {pa_}, {nb} - {pb}) * {num + den} >= ({na} + {nb}) * {num}"


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs with a < b."""
    flip = F.col("a") > F.col("b")
    pick = lambda c, d: F.when(flip, F.col(d)).otherwise(F.col(c))
    return pairs.select(*[pick(c + x, c + y).alias(c + x) for c in ("", "n", "p") for x, y in ("ab", "ba")])


def _reach(pairs: DataFrame, t: Fraction) -> DataFrame:
    """Of pairs (a, b, na, nb, pa, pb), a row for each shingle they meet in, those once that could be similar."""
    counted = _ordered(pairs).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("la"), F.max("pb").alias("lb"))
    return counted.where(f"(c + least(na - la, nb - lb) - 1) * {t.numerator + t.denominator} >= (na + nb) * {t.numerator}").select("a", "b")


def _texts(marked: np.ndarray):
    """Rows (id, text) of the ids in marked cells, once a task; text is its words, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, squeeze = set(), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, texts = [], []
                for text in batch.column(0).slice(at, ROWS).to_pylist():
                    words = _words(text)
                    one = _id(words)
                    if marked[(one % 2**64) >> (64 - CELLS)] and one not in seen:
                        seen.add(one)
                        ids.append(one)
                        texts.append(squeeze(b" ".join(words)))
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["id", "text"])
        trim()

    return run


def _decide(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str, shingle: int, t: Fraction) -> DataFrame:
    """Those of pairs(a, b) whose sets are similar, written."""
    pairs = scratch.keep(pairs, f"{name}_pairs")
    # a table of marked cells, of fixed size, lets the texts of these ids (and few others) through
    marked = rarity(pairs.select(F.explode(F.array("a", "b")).alias("id")).mapInArrow(_marks, "block int, counts binary"))
    some = texts.mapInArrow(_texts(marked), "id long, text binary")
    # copies from several tasks are one; written, so that both joins below can be split where many pairs share a text
    held = scratch.keep(some.groupBy("id").agg(F.first("text").alias("text")), f"{name}_texts")
    one, two = (held.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    met = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    found = scratch.keep(met.mapInArrow(_alike(shingle, t), "a long, b long"), name)
    scratch.drop(f"{name}_pairs", f"{name}_texts")
    return found


def _rest(rooted: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b, na, nb, pa, pb) of rooted(shingle, pos, id, n, root) that meet and aren't joined."""
    by_root = rooted.groupBy("shingle", "root").agg(F.count("*").alias("c"))
    major = by_root.groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("shingle", F.col("m.root").alias("major"))
    mixed = rooted.join(major, "shingle").withColumn("out", F.col("root") != F.col("major"))
    side = lambda df, x, *more: df.select("shingle", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("root").alias(f"r{x}"), *more)
    # two members outside the commonest component meet once
    met = side(mixed.where("out"), "a").join(side(mixed, "b", "out"), "shingle")
    return met.where(f"ra <> rb and (not out or a < b) and {_can(t, 'na', 'pa', 'nb', 'pb')}").select("a", "b", "na", "nb", "pa", "pb")


def _by_print(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs a < b of nodes(id, fp): each text and its fingerprint's first one, and the first ones of linked fingerprints."""
    one = scratch.keep(nodes.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    found = scratch.keep(print_links(one), "print_links")
    own = lambda x: one.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}"))
    across = found.join(own("a"), "a").join(own("b"), "b").select("least_a", "least_b")
    within = nodes.join(one, "fp").where("id <> least").select("id", "least")
    return across.union(within).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that roots(node, root) don't join."""
    named = _with_roots(roots)
    own = lambda x: named.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    return pairs.join(own("a"), "a", "left").join(own("b"), "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")


def similar_nodes(docs: DataFrame, scratch: Scratch, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """nodes(id, first: smallest doc_id, fp: 64 bits as a signed long) of docs(doc_id, text), and roots(node, root) of those with similar ones."""
    t = Fraction(str(similarity))
    if not 0 < t <= 1:
        raise ValueError("similarity is over 0 and at most 1")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    read = scratch.keep(rows.mapInArrow(_read(shingle), "id long, doc_id long, fp long, block int, counts binary"), "read")
    nodes = scratch.keep(read.where("block is null").groupBy("id").agg(F.min("doc_id").alias("first"), F.max("fp").alias("fp")), "nodes")
    levels = rarity(read.where("block is not null").select("block", "counts"))
    texts = rows.select("text")
    scratch.drop("read")

    near = components(_decide(_by_print(nodes, scratch), texts, scratch, "near", shingle, t), scratch, "alike")

    dealt = texts.mapInArrow(_entries(levels, shingle, t), "shingle long, pos int, id long, n int").repartition("shingle").sortWithinPartitions("shingle", "pos", "id")
    shared = scratch.keep(dealt.mapInArrow(_shared, "shingle long, pos int, id long, n int, centre long, n_centre int, pos_centre int"), "shared")
    star = shared.where("id <> centre").where(_can(t, "n", "pos", "n_centre", "pos_centre"))
    pairs = star.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    first = _decide(_apart(pairs, near), texts, scratch, "first", shingle, t)
    roots = components(near.toDF("a", "b").unionByName(first), scratch, "joined")
    rooted = shared.join(_with_roots(roots), F.col("id") == F.col("node"), "left").select("shingle", "pos", "n", "id", F.coalesce("root", "id").alias("root"))
    rest = _decide(_reach(_rest(scratch.keep(rooted, "rooted"), t), t), texts, scratch, "rest", shingle, t)
    if rest.isEmpty():
        return nodes, roots
    found = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest)
    return nodes, components(found, scratch, "roots")
