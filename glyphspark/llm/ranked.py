"""Ranked lexical search: MaxScore per shard of an inverted index.

Terms are the runs of ASCII letters and digits and of all other than ASCII characters, A-Z lower-cased. With N
documents that hold a term, L terms in all and df documents holding a term, the term weighs
w = floor(1000 * ln((2N + 2) / (2df + 1))). A document of n terms that holds it tf times scores
w * ((1000000000 * tf) div (1000 * tf + 8 * m)) with m = 25 + (75 * n * N) div L; an item's score of a document
is the sum over the item's terms, repeats included.

Method. Documents are read once and indexed in shards: for each term of the items its documents, by number, and how
often they hold it. A second pass over the shards, which knows N, L and df, gives each list its upper bound, the
largest score in it. For an item the lists are taken by falling bound. While the bounds of what is left could
reach the k-th score found so far, a list is essential: a document may be found through it. The lists left then are
non-essential; they are only probed for documents found, highest bound first, and a document is left out once its score
and the bounds still to probe can't reach the k-th score. Lower bounds of scores of the shard at hand
raise the k-th score too, and a task keeps it from shard to shard.

Scale. Documents meet no others: a shard has at most DOCS documents and about POSTINGS postings, a task holds one and K
rows an item. Each task gives K rows an item at most, ranked by parts of the tasks first. Items are read in blocks of
BLOCK bytes of text at least, whose terms are sent to all tasks; further blocks are further passes over the documents. df
comes back for a block's terms only.

Edge cases: null, empty and term-less texts are no documents and, as items, find nothing; a row repeated is a
document of its own, and ranks so; a null doc_id comes after all others of its score; items alike in item_id and text are one,
other texts of one item_id are items of their own; fewer than K documents may score above 0; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pack, unpack

K = 10
#: Documents and postings of a shard, and bytes of the items of one pass, from which the next begins.
DOCS, POSTINGS, BLOCK = 4_096, 1 << 20, 16 << 20
#: Parts by which the rows of an item are ranked first.
PARTS = 32
#: Texts whose terms are counted at a time.
TEXTS = 256

#: Every byte as it stands in a term, or as a space.
_BYTES = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())

_SHARD = "docs long, terms long, ids array<int>, df array<int>, postings binary"


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text, in order."""
    return text.translate(_BYTES).split() if text else []


class Index:
    """Postings of some documents, by term."""

    def __init__(self, doc_ids: np.ndarray, lost: np.ndarray, sizes: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> None:
        order = np.lexsort((doc, term))
        self.doc_ids, self.lost, self.sizes = doc_ids, lost, sizes
        self.doc, self.tf = doc[order], tf[order]
        self.ids, begin = np.unique(term[order], return_index=True)
        self.upto = np.append(begin, len(order))

    def packed(self) -> bytes:
        return pack(self.doc_ids, self.lost.astype(np.uint8), self.sizes, self.ids, np.diff(self.upto), self.doc, self.tf)

    @classmethod
    def unpacked(cls, value: bytes) -> Index:
        self = cls.__new__(cls)
        self.doc_ids, lost, self.sizes, self.ids, df, self.doc, self.tf = (a if a.dtype.kind == "f" else a.astype(np.int64) for a in unpack(value))
        self.lost, self.upto = lost.astype(bool), np.append(0, np.cumsum(df))
        return self

    def score(self, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        """Give each posting its score, and each list its bound."""
        m = 25 + 75 * self.sizes * n_docs // n_terms
        self.scores = np.repeat(weights[self.ids], np.diff(self.upto)) * (1_000_000_000 * self.tf // (1_000 * self.tf + 8 * m[self.doc]))
        self.bounds = np.maximum.reduceat(self.scores, self.upto[:-1])

    def lists(self, term: np.ndarray, times: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Bound, documents and scores of each of an item's terms that is here, by falling bound."""
        at = np.searchsorted(self.ids, term)
        here = at < len(self.ids)
        here[here] = self.ids[at[here]] == term[here]
        found = [(int(self.bounds[i]) * n, slice(self.upto[i], self.upto[i + 1]), n) for i, n in zip(at[here].tolist(), times[here].tolist(), strict=True)]
        return [(bound, self.doc[part], self.scores[part] * n) for bound, part, n in sorted(found, key=lambda x: -x[0]) if bound]


def max_score(lists: list[tuple[int, np.ndarray, np.ndarray]], docs: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among an item's k best, with their scores, and how many postings were met.

    lists: bound, documents (rising) and scores of each term, by falling bound. least: the k-th score so far, or 1; every
    document of that score or more that isn't below the k-th here is found.
    """
    rest = np.append(np.cumsum([x[0] for x in lists][::-1], dtype=np.int64)[::-1], 0).tolist()
    found, met = np.zeros(docs, np.int64), 0
    i = 0
    while i < len(lists) and rest[i] >= least:  # essential: a document of these lists alone can qualify
        _, doc, score = lists[i]
        found[doc] += score
        met += len(doc)
        i += 1
        if docs >= k and found.max() > rest[i]:
            least = max(least, int(np.partition(found, docs - k)[docs - k]))
    can = np.flatnonzero(found >= max(1, least - rest[i])) if i else np.zeros(0, np.int64)
    for j in range(i, len(lists)):
        if not len(can):
            break
        _, doc, score = lists[j]
        at = np.minimum(np.searchsorted(doc, can), len(doc) - 1)
        has = doc[at] == can
        met += int(has.sum())
        found[can[has]] += score[at[has]]
        if len(can) > k:
            least = max(least, int(np.partition(found[can], len(can) - k)[len(can) - k]))
        can = can[found[can] + rest[j + 1] >= least]
    return can, found[can], met


def _best(doc_ids: np.ndarray, lost: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((doc_ids, lost, -scores))[:k]
    return doc_ids[order], lost[order], scores[order]


def _indexed(sent):
    """Rows of _SHARD over the terms that sent numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        known = number.keys()
        ids: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        n_docs = n_terms = n_postings = 0

        def shard() -> pa.RecordBatch:
            rows = np.concatenate(held) if held else np.zeros((0, 3), np.int64)
            index = Index(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], bool), np.array(sizes, np.int64), rows[:, 0], rows[:, 1], rows[:, 2])
            one = [[n_docs], [n_terms], [index.ids.tolist()], [np.diff(index.upto).tolist()], [index.packed()]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(one, kinds, strict=True)], names=["docs", "terms", "ids", "df", "postings"])

        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(text)
                if not words:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                times = Counter(words)
                shared = known & times.keys()
                if shared:
                    held.append(np.array([(number[w], len(ids), times[w]) for w in shared], np.int64))
                    ids.append(doc_id)
                    sizes.append(len(words))
                    n_postings += len(shared)
                if len(ids) >= DOCS or n_postings >= POSTINGS:
                    yield shard()
                    ids, sizes, held, n_docs, n_terms, n_postings = [], [], [], 0, 0, 0
        if n_docs:
            yield shard()

    return run


def _ranked(sent, k: int):
    """Rows (place, doc_id, score): each item's k best of the shards of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, n_docs, n_terms, items = sent.value
        none = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        best = [none] * len(items)
        for batch in batches:
            for value in batch.column(0):
                index = Index.unpacked(value.as_py())
                if not len(index.ids):
                    continue
                index.score(weights, n_docs, n_terms)
                for i, (term, times) in enumerate(items):
                    had = best[i]
                    doc, score, _ = max_score(index.lists(term, times), len(index.sizes), k, int(had[2][-1]) if len(had[2]) == k else 1)
                    if len(doc):
                        best[i] = _best(*(np.concatenate(c) for c in zip(had, (index.doc_ids[doc], index.lost[doc], score), strict=True)), k)
        for i, (doc_ids, lost, scores) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), i, np.int64)), pa.array(doc_ids, pa.int64(), mask=lost), pa.array(scores)], names=["place", "doc_id", "score"])

    return run


def _top(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items with their terms, in blocks; a partition of items at a time comes to the driver."""
    block, size = [], 0
    for item_id, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).distinct().toLocalIterator():
        block.append((item_id, Counter(terms(bytes(text or b"")))))
        size += len(text or b"")
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(docs: DataFrame, block: list[tuple[int | None, Counter]], k: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    number = {w: i for i, w in enumerate(sorted(set().union(*(times for _, times in block))))}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    shards = scratch.keep(texts.mapInArrow(_indexed(spark.sparkContext.broadcast(number)), _SHARD), "shards")
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    weights = np.zeros(len(number), np.int64)
    for r in shards.select(F.explode(F.arrays_zip("ids", "df")).alias("x")).groupBy("x.ids").agg(F.sum("x.df").alias("df")).collect():
        weights[r.ids] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    sought = [(np.array([number[w] for w in times], np.int64), np.array(list(times.values()), np.int64)) for _, times in block]
    found = shards.select("postings").mapInArrow(_ranked(spark.sparkContext.broadcast((weights, n_docs, n_terms, sought)), k), "place long, doc_id long, score long")
    parted = _top(found.withColumn("part", F.spark_partition_id() % PARTS), k, "place", "part").drop("rank")
    named = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "place long, item_id long")
    return _top(parted, k, "place").join(named, "place").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the k best rows of docs(doc_id, text) for each of items(item_id, text)."""
    found: Iterable[DataFrame] = [_search(docs, block, k) for block in _blocks(items)]
    none = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found) if found else none


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The same by scoring every document.
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
i AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, n_docs),
s AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM i JOIN p USING (term) JOIN w USING (term), g GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= {K}
"""
