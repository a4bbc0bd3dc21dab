"""Best-fit packing of token sequences under conflicts.

Documents go, longest first, each to the fullest bin that still has room and no conflict with it:
a bin carries a bitmap of its sources and one of its duplicate clusters, and admits neither a
second piece of a source (where one_per_source is set) nor a second member of a cluster. Bins are
held in order of residual; the successor search starts at the first residual that is large enough
and goes on, block by block, until a bin's bitmaps admit the document. That bin is the tightest
compatible one. If there is none, a new bin opens.

A document longer than the capacity is cut: whole bins of its own, and the rest is packed like a
short document, under the same conflicts. Nothing is dropped or truncated.

Scale. Rows alike in doc_id, source, size and cluster are counted, then numbered and dealt to shards by
a hash of all of these, so that a hot source or a large group of copies spreads evenly and the bins
don't depend on how the input is partitioned. About SHARD_ROWS rows share a task, and a shard's bins
are its own, so no conflict crosses shards. Only lengths, ids and hashes are moved, never texts.

Edge cases: a null or empty text has length 0 and takes no place in a bin: its piece has bin_id
null; a null source or cluster conflicts with nothing; a null doc_id stays null; repeated rows are
packed one by one and are copies of each other; ties in length go by a hash of doc_id, then by the
row's other values; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from .common import mix64
from .mixing import words
from .simhash import near_duplicates

CAPACITY = 2048
SHARD_ROWS = 8_000
#: Bins that a successor search looks at in one step, doubling.
STEP = 64
PLACED = "doc_id long, source string, size long, cluster string, piece int, begin long, length long, bin_id string, place long, fill long"


class Bins:
    """Open bins in order of residual, with bitmaps of what each holds."""

    def __init__(self, capacity: int, sources: int, clusters: int) -> None:
        self.capacity = capacity
        self.residual = np.zeros(0, np.int64)  # sorted
        self.bin = np.zeros(0, np.int64)
        self.source = np.zeros((64, -(-max(sources, 1) // 64)), np.uint64)
        self.cluster = np.zeros((64, -(-max(clusters, 1) // 64)), np.uint64)
        self.opened = 0

    def successor(self, length: int, source: int, cluster: int) -> int:
        """Index, in order of residual, of the tightest compatible bin; -1 if there is none."""
        at, step = int(np.searchsorted(self.residual, length, "left")), STEP
        while at < len(self.bin):
            own = self.bin[at : at + step]
            free = np.ones(len(own), bool)
            if source >= 0:
                free &= self.source[own, source >> 6] >> np.uint64(source & 63) & np.uint64(1) == 0
            if cluster >= 0:
                free &= self.cluster[own, cluster >> 6] >> np.uint64(cluster & 63) & np.uint64(1) == 0
            if free.any():
                return at + int(free.argmax())
            at += step
            step *= 2
        return -1

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and place in it of the next piece."""
        at = self.successor(length, source, cluster)
        if at < 0:
            own, left = self.opened, self.capacity
            self.opened += 1
            if own == len(self.source):
                self.source = np.concatenate([self.source, np.zeros_like(self.source)])
                self.cluster = np.concatenate([self.cluster, np.zeros_like(self.cluster)])
        else:
            own, left = int(self.bin[at]), int(self.residual[at])
            self.residual, self.bin = np.delete(self.residual, at), np.delete(self.bin, at)
        if source >= 0:
            self.source[own, source >> 6] |= np.uint64(1 << (source & 63))
        if cluster >= 0:
            self.cluster[own, cluster >> 6] |= np.uint64(1 << (cluster & 63))
        if left > length:  # a full bin admits nothing more
            to = int(np.searchsorted(self.residual, left - length, "left"))
            self.residual, self.bin = np.insert(self.residual, to, left - length), np.insert(self.bin, to, own)
        return own, self.capacity - left


def _codes(values: pa.Array, repeated_only: bool = False) -> tuple[np.ndarray, int]:
    """Small numbers for a shard's values; -1 for null, and for values that meet no equal one if so asked."""
    found = values.dictionary_encode()
    codes, kinds = found.indices.fill_null(-1).to_numpy(zero_copy_only=False), len(found.dictionary)
    if repeated_only:
        n = np.bincount(codes[codes >= 0], minlength=kinds)
        new = np.append(np.where(n > 1, np.cumsum(n > 1) - 1, -1), -1)  # the last one stands for null
        return new[codes], int((n > 1).sum())
    return codes, kinds


SCHEMA = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("cluster", pa.string()), ("piece", pa.int32()), ("begin", pa.int64()), ("length", pa.int64()), ("bin_id", pa.string()), ("place", pa.int64()), ("fill", pa.int64())])


def pack_shard(shard: pa.Table, capacity: int = CAPACITY, one_per_source: bool = True) -> pa.Table:
    """Place every piece of one shard's documents (doc_id, source, size, cluster, shard)."""
    name = shard.column("shard")[0].as_py()
    ids = shard.column("doc_id").combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
    shard = shard.append_column("h", pa.array(mix64(ids, 1)))
    shard = shard.sort_by([(c, "ascending") for c in ("h", "doc_id", "source", "size", "cluster")]).combine_chunks()
    column = lambda c: shard.column(c).combine_chunks()
    size = column("size").to_numpy()
    # a document of n words is cut into pieces of the capacity and a rest; one of no words is one piece
    pieces = np.maximum(1, -(-size // capacity))
    row = np.repeat(np.arange(len(size)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.minimum(capacity, size[row] - piece * capacity)
    order = np.argsort(-length, kind="stable")
    row, piece, length = row[order], piece[order], length[order]

    source, n_sources = _codes(column("source")) if one_per_source else (np.full(len(size), -1), 0)
    cluster, n_clusters = _codes(column("cluster"), repeated_only=True)
    bins = Bins(capacity, n_sources, n_clusters)
    put = [bins.put(n, s, c) if n else (-1, -1) for n, s, c in zip(length.tolist(), source[row].tolist(), cluster[row].tolist(), strict=True)]
    own, place = np.array(put, np.int64).reshape(-1, 2).T
    fill = np.bincount(own + 1, length, bins.opened + 1).astype(np.int64)[own + 1]
    none = own < 0
    taken = [column(c).take(pa.array(row)) for c in ("doc_id", "source", "size", "cluster")]
    made = [pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64())]
    names = pa.array([None if b < 0 else f"{name}-{b}" for b in own.tolist()], pa.string())
    return pa.table([*taken, *made, names, pa.array(place, mask=none), pa.array(fill, mask=none)], schema=SCHEMA)


def text_cluster(text: Column) -> Column:
    """A cluster of equal texts, white space and A-Z case aside: the digest of the words."""
    plain = F.translate(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(plain) > 0, F.sha1(plain.cast("binary")))


def pack_documents(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, one_per_source: bool = True, size: Column | None = None) -> DataFrame:
    """Pieces of docs(doc_id, text, source) with their bins.

    cluster defaults to equal texts; pack_apart keeps near copies apart too. size
    defaults to the number of words; give token counts to pack tokens.
    Returns PLACED: a piece is words (or tokens) begin .. begin+length of its document, at place in bin_id.
    """
    text = F.col("text").cast("string")
    cluster = text_cluster(text) if cluster is None else cluster.cast("string")
    size = words(text) if size is None else F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), cluster.alias("cluster"))
    return pack_rows(rows, docs.count(), capacity, shard_rows, one_per_source)


def pack_apart(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, one_per_source: bool = True) -> DataFrame:
    """pack_documents with near copies (simhash.near_duplicates) as clusters: two of them never share a bin of a shard."""
    near = near_duplicates(docs.select("doc_id", "text", F.col("source").cast("string").alias("source")), keep=("source",))
    # components of rows without an id are told apart by fingerprint, which is theirs alone unless linked
    cluster = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    rows = near.select("doc_id", "source", "size", F.when(F.col("size") > 0, cluster).alias("cluster"))
    return pack_rows(rows, docs.count(), capacity, shard_rows, one_per_source)


def pack_rows(rows: DataFrame, n: int, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, one_per_source: bool = True) -> DataFrame:
    """Pieces of n rows(doc_id, source, size, cluster) with their bins."""
    ship(rows.sparkSession)
    like = ["doc_id", "source", "size", "cluster"]
    shards = max(1, -(-n // shard_rows))
    each = rows.groupBy(like).agg(F.count("*").alias("copies")).select(*like, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    dealt = each.select(*like, F.pmod(F.xxhash64(*like, "copy"), F.lit(shards)).alias("shard"))

    def placed(shard: pa.Table) -> pa.Table:
        return pack_shard(shard, capacity, one_per_source)

    return dealt.groupBy("shard").applyInArrow(placed, PLACED)


def bins_of(placed: DataFrame) -> DataFrame:
    """Bins with what they hold, in order of place."""
    return placed.where(F.col("bin_id").isNotNull()).groupBy("bin_id").agg(F.sum("length").alias("fill"), F.sort_array(F.collect_list(F.struct("place", "doc_id", "piece", "length"))).alias("pieces"))

