"""Mix sources to target weights by subset-sum budget fitting over exact lengths.

Targets. A source's size is the words of its documents. Sources by code point, null last, weigh
WEIGHTS, repeating; BUDGET times all words are shared by weight. A target stops at MOST times the
source's size and the excess is shared again by weight, until none is above.

Fitting. A target of whole passes and a rest: every document is taken once for each whole pass,
and the rest is fitted from documents taken once more. Documents are counted by exact length; of
each length the rest's proportion is taken (so that the mix keeps the source's lengths), longest
remaining lengths then fill the budget down to WINDOW lengths, and bounded-knapsack dynamic
programming over the counts left finds the largest sum within what remains; it holds a bit and a
number for each sum up to WINDOW times the longest length. Documents of a length
have a seeded order, by a hash of doc_id, then doc_id, then a hash of the text, so reruns agree.

Scale. Rows meet only as counts, summed before their shuffle: by (source, length) for the fit, whose
tasks hold a source's distinct lengths, never its documents. Where a length is taken in part, a cut
in the order says which: counts by slices of the hash find the slice that holds the cut, and counts
by distinct keys inside it the cut itself. A length of n rows has about sqrt(n) slices, of
sqrt(n) rows each, and a document repeated any number of times is one key. What comes back to the rows is one limit a
(source, length), broadcast up to LIMITS of them, else joined; rows and texts aren't moved for it.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source of its
own; rows alike in doc_id, source and text are taken one by one, in no order; an empty table gives no
rows; other columns are ignored, and carried along by mixed_documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2.0
SEED = 17
#: Lengths beyond the largest that dynamic programming has as budget.
WINDOW = 3
#: Limits that are broadcast, at most; some 100 bytes each.
LIMITS = 100_000
#: Parts of a doubling by which sources are summed before the level is solved.
STEPS = 16


def words(text: Column) -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources with their place by code point, null last, without one task that holds them all."""
    # written, for a range partitioning drawn again may cut elsewhere
    spread = scratch.keep(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("pid", F.spark_partition_id()), "ranges")
    at = Window.partitionBy("pid").orderBy(F.col("source").isNull(), "source")
    placed = spread.withColumn("i", F.row_number().over(at) - 1)
    # as many rows as partitions
    before = placed.groupBy("pid").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(before, "pid").withColumn("place", F.col("i") + F.col("before")).drop("pid", "i", "n", "before")


def _level(placed: DataFrame, budget: float) -> float:
    """The level at which min(most, level * weight) sums to budget, from below."""
    step = F.floor(F.log2(F.col("most") / F.col("weight")) * STEPS).cast("int")
    # as many rows as doublings of a double have steps, whatever the number of sources
    sums = placed.where("most > 0").groupBy(step.alias("step")).agg(F.sum("most").alias("most"), F.sum("weight").alias("weight")).collect()
    capped, open_, level = 0.0, sum(r.weight for r in sums), 0.0
    for r in sorted(sums, key=lambda r: r.step):
        level = (budget - capped) / open_
        if level < 2.0 ** ((r.step + 1) / STEPS):
            break
        # the level is above all of these, so they are full
        capped, open_ = capped + r.most, open_ - r.weight
    while True:  # only sources of one step are left to tell
        full = F.col("most") < F.lit(level) * F.col("weight")
        capped, open_ = placed.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full & (F.col("most") > 0), F.col("weight"))), F.lit(0.0))).first()
        risen = (budget - capped) / open_ if open_ else level
        if risen <= level * (1 + 1e-12):
            return level
        level = risen


def targets(sources: DataFrame, scratch: Scratch, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sources(source, source_size) with weight and target."""
    scale = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = scratch.keep(_ranked(sources, scratch).withColumn("weight", scale).withColumn("most", F.lit(most) * F.col("source_size")), "placed")
    total = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    return placed.select("source", "source_size", "weight", F.least(F.col("most"), F.lit(_level(placed, budget * total)) * F.col("weight")).alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many of each length to take, at most counts, for the largest sum within reach of budget."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    if budget <= 0:
        return [0] * len(lengths)
    # in proportion, then longest first, but leave the window to dynamic programming
    reach = window * max(lengths)
    take = [c * max(0, budget - reach) // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left <= reach:
            break
        more = min(counts[i] - take[i], (left - reach) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    # bounded knapsack on bits: sums reachable within `left`, by items of doubling counts; of each sum the item that first reaches it
    mask, state, items, first = (1 << left + 1) - 1, 1, [], np.zeros(left + 1, np.int32)
    for i in order:
        spare, k = min(counts[i] - take[i], left // lengths[i]), 1
        while spare > 0:
            k = min(k, spare)
            new = (state << k * lengths[i]) & mask & ~state
            if new:
                first[_ones(new)] = len(items)
                items.append((i, k))
                state |= new
            spare -= k
            k *= 2
        if state >> left & 1:
            break
    at = state.bit_length() - 1
    while at:  # what an item reaches first it reaches from a sum of items before it
        i, k = items[first[at]]
        take[i] += k
        at -= k * lengths[i]
    return take


def _ones(bits: int) -> np.ndarray:
    """Places of the ones of a big integer."""
    data = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8)
    some = np.flatnonzero(data)
    row, bit = np.nonzero(np.unpackbits(data[some][:, None], axis=1, bitorder="little"))
    return some[row] * 8 + bit


def _fitted(group: pa.Table) -> pa.Table:
    sizes, counts, target = group.column("size").to_pylist(), group.column("n").to_pylist(), group.column("target")[0].as_py()
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    sizes, counts = [sizes[i] for i in order], [counts[i] for i in order]
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    passes = int(target // total)
    take = fit(sizes, counts, round(target - passes * total))
    source = pa.array([group.column("source")[0].as_py()] * len(sizes), pa.string())
    return pa.table({"source": source, "size": pa.array(sizes, pa.int64()), "passes": pa.array([passes] * len(sizes), pa.int64()), "take": pa.array(take, pa.int64())})


def _of(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """doc_id, source, size and the seeded order of each row of docs."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), words(text).alias("size"), F.xxhash64(text, F.lit(seed)).alias("tie"), *more)
    # not negative, so that high bits say the slice
    return rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit(2**63 - 1)))


def _key() -> Column:
    """Place in the order of a length, without nulls."""
    return F.struct("h", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("lost"), "tie")


def _joined(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """a with b's further columns, by equal keys; null sources are equal."""
    side = b.withColumnsRenamed({k: f"{k}_of" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) if k == "source" else F.col(k) == F.col(f"{k}_of") for k in keys]
    return a.join(side, same, how).drop(*[f"{k}_of" for k in keys])


def _cuts(rows: DataFrame, part: DataFrame) -> DataFrame:
    """For lengths part(source, size, n, take) the key where the order is cut: rows below it are taken.

    Of the tie_n rows that have the very key, tie_take are taken.
    """
    # as many slices as rows in one, about
    bits = F.ceil(F.log2(F.col("n")) / 2).cast("int")
    keyed = _joined(rows, part, "source", "size").withColumn("bits", bits).withColumn("slice", F.expr("shiftright(h, 63 - bits)"))
    upto = Window.partitionBy("source", "size").rowsBetween(Window.unboundedPreceding, 0)
    slices = keyed.groupBy("source", "size", "take", "slice").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(upto.orderBy("slice")))
    cut = slices.where("upto - c < take and take <= upto").select("source", "size", "slice", (F.col("take") - F.col("upto") + F.col("c")).alias("left"))
    inside = _joined(keyed, cut, "source", "size", "slice").select("source", "size", "left", _key().alias("cut"))
    keys = inside.groupBy("source", "size", "left", "cut").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(upto.orderBy("cut")))
    return keys.where("upto - c < left and left <= upto").select("source", "size", "cut", F.col("c").alias("tie_n"), (F.col("left") - F.col("upto") + F.col("c")).alias("tie_take"))


def _small(df: DataFrame) -> DataFrame:
    """A written table with a hint to broadcast it, if it is small."""
    return F.broadcast(df) if df.count() <= LIMITS else df


def limits(rows: DataFrame, scratch: Scratch, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """What each (source, size) of rows (see _of, written) takes: passes, and take of n by the cut."""
    counts = scratch.keep(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    aims = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), scratch, weights, budget, most)
    aimed = _joined(counts, aims, "source").drop("weight")
    fitted = aimed.where("size > 0").groupBy("source").applyInArrow(_fitted, "source string, size long, passes long, take long")
    takes = scratch.keep(_joined(aimed, fitted, "source", "size", how="left").fillna(0, ["passes", "take"]), "takes")
    cuts = _cuts(rows, _small(takes.where("take > 0 and take < n").select("source", "size", "n", "take")))
    return scratch.keep(_joined(takes, cuts, "source", "size", how="left"), "limits")


def _more() -> Column:
    """One if a row is taken once more, null if some of its likes are."""
    key, cut = _key(), F.col("cut")
    tied = F.when(F.col("tie_take") == F.col("tie_n"), 1)
    return F.when(cut.isNull(), (F.col("take") > 0).cast("int")).when(key < cut, 1).when(key > cut, 0).otherwise(tied)


def _limited(rows: DataFrame, found: DataFrame) -> DataFrame:
    return _joined(rows, _small(found), "source", "size").withColumn("more", _more())


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs(doc_id, text, source).

    taken is size times the passes that take the document.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.keep(_of(docs, seed), "rows")
    found = limits(rows, scratch, weights, budget, most)
    out = lambda df: df.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken"))
    alone = out(_limited(rows, found).where(F.col("more").isNotNull()))
    split = found.where("tie_take < tie_n")
    if split.isEmpty():
        return alone
    # rows at a cut that parts them are alike in all that is returned
    each = split.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("tie_n"))))
    return alone.unionByName(out(each.withColumns({"doc_id": F.when(~F.col("cut.lost"), F.col("cut.id")), "more": (F.col("i") <= F.col("tie_take")).cast("int")})))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Rows of docs with all their columns, each as many times as the mix takes it.

    Rows alike in doc_id, source and text of which only some are taken once more are represented by one of them.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.keep(_of(docs, seed), "rows")
    found = limits(rows, scratch, weights, budget, most)
    whole = _limited(_of(docs, seed, F.struct("*").alias("row")), found)
    times = lambda df, n: df.where(n > 0).select("row", F.explode(F.sequence(F.lit(1), n.cast("int")))).select("row.*")
    out = times(whole.where(F.col("more").isNotNull()), F.col("passes") + F.col("more"))
    if found.where("tie_take < tie_n").isEmpty():
        return out
    one = whole.where(F.col("more").isNull()).groupBy("source", "size", "cut").agg(F.first("row").alias("row"), *[F.first(c).alias(c) for c in ("passes", "tie_n", "tie_take")])
    return out.unionByName(times(one, F.col("passes") * F.col("tie_n") + F.col("tie_take")))
