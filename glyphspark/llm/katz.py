"""Katz backoff language model: train on some rows of a table and score all of them.

Layout. Each task turns its documents into blocks of about BLOCK_TOKENS: token ids against a block
dictionary, so a token is written once, at about two bytes. A level of the model (1-grams, 2-grams,
...) is one exchange. Every block sends the distinct n-grams it holds, with its training counts, to
the partitions of the n-gram table; a partition sums the counts, stores its part of the table, and
answers each block with the counts of what it asked for and, for contexts with something unseen, what
the backoff weight needs. A block then evaluates the recursion for each of its tokens without a
further join. Nothing of corpus size reaches the driver; it sees only counts of counts.

Tables. Each level is written by kind: `answer` holds packed arrays for blocks, and `table` the counts
as typed arrays of at most PIECE entries a row: key (1-grams: the words' XXH64; else the contexts'
ids), word (ids) and count. count_table() reads them as one row an n-gram.

Memory. A task holds one block or one part at a time; parts have about PART_TOKENS n-grams.

Model. Counts r <= CUTOFF are Good-Turing discounted (absolute discounting where the counts of
counts don't allow that); backoff weights make each context sum to exactly one over the training
vocabulary and one unknown word:

    P(w | h) = d(r) r / c(h)            if r = c(h w) > 0
             = alpha(h) P(w | h')       otherwise, h' being h without its first word
    alpha(h) = (1 - sum of P(w | h)) / (1 - sum of P(w | h')), both over w seen after h

A context whose followers all lie above CUTOFF keeps no mass; its counts are then divided by
c(h) + 1. Words and contexts are known by 64-bit hashes and dense ids. P(w | h') of a seen h w is sent
as its count and a factor of the context, which take a byte or two where the value takes eight.

Skew. A context with more than a partition's share of the training tokens is split over several
partitions by the following word; blocks add up its parts' sums. Exact copies cost no more than
other text, for n-grams are summed within a block before they are sent.

Edge cases: a null or empty text is one end token; a null doc_id counts as the empty text in the
split; repeated doc_ids are scored row by row; an empty table gives no rows; with no training rows
every probability falls to the unknown word's (1); columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bucket, mix64, pack, trim, unpack

ORDER = 2
CUTOFF = 5
#: Tokens in a block, and n-grams in a partition, about.
BLOCK_TOKENS = 500_000
PART_TOKENS = 500_000
#: Entries of an array in one row. Rows of a few ten kilobytes are no large objects to the JVM.
PIECE = 16_384
START, END = 0, 1
#: No word holds a space, so these name the two ends.
ENDS = (b" start", b" end")

#: A block's own arrays, part naming which (total: tokens, in its first row).
BLOCKS = "part int, block string, piece int, payload binary, total long"
WORDS, PLACE, SEQ, DOCS = range(4)
ASKED = "part int, block string, piece int, payload binary"
#: A level: answers to blocks, and the level's counts (types, total, ones: sums of a part, in its first row).
LEVEL = "kind string, part int, block string, piece int, payload binary, types long, total long, ones array<long>, key array<long>, word array<long>, count array<long>"
ANSWER, TABLE = "answer", "table"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class _Numbered(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_ASK_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.string()), ("piece", pa.int32()), ("payload", pa.binary())])
_BLOCK_SCHEMA = pa.schema([*_ASK_SCHEMA, ("total", pa.int64())])
_LONGS = pa.list_(pa.int64())
_LEVEL_SCHEMA = pa.schema([("kind", pa.string()), *_ASK_SCHEMA, ("types", pa.int64()), ("total", pa.int64()), ("ones", _LONGS), ("key", _LONGS), ("word", _LONGS), ("count", _LONGS)])
_NO_COUNTS = (None,) * 6


def _pieces(n: int) -> Iterator[tuple[int, slice]]:
    """Numbered slices of n entries, at least one."""
    for i, at in enumerate(range(0, max(n, 1), PIECE)):
        yield i, slice(at, at + PIECE)


def _table(part: int, count: np.ndarray, key: np.ndarray, word: np.ndarray, real: np.ndarray) -> list[tuple]:
    """Rows of a part's counts; real: the counts that make its sums."""
    ones = np.bincount(np.minimum(real, CUTOFF + 2), minlength=CUTOFF + 2)[1 : CUTOFF + 2].tolist()
    sums = (int((real > 0).sum()), int(real.sum()), ones)
    return [(TABLE, part, None, i, None, *(sums if not i else (0, 0, None)), key[x], word[x], count[x]) for i, x in _pieces(len(count))]


def _encode(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start() -> tuple:
            words = _Numbered()
            for end in ENDS:
                words[end]
            return words, [], [], 0

        words, seqs, docs, n = start()

        def flush() -> Iterator[pa.RecordBatch]:
            seq = np.concatenate(seqs)
            counts = np.bincount(seq, minlength=len(words))
            # frequent words first: small ids compress well
            order = np.concatenate([[START, END], 2 + np.argsort(-counts[2:], kind="stable")]).astype(np.int64)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            keys = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in words), np.uint64, len(words))[order]
            ids, train, null = (np.array(x) for x in zip(*docs, strict=True))
            name = uuid.uuid4().hex  # a task may encode several partitions
            by_key = np.argsort(keys)
            keys, seq = keys[by_key], place[seq]
            is_train = np.repeat(train.astype(bool), np.diff(np.concatenate([[-1], np.flatnonzero(seq == END)])))
            count = np.bincount(seq[is_train], minlength=len(keys))[by_key]
            for i, at in _pieces(len(keys)):
                yield _batch(_BLOCK_SCHEMA, [(WORDS, name, i, pack(np.diff(keys[at], prepend=np.uint64(0)), count[at], (by_key[at] == START).astype(np.int8)), 0)])
            for kind, array in ((PLACE, by_key), (SEQ, seq)):
                for i, at in _pieces(len(array)):
                    yield _batch(_BLOCK_SCHEMA, [(kind, name, i, pack(array[at]), 0)])
            for i, at in _pieces(len(ids)):
                yield _batch(_BLOCK_SCHEMA, [(DOCS, name, i, pack(ids[at], train[at], null[at]), 0 if i else n)])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, train, texts = (batch.column(i).slice(at, 256).to_pylist() for i in range(3))
                for doc, t, text in zip(ids, train, texts, strict=True):
                    w = text.lower().split() if text else []
                    seq = np.empty(len(w) + 2, np.int32)
                    seq[0], seq[-1] = START, END
                    seq[1:-1] = np.fromiter(map(words.__getitem__, w), np.int32, len(w))
                    seqs.append(seq)
                    docs.append((doc or 0, t, doc is None))
                    n += len(w) + 1
                    if n >= block_tokens:
                        yield from flush()
                        words, seqs, docs, n = start()
                        trim()
        if docs:
            yield from flush()
        trim()

    return run


def _unigram(count: np.ndarray, model: dict) -> np.ndarray:
    """P(w) of a word's count."""
    if not model["discounted"]:
        return (count + 0.5) / (model["N"] + 0.5 * (model["V"] + 1))
    return np.where(count > 0, model["d"][np.minimum(count, CUTOFF + 1)] * count / max(model["N"], 1), model["unknown"])


class _Block:
    """One block's arrays, rebuilt from its rows and the answers to earlier levels."""

    def __init__(self, own: dict[int, list]) -> None:
        """own: the block's own arrays, by which they are and piece."""
        self.by_key, self.seq = (np.concatenate([x[0].astype(np.int32) for x in own[kind]]) for kind in (PLACE, SEQ))
        self.doc_ids, self.train, self.null = (np.concatenate([x[i] for x in own[DOCS]]) for i in range(3))
        ends = np.flatnonzero(self.seq == END)
        self.lengths = np.diff(np.concatenate([[-1], ends]))
        self.is_train = np.repeat(self.train.astype(bool), self.lengths)
        self.starts = self.seq == START

    # level 1 -----------------------------------------------------------------
    def take_words(self, answers: list[list[np.ndarray]], model: dict) -> None:
        """answers: by part and piece, which is the order of keys."""
        count, ids = np.zeros(len(self.by_key), np.int64), np.zeros(len(self.by_key), np.int64)
        count[self.by_key], ids[self.by_key] = (np.concatenate([a[i] for a in answers]) for i in range(2))
        self.word_count, self.word_id = count, ids
        self.logp = np.log10(_unigram(count, model))[self.seq]
        # the 1-gram that ends at each place: which, its count, its id; and the factor of its context
        self.gram, self.gram_count, self.gram_id, self.factor = self.seq, count, ids, None

    # levels above ------------------------------------------------------------
    def ngrams(self) -> None:
        """The distinct n-grams, one longer than those known so far."""
        context = np.concatenate([[-1], self.gram[:-1]])
        place = np.flatnonzero((context >= 0) & ~self.starts)
        place = place[self.gram_count[context[place]] > 0]  # an unseen context backs off with weight one
        pair = context[place] * np.int64(len(self.word_id)) + self.seq[place]
        pair, first, of = np.unique(pair, return_index=True, return_inverse=True)
        self.place, self.of = place, of.astype(np.int32)
        self.ctx, self.word = np.divmod(pair, len(self.word_id))
        first = place[first]
        self.lower = self.logp[first]
        # of the n-gram without its first word: its count, and what that count is multiplied by
        self.low = self.gram_count[self.gram[first]]
        self.low_factor = None if self.factor is None else self.factor[self.gram[first]]
        self.count = np.bincount(of[self.is_train[place]], minlength=len(pair))
        self.contexts = np.unique(self.ctx)

    def _salts(self, c: np.ndarray, parts: int, share: float) -> np.ndarray:
        return np.clip(np.ceil(self.gram_count[c] / share), 1, parts).astype(np.int64)

    def _chunks(self, parts: int, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each part that holds some of them: contexts, and n-grams by word."""

        def part(c: np.ndarray, salt: np.ndarray) -> np.ndarray:
            return ((mix64(self.gram_id[c], 2) + salt.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)

        own = part(self.ctx, (mix64(self.word_id[self.word], 3) % self._salts(self.ctx, parts, share).astype(np.uint64)).astype(np.int64))
        n = self._salts(self.contexts, parts, share)
        c = np.repeat(self.contexts, n)
        at = part(c, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        grams = dict(_by_part(own))
        for p, which in _by_part(at):
            g = grams.get(p, np.zeros(0, np.int64))
            yield p, c[which], g[np.argsort(self.word_id[self.word[g]], kind="stable")]

    def ask_ngrams(self, parts: int, share: float) -> Iterator[tuple[int, tuple]]:
        for p, c, g in self._chunks(parts, share):
            at, seen = np.searchsorted(c, self.ctx[g]), self.count[g] > 0
            factor = np.zeros(0)
            if self.low_factor is not None:
                factor = np.zeros(len(c))
                factor[at] = self.low_factor[g]
            # a split context's sums are needed from all its parts
            split = (self._salts(c, parts, share) > 1).astype(np.int8)
            yield p, (self.gram_id[c], split, factor, at, np.diff(self.word_id[self.word[g]], prepend=0), self.count[g], np.where(seen, self.low[g], 0))

    def take_ngrams(self, parts: int, share: float, answers: dict[int, list[np.ndarray]], d: np.ndarray) -> None:
        total, ids = (np.zeros(len(self.ctx), np.int64) for _ in range(2))
        mass = np.zeros(len(self.gram_count), bool)
        sums, below = np.zeros((len(self.gram_count), CUTOFF + 1)), np.zeros(len(self.gram_count))
        for p, c, g in self._chunks(parts, share):
            total[g], ids[g], some, asked, of_context, under = answers[p]
            mass[c] |= some > 0
            c = c[asked > 0]  # each once in a part
            sums[c] += of_context
            below[c] += under
        c = self.gram_count.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            kept = (sums[:, :CUTOFF] * (d[1 : CUTOFF + 1] * np.arange(1, CUTOFF + 1))).sum(1) + sums[:, CUTOFF]
            scale = 1 / np.where(mass, c, c + 1)
            alpha = (1 - kept * scale) / np.maximum(1 - below, 1e-300)
            factor = scale[self.ctx]
            logp = np.where(total > 0, np.log10(d[np.minimum(total, CUTOFF + 1)] * total * factor), np.log10(alpha)[self.ctx] + self.lower)
        self.logp = self.logp.copy()
        self.logp[self.place] = logp[self.of]
        gram = np.full(len(self.seq), -1, np.int32)
        gram[self.place] = self.of
        self.gram, self.gram_count, self.gram_id, self.factor = gram, total, ids, factor

    # result ------------------------------------------------------------------
    def result(self, model: dict) -> dict[str, list]:
        at = np.cumsum(self.lengths) - self.lengths
        counted = ~self.starts
        known = (self.word_count[self.seq] > 0) & counted
        base = np.where(counted, np.log10((self.word_count + 0.5) / (model["N"] + 0.5 * (model["V"] + 1)))[self.seq], 0.0)
        n = len(at)
        return {
            "doc_id": pa.array(self.doc_ids.astype(np.int64), mask=self.null.astype(bool)),
            "held_out": ~self.train.astype(bool),
            "n_tokens": self.lengths - 1,
            "n_known": np.add.reduceat(known.astype(np.int64), at),
            "train_tokens": np.full(n, model["N"], np.int64),
            "base_score": np.add.reduceat(base, at),
            "score": np.add.reduceat(np.where(counted, self.logp, 0.0), at),
        }


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.diff(part[order], prepend=-1))
    if not len(at):
        return
    for i, j in zip(at, [*at[1:], len(order)], strict=True):
        yield int(part[order[i]]), order[i:j]


def _rebuilt(rows: pa.Table, models: list[dict], parts: int) -> tuple[str, _Block]:
    """A block's name, and the block as it stands after the levels of models."""
    rows = rows.select(["level", "part", "piece", "block", "payload"]).sort_by([("level", "ascending"), ("part", "ascending"), ("piece", "ascending")])
    level, part, payload = rows.column("level").to_numpy(), rows.column("part").to_numpy(), rows.column("payload")

    def of(n: int) -> list[tuple[int, list[np.ndarray]]]:
        lo, hi = np.searchsorted(level, [n, n + 1])
        return [(int(p), unpack(x.as_buffer())) for p, x in zip(part[lo:hi], payload.slice(lo, hi - lo), strict=True)]

    own: dict[int, list] = {}
    for kind, arrays in of(0):
        own.setdefault(kind, []).append(arrays)
    b = _Block(own)
    for n, model in enumerate(models, 1):
        if n == 1:
            b.take_words([x for _, x in of(n)], model)
        else:
            b.ngrams()
            b.take_ngrams(parts, model["share"], dict(of(n)), model["d"])
    return rows.column("block")[0].as_py(), b


def _ask_words(parts: int):
    """Each piece of a block's words to the parts that hold them; a part is a range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, piece, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, count, start = unpack(payload)
                keys = np.cumsum(keys.astype(np.uint64))
                out = []
                for p, at in _by_part(((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)):
                    out.append((p, block, piece, pack(np.diff(keys[at], prepend=np.uint64(0)), count[at], start[at])))
                yield _batch(_ASK_SCHEMA, out)

    return run


def _asks(asked: pa.Table) -> tuple[int, list[tuple], list[list[np.ndarray]]]:
    """A part, and by request: who asks, and what."""
    names = list(zip(asked.column("block").to_pylist(), asked.column("piece").to_pylist(), strict=True))
    return asked.column("part")[0].as_py(), names, [unpack(x.as_buffer()) for x in asked.column("payload")]


def _count_words(parts: int):
    """Sum a partition's words over all blocks; answer each block."""

    def run(asked: pa.Table) -> pa.Table:
        trim()
        part, names, chunks = _asks(asked)
        keys = np.concatenate([np.cumsum(x[0].astype(np.uint64)) for x in chunks])
        words, of = np.unique(keys, return_inverse=True)
        count = np.bincount(of, np.concatenate([x[1] for x in chunks]).astype(float), len(words)).astype(np.int64)
        start = np.bincount(of, np.concatenate([x[2] for x in chunks]), len(words)) > 0
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(words))
        ids, real, at, rows = rank * parts + part, count * ~start, 0, []
        for name, x in zip(names, chunks, strict=True):
            own = of[at : at + len(x[0])]
            at += len(x[0])
            rows.append((ANSWER, part, *name, pack(count[own], ids[own]), *_NO_COUNTS))
        seen = count > 0
        rows += _table(part, count[seen], words[seen].view(np.int64), ids[seen], real)
        return pa.Table.from_batches([_batch(_LEVEL_SCHEMA, rows)])

    return run


def _ask_ngrams(parts: int, models: list[dict], share: float):
    def run(found: pa.Table) -> pa.Table:
        trim()
        name, b = _rebuilt(found, models, parts)
        b.ngrams()
        rows = [(p, name, 0, pack(*x)) for p, x in b.ask_ngrams(parts, share)]
        return pa.Table.from_batches([_batch(_ASK_SCHEMA, rows)] if rows else [], schema=_ASK_SCHEMA)

    return run


def _count_ngrams(level: int, order: int, parts: int, models: list[dict]):
    """Sum a partition's n-grams over all blocks; answer each block with counts and context sums."""

    def run(asked: pa.Table) -> pa.Table:
        trim()
        part, names, chunks = _asks(asked)
        contexts, of_context = np.unique(np.concatenate([x[0] for x in chunks]).astype(np.int64), return_inverse=True)
        at, ctx, word, factor = 0, [], [], np.zeros(len(contexts))
        for x in chunks:
            here = of_context[at : at + len(x[0])]
            ctx.append(here[x[3]])
            word.append(np.cumsum(x[4].astype(np.int64)))
            if len(x[2]):
                factor[here] = np.maximum(factor[here], x[2])  # zero where a block has no n-gram of the context here
            at += len(x[0])
        ctx, word = np.concatenate(ctx), np.concatenate(word)
        by_word = np.lexsort((ctx, word))
        new = np.concatenate([[True], (np.diff(ctx[by_word]) != 0) | (np.diff(word[by_word]) != 0)])[: len(by_word)]
        of = np.empty(len(by_word), np.int64)
        of[by_word] = np.cumsum(new) - 1
        n = int(new.sum())
        count = np.bincount(of, np.concatenate([x[5] for x in chunks]).astype(float), n).astype(np.int64)
        ctx, word = ctx[by_word][new], word[by_word][new]
        seen = count > 0
        low = np.zeros(n, np.int64)
        np.maximum.at(low, of, np.concatenate([x[6] for x in chunks]).astype(np.int64))
        lower = _unigram(low, models[0]) if level == 2 else models[-1]["d"][np.minimum(low, CUTOFF + 1)] * low * factor[ctx]
        ids = (np.cumsum(seen) - 1) * parts + part
        # of each context: followers with count 1, 2, ... CUTOFF, the other followers' counts, and P(w | h') over all
        sums = np.zeros((len(contexts), CUTOFF + 1), np.int64)
        for r in range(1, CUTOFF + 1):
            sums[:, r - 1] = np.bincount(ctx[count == r], minlength=len(contexts))
        sums[:, CUTOFF] = np.bincount(ctx[count > CUTOFF], count[count > CUTOFF], len(contexts))
        below = np.bincount(ctx[seen], lower[seen], len(contexts))
        mass = sums[:, :CUTOFF].any(1).astype(np.int8)
        rows, at, c = [], 0, 0
        for name, x in zip(names, chunks, strict=True):
            own, here = of[at : at + len(x[3])], of_context[c : c + len(x[0])]
            at, c = at + len(x[3]), c + len(x[0])
            # sums are for what backs off
            asks = x[1] > 0
            asks[x[3][~seen[own]]] = True
            next_ids = ids[own] if level < order else np.zeros(len(own), np.uint8)  # for the next level alone
            rows.append((ANSWER, part, *name, pack(count[own], next_ids, mass[here], asks.astype(np.int8), sums[here[asks]], below[here[asks]]), *_NO_COUNTS))
        by_context = np.flatnonzero(seen)[np.argsort(ctx[seen], kind="stable")]
        rows += _table(part, count[by_context], contexts[ctx[by_context]], word[by_context], count)
        return pa.Table.from_batches([_batch(_LEVEL_SCHEMA, rows)])

    return run


def _score(models: list[dict], parts: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(found: pa.Table) -> pa.Table:
        trim()
        return pa.table(_rebuilt(found, models, parts)[1].result(models[0]), schema=schema)

    return run


def discounts(ones: list[int]) -> np.ndarray:
    """Good-Turing factors d[0..CUTOFF+1] from counts of counts 1..CUTOFF+1; d[r] = 1 beyond the cutoff.

    Where these counts don't fall as they should, absolute discounting takes their place.
    """
    d = np.ones(CUTOFF + 2)
    n = [0, *ones]
    r = np.arange(1, CUTOFF + 1)
    if all(x > 0 for x in ones[: CUTOFF + 1]):
        a = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
        star = np.array([(i + 1) * n[i + 1] / n[i] for i in r])
        if a < 1:
            d[1 : CUTOFF + 1] = (star / r - a) / (1 - a)
    good = d[1 : CUTOFF + 1]
    if not ((good > 0) & (good < 1)).all():
        cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d[1 : CUTOFF + 1] = (r - cut) / r
    return d


def _stats(level: DataFrame) -> tuple[int, int, list[int]]:
    """Types, tokens and counts of counts of a level: one row of sums."""
    row = level.where(F.col("kind") == TABLE).agg(F.sum("types"), F.sum("total"), *[F.sum(F.col("ones")[i]) for i in range(CUTOFF + 1)]).first()
    v, n, *ones = (x or 0 for x in row)
    return v, n, ones


def count_table(level: DataFrame) -> DataFrame:
    """(part, key, word, count) of a written level, one row an n-gram."""
    return level.where(F.col("kind") == TABLE).select("part", F.inline(F.arrays_zip("key", "word", "count")))


def model(docs: DataFrame, train=None, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> tuple[DataFrame, list[DataFrame], list[dict], int]:
    """Blocks of docs, the written levels, their parameters, and the number of parts."""
    train = F.coalesce(bucket(F.col("doc_id"), 5) != 1, F.lit(True)) if train is None else train
    scratch = Scratch(docs.sparkSession, "katz")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.cast("boolean").alias("train"), F.col("text").cast("binary").alias("text"))
    blocks = scratch.keep(rows.mapInArrow(_encode(block_tokens), BLOCKS), "blocks", "none")
    tokens = blocks.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    parts = max(1, -(-tokens // part_tokens))
    models: list[dict] = []
    levels: list[DataFrame] = []
    for level in range(1, order + 1) if tokens else ():
        share = max(1.0, tokens / parts)
        if level == 1:
            words = blocks.where(F.col("part") == WORDS).select("block", "piece", "payload")
            asked, count = words.mapInArrow(_ask_words(parts), ASKED), _count_words(parts)
        else:
            asked = _for_blocks(blocks, levels).groupBy("block").applyInArrow(_ask_ngrams(parts, models, share), ASKED)
            count = _count_ngrams(level, order, parts, models)
        levels.append(scratch.keep(asked.groupBy("part").applyInArrow(count, LEVEL), f"level{level}", by="kind"))
        types, total, ones = _stats(levels[-1])
        d = discounts(ones)
        found = {"d": d, "share": share}
        if level == 1:
            small = [o * (1 - d[r]) * r for r, o in enumerate(ones[:CUTOFF], 1)]
            unknown = sum(small) / max(total, 1)
            found |= {"N": total, "V": types, "unknown": unknown, "discounted": 1e-12 < unknown < 1}
        models.append(found)
    return blocks, levels, models, parts


def katz_scores(docs: DataFrame, train=None, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Score every row of docs(doc_id, text); learn from rows where train (a Column) holds.

    train defaults to crc32(doc_id as text) mod 5 <> 1. Returns SCORES; score is the log10
    probability of the text's words and its end. The count tables stay in the shared folder.
    """
    blocks, levels, models, parts = model(docs, train, order, block_tokens, part_tokens)
    if not models:
        return docs.sparkSession.createDataFrame([], SCORES)
    return _for_blocks(blocks, levels).groupBy("block").applyInArrow(_score(models, parts), SCORES)


def _for_blocks(blocks: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Blocks' own arrays but their words, and all answers to them."""
    columns = ["part", "block", "piece", "payload"]
    out = blocks.where(F.col("part") != WORDS).select(F.lit(0).alias("level"), *columns)
    for n, level in enumerate(levels, 1):
        out = out.unionByName(level.where(F.col("kind") == ANSWER).select(F.lit(n).alias("level"), *columns))
    return out


#: The same at order 2, in SQL: crc32 by its bits, counts, discounts, backoff weights, scores.
ORACLE = """
WITH crc AS (SELECT doc_id, text, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(coalesce(doc_id::VARCHAR, ''), '.'), lambda c: unicode(c)::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS crc FROM documents),
t AS (SELECT row_number() OVER () AS row, doc_id, crc % 5 = 1 AS held_out, [' start'] || regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') || [' end'] AS s FROM crc),
p AS (SELECT row, doc_id, held_out, unnest(list_slice(s, 1, len(s) - 1)) AS h, unnest(list_slice(s, 2, len(s))) AS w FROM t),
u AS (SELECT w, count(*) AS c FROM p WHERE NOT held_out GROUP BY w),
b AS (SELECT h, w, count(*) AS c FROM p WHERE NOT held_out GROUP BY h, w),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM u),
k AS (SELECT 1 AS level, [count(*) FILTER (c = 1), count(*) FILTER (c = 2), count(*) FILTER (c = 3), count(*) FILTER (c = 4), count(*) FILTER (c = 5), count(*) FILTER (c = 6)] AS n FROM u
    UNION ALL SELECT 2, [count(*) FILTER (c = 1), count(*) FILTER (c = 2), count(*) FILTER (c = 3), count(*) FILTER (c = 4), count(*) FILTER (c = 5), count(*) FILTER (c = 6)] FROM b),
g AS (SELECT level, n, list_transform(range(1, 6), lambda r: ((r + 1) * n[r + 1] / n[r]::DOUBLE / r - 6 * n[6] / n[1]::DOUBLE) / (1 - 6 * n[6] / n[1]::DOUBLE)) AS good FROM k),
d AS (SELECT level, n, CASE WHEN list_min(n) > 0 AND 6 * n[6] < n[1] AND list_min(good) > 0 AND list_max(good) < 1 THEN good
    ELSE list_transform(range(1, 6), lambda r: (r - CASE WHEN n[1] > 0 AND n[2] > 0 THEN n[1] / (n[1] + 2 * n[2])::DOUBLE ELSE 0.5::DOUBLE END) / r) END AS d FROM g),
d1 AS (SELECT d AS d1, n AS n1 FROM d WHERE level = 1), d2 AS (SELECT d AS d2 FROM d WHERE level = 2),
z AS (SELECT n.n, v, d1, d2, list_sum(list_transform(range(1, 6), lambda r: n1[r] * (1 - d1[r]) * r)) / greatest(n.n, 1) AS unknown FROM n, d1, d2),
m AS (SELECT *, unknown > 1e-12 AND unknown < 1 AS discounted FROM z),
pu AS (SELECT w, c, CASE WHEN discounted THEN CASE WHEN c <= 5 THEN d1[c] ELSE 1 END * c / n ELSE (c + 0.5) / (n + 0.5 * (v + 1)) END AS p FROM u, m),
q AS (SELECT h, b.w, CASE WHEN b.c <= 5 THEN d2[b.c] ELSE 1 END * b.c AS kept, b.c, pu.p FROM b JOIN pu ON pu.w = b.w, m),
x AS (SELECT h, sum(c) AS c, sum(kept) AS kept, sum(p) AS low FROM q GROUP BY h),
y AS (SELECT h, kept, low, CASE WHEN c - kept > 1e-9 * c THEN 1 / c::DOUBLE ELSE 1 / (c + 1)::DOUBLE END AS scale FROM x),
s AS (SELECT p.row, p.doc_id, p.held_out, pu.c IS NOT NULL AS known, log10((coalesce(pu.c, 0) + 0.5) / (n + 0.5 * (v + 1))::DOUBLE) AS base,
    CASE WHEN q.kept IS NOT NULL THEN log10(q.kept * y.scale) ELSE log10(coalesce(pu.p, CASE WHEN discounted THEN unknown ELSE 0.5 / (n + 0.5 * (v + 1))::DOUBLE END))
        + CASE WHEN y.h IS NULL THEN 0 ELSE log10((1 - y.kept * y.scale) / greatest(1 - y.low, 1e-300)) END END AS lp
    FROM p CROSS JOIN m LEFT JOIN pu ON pu.w = p.w LEFT JOIN q ON q.h = p.h AND q.w = p.w LEFT JOIN y ON y.h = p.h)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, any_value((SELECT n FROM n)) AS train_tokens, sum(base) AS base_score, sum(lp) AS score FROM s GROUP BY row, doc_id, held_out
"""
