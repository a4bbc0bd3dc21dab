"""The language model against a plain recursive one, and its exact normalisation."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphspark.llm import common, katz

TEXTS = [
    (1, "a b a b c d a b"), (2, "A b c\td a\nb a b e"), (3, ""), (4, None), (5, "z z z a b"), (6, "b a b a c new words here"),
    (7, "a b c d e f g a b c d"), (7, "a b c d e f g a b c d"), (8, "q " * 300), (9, "c d a b e f"), (10, "a c a d a e a f a g"), (None, "a b unknown"),
    (11, "x y z"), (12, "x y w v"), (13, "é ß a b É"), (14, "a b c " * 40),
]


def held_out(doc):
    return zlib.crc32(str(doc).encode() if doc is not None else b"") % 5 == 1


class Plain:
    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            seq = [b"<"] + (t or "").encode().lower().split() + [b" >"]
            for n in range(1, order + 1):
                for i in range(1 if n == 1 else n - 1, len(seq)):
                    self.counts[n][tuple(seq[i - n + 1 : i + 1])] += 1
        self.context = [None] + [Counter() for _ in range(order)]
        for n in range(1, order + 1):
            for g, c in self.counts[n].items():
                self.context[n][g[:-1]] += c
        self.d = [None] + [katz.discounts([sum(v == r for v in self.counts[n].values()) for r in range(1, 7)]) for n in range(1, order + 1)]
        self.N = sum(self.counts[1].values())
        self.vocab = [w for (w,) in self.counts[1]]

    def unigram(self, w):
        c, d = self.counts[1][(w,)], self.d[1]
        unknown = 1 - sum(d[min(x, 6)] * x / self.N for x in self.counts[1].values())
        if not 1e-12 < unknown < 1:
            return (c + 0.5) / (self.N + 0.5 * (len(self.vocab) + 1))
        return d[min(c, 6)] * c / self.N if c else unknown

    def p(self, w, h):
        if not h:
            return self.unigram(w)
        n = len(h) + 1
        total = self.context[n][h]
        if not total:
            return self.p(w, h[1:])
        seen = {g[-1]: c for g, c in self.counts[n].items() if g[:-1] == h}
        d = self.d[n]
        kept = sum(d[min(c, 6)] * c for c in seen.values())
        scale = 1 / total if total - kept > 1e-9 * total else 1 / (total + 1)
        if w in seen:
            return d[min(seen[w], 6)] * seen[w] * scale
        return (1 - kept * scale) / (1 - sum(self.p(x, h[1:]) for x in seen)) * self.p(w, h[1:])

    def score(self, text):
        seq = [b"<"] + (text or "").encode().lower().split() + [b" >"]
        return sum(math.log10(self.p(seq[i], tuple(seq[max(0, i - self.order + 1) : i]))) for i in range(1, len(seq)))


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block", [20, 2_000_000])
def test_equals_plain_model(spark, order, block):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    got = katz.katz_scores(df, order=order, block_tokens=block, part_tokens=block).toPandas()
    assert len(got) == len(TEXTS)
    model = Plain([t for d, t in TEXTS if not held_out(d)], order)
    want = sorted((str(d), len((t or "").encode().split()) + 1, round(model.score(t), 6)) for d, t in TEXTS)
    have = sorted((str(int(r.doc_id)) if r.doc_id == r.doc_id else "None", r.n_tokens, round(r.score, 6)) for r in got.itertuples())
    assert have == want
    assert set(got.train_tokens) == {model.N}
    for r in got.itertuples():
        if r.doc_id == r.doc_id and r.doc_id != 7:
            text = dict(TEXTS)[r.doc_id]
            w = [*(text or "").encode().lower().split(), b" >"]
            assert r.n_known == sum(model.counts[1][(x,)] > 0 for x in w)
            assert math.isclose(r.base_score, sum(math.log10((model.counts[1][(x,)] + 0.5) / (model.N + 0.5 * (len(model.vocab) + 1))) for x in w), rel_tol=1e-9)
            assert r.held_out == held_out(int(r.doc_id))


def test_a_task_of_several_partitions_keeps_blocks_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "files", lambda df: 1)
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(6)
    model = Plain([t for d, t in TEXTS if not held_out(d)], 2)
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in katz.katz_scores(df).collect())
    assert got == sorted((str(d), round(model.score(t), 6)) for d, t in TEXTS)


@pytest.mark.parametrize("order", [2, 3])
def test_count_tables_hold_all_ngrams(spark, order):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    _, levels, _, _ = katz.model(df, order=order, block_tokens=30, part_tokens=25)
    plain = Plain([t for d, t in TEXTS if not held_out(d)], order)
    words = {r.word: r.key for r in katz.count_table(levels[0]).collect()}
    for n, level in enumerate(levels, 1):
        got = katz.count_table(level).collect()
        want = dict(plain.counts[n])
        if n == 1:
            assert {r.word for r in got} == words.keys()
            want[(b"<",)] = sum(not held_out(d) for d, _ in TEXTS)
        assert sorted(r["count"] for r in got) == sorted(want.values()) and (n == 1 or all(r.word in words for r in got))


def test_each_context_sums_to_one():
    model = Plain([t for d, t in TEXTS if not held_out(d)], 3)
    for h in [(), *list(model.context[2])[:8], *list(model.context[3])[:8]]:
        assert math.isclose(sum(model.p(w, h) for w in [*model.vocab, b" unknown"]), 1, rel_tol=1e-9)


def test_empty_and_untrained(spark):
    assert katz.katz_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = next(i for i in range(100) if held_out(i))
    row = katz.katz_scores(spark.createDataFrame([(one, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out) == (3, 0, 0, True)
    assert math.isfinite(row.score) and math.isfinite(row.base_score)
