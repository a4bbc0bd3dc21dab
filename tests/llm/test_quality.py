"""The classifier: gradients, held-out accuracy, and edge cases."""

import numpy as np
import pytest

from glyphspark.llm import quality
from glyphspark.llm.queries import QUERIES


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    m = quality.Model()
    x, sizes, y, w = rng.random((7, quality.WIDTH)), np.array([3, 1, 3]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        f = m.attend(m.encode(x), np.array([0, 3, 4]), sizes)
        p = quality._sigmoid(f["logit"])
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    for k, g in m.gradients(x, sizes, y, w).items():
        for at in list(np.ndindex(m.p[k].shape))[:: max(1, m.p[k].size // 7)]:
            old, e = m.p[k][at], 1e-5
            m.p[k][at] = old + e
            up = loss()
            m.p[k][at] = old - e
            down = loss()
            m.p[k][at] = old
            assert (up - down) / (2 * e) == pytest.approx(g[at], rel=1e-4, abs=1e-8)


def test_whole_text_counts():
    text = ("Ab é|1!" * 700).encode()
    got = quality.counts(text)
    assert got[:, -1].sum() == len(text) and got[:, : quality.PAIRS].sum() == len(text) - 1 and got[:, quality.PAIRS : -1].sum() == len(text) - 2
    m = quality.Model()
    assert m.explain(text)[0] == pytest.approx(m.scores([b"", text, b"x"])[1])
    assert m.explain(text)[1].sum() == pytest.approx(1)


def plain_score(m, text):
    """The score of one text, passage by passage and byte by byte."""
    lower, passages = text.lower(), []
    for start in range(0, max(1, len(text)), quality.PASSAGE):
        end = min(start + quality.PASSAGE, len(text))
        n = np.zeros(quality.WIDTH)
        for i in range(start, end):
            if i + 1 < len(text):
                n[quality.TABLE[text[i]] * quality.CLASSES + quality.TABLE[text[i + 1]]] += 1
            if i + 2 < len(text):
                h = (lower[i] * 65536 + lower[i + 1] * 256 + lower[i + 2]) * 2654435761 % 2**32 >> 23
                n[quality.PAIRS + h] += 1
        x = np.sqrt(n / max(end - start, 1))
        x[-1] = np.log2(1 + end - start) / np.log2(1 + quality.PASSAGE)
        passages.append(np.tanh(x @ m.p["W"] + m.p["b"]))
    e = [np.exp((np.tanh(h @ m.p["V"]) / (1 + np.exp(-h @ m.p["U"]))) @ m.p["w"]) for h in passages]
    z = sum(w / sum(e) * h for w, h in zip(e, passages))
    return 1 / (1 + np.exp(-(z @ m.p["c"] + m.p["c0"][0])))


def test_scores_equal_a_plain_computation():
    rng = np.random.default_rng(5)
    m = quality.Model(seed=3)
    texts = [b"", b"x", b"ab", b"Some WORDS, in a row.\n" * 100, bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), "é漢 ß|".encode() * 300]
    got = m.scores(texts)
    assert got == pytest.approx([plain_score(m, t) for t in texts], abs=1e-5)
    assert len(set(got.round(6))) == len(texts)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op4_quality_mil"](spark, d).toPandas()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    right = held.predicted == held.quality
    assert len(held) > 1000 and right.mean() > 0.97
    assert right[held.quality == 0].mean() > 0.95


def test_edges(spark):
    good = [(i, "Plain words in a row, with a stop. " * (i % 5 + 1), "x") for i in range(30)]
    bad = [(100 + i, "BAD!! $$$ ### " * (i % 7 + 1), "y") for i in range(30)]
    odd = [(200, None, None), (201, "", None), (None, "no id", None), (5, good[5][1], "x"), (202, "Plain words in a row. " * 20000 + "$$$", None)]
    docs = spark.createDataFrame([(*r, 1.5, "clash") for r in good + bad + odd], "doc_id long, text string, source string, score double, label string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(5, 1), (7, None), (None, 0), (999, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert all(by[i] for i in range(30)) and not any(by[100 + i] for i in range(30)) and by[202]
    kept = quality.filter_documents(docs, model)
    assert kept.columns == docs.columns and {100 + i for i in range(30)}.isdisjoint({r.doc_id for r in kept.collect()})
    assert quality.score(docs.limit(0), model).count() == 0
    one = quality.train(docs, labels.where("quality = 1"))
    assert one.constant > 0.9 and quality.score(docs, one).first().score == one.constant
    assert quality.train(docs, labels.limit(0)).constant == 0.5


def test_every_passage_of_the_sample_teaches(spark, monkeypatch):
    texts = {0: "Plain words. " * 3000, 1: "", 2: "BAD!! " * 7000, 3: "x" * 512, 4: "y" * 513, 5: "Plain words. " * 90_000}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in texts], "doc_id long, quality int")
    seen = {}

    def fit(self, bags, y, **_):
        seen.update(sizes=sorted(len(b) for b in bags), n=sum(int(b[:, -1].sum()) for b in bags), bags=bags)
        return self

    monkeypatch.setattr(quality.Model, "fit", fit)
    from pyspark.sql import functions as F

    quality.train(docs, labels, F.lit(True))
    assert seen["sizes"] == sorted(max(1, -(-len(t) // 512)) for t in texts.values()) and seen["n"] == sum(map(len, texts.values()))
    quality.train(docs, labels, F.lit(True), passages=100)
    assert all(n <= 100 for n in seen["sizes"]) and len(seen["sizes"]) >= 4
    assert quality.chosen([(1, 0, 60), (2, 1, 101), (3, 0, 50), (4, 0, 40), (5, 1, 100)], 100) == [1, 4, 5]
    assert (quality._whole(texts[5].encode())[976] == quality.counts(texts[5].encode()[976 * 512 :][: quality.CHUNK])[0]).all()
