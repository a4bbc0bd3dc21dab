"""Ranked search against scoring every document, and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from glyphspark.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """Rows (item_id, rank, doc_id, score) by scoring every document."""
    counted = [(d, Counter(t)) for d, t in ((d, plain_terms(t)) for d, t in docs) if t]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item_id, text in dict.fromkeys(items):
        rows = []
        for d, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(weight[w] * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in plain_terms(text) if w in c)
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(item_id, i + 1, None if lost else d, -s) for i, (s, lost, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def test_terms():
    for text in ("", "Ab1 c-d_e f\x7fg\x00h É漢x @[`{", "ÀÉ İK ", "a" * 5000):
        assert [t.decode() for t in ranked.terms(text.encode())] == plain_terms(text), text
    every = "".join(map(chr, range(0x300)))
    assert [t.decode() for t in ranked.terms(every.encode())] == plain_terms(every)


def lists_of(rng, docs, n):
    out = []
    for _ in range(n):
        doc = np.flatnonzero(rng.random(docs) < rng.choice([0.02, 0.3, 0.9]))
        if len(doc):
            score = rng.integers(1, rng.choice([3, 50, 2000]), len(doc))
            out.append((int(score.max()), doc, score))
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("k", [1, 3, 10])
def test_max_score_finds_all_that_qualify(k):
    rng = np.random.default_rng(k)
    met = whole = 0
    for _ in range(400):
        docs = int(rng.integers(1, 60))
        lists = lists_of(rng, docs, int(rng.integers(0, 7)))
        total = np.zeros(docs, np.int64)
        for _, doc, score in lists:
            total[doc] += score
        least = int(rng.choice([1, 5, 60, 1500]))
        can, scores, n = ranked.max_score(lists, docs, k, least)
        assert (scores == total[can]).all() and len(set(can.tolist())) == len(can)
        kth = max(least, int(np.sort(total)[::-1][k - 1]) if docs >= k else 0)
        assert set(np.flatnonzero(total >= kth).tolist()) <= set(can.tolist())
        met, whole = met + n, whole + sum(len(x[1]) for x in lists)
    assert met < 0.8 * whole


def test_index_survives_packing():
    index = ranked.Index(np.array([5, 0]), np.array([False, True]), np.array([3, 9]), np.array([4, 1, 4]), np.array([1, 0, 0]), np.array([2, 7, 1]))
    again = ranked.Index.unpacked(index.packed())
    assert again.ids.tolist() == [1, 4] and again.doc.tolist() == [0, 0, 1] and again.tf.tolist() == [7, 1, 2] and again.upto.tolist() == [0, 1, 3] and again.lost.tolist() == [False, True]


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, score string, rank int"), spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda size: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=size))
    docs = [(i, text(rng.randint(0, 30))) for i in range(n)]
    docs += docs[: n // 5] + [(n + i, docs[i % 7][1]) for i in range(n // 5)] + [(None, docs[3][1]), (None, "w1 w1"), (7000, None), (7001, ""), (7002, "?! --"), (7003, "w2 " * 4000)]
    return docs, [(i, text(rng.randint(1, 12))) for i in range(12)] + [(90, None), (91, ""), (92, "nowhere"), (0, "w3 w3 w5"), (None, "w4"), (93, "W5, w5; w5")]


@pytest.mark.parametrize(("docs_a_shard", "postings", "block"), [(4096, 1 << 20, 16 << 20), (5, 1 << 20, 60), (4096, 9, 1)])
def test_search_equals_scoring_all(spark, monkeypatch, docs_a_shard, postings, block):
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "DOCS", docs_a_shard)
    monkeypatch.setattr(ranked, "POSTINGS", postings)
    docs, items = made(docs_a_shard, 60)
    items = items if block > 1 else items[:3]
    items += items[:2]
    got = ranked.search(*frames(spark, docs, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = made(1, 10)
    for a, b in (([], items[:2]), (docs, []), ([], []), ([(1, None)], items[:2])):
        assert ranked.search(*frames(spark, a, b)).count() == 0
