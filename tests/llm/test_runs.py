"""Periodic runs against a plain search, and edge cases."""

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from glyphspark.llm import runs
from glyphspark.llm.queries import QUERIES

D = "/root/testdata/sf0.001"


def plain(w, least=6, times=4):
    """All runs of a list of words, lag by lag and word by word."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            part = w[s : i + q]
            if len(part) >= max(least, times * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant=True):
    w = [x.decode() for x in (text or "").encode().split()]
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if plant and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain(w)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    left = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, n, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(left.encode()).hexdigest())


def repeated(rng, n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a, p = rng.randrange(n), rng.randint(1, 9)
        for i in range(a + p, min(n, a + rng.randint(0, 70))):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("places", [1, 64, runs.PLACES])
def test_runs_equal_a_plain_search(monkeypatch, places):
    monkeypatch.setattr(runs, "PLACES", places)
    rng = random.Random(places)
    for _ in range(600):
        w = repeated(rng, rng.randint(0, 110), rng.choice([1, 2, 2, 3, 5, 40]))
        assert [tuple(r) for r in runs.runs_of(np.array(w, np.int32)).tolist()] == plain(w), w


def test_other_limits_equal_a_plain_search():
    rng = random.Random(5)
    for least, times in ((1, 3), (20, 3), (6, 5), (12, 6)):
        for _ in range(150):
            w = repeated(rng, rng.randint(0, 90), rng.choice([1, 2, 3]))
            assert [tuple(r) for r in runs.runs_of(np.array(w, np.int32), least, times).tolist()] == plain(w, least, times)
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(9, np.int32), 2, 2)


def test_stretches_are_whole():
    for w in ([0] * 9, [0, 1] * 6, [1, 2, 3] * 5 + [4]):
        ids = np.array(w, np.int32)
        for lag in range(1, len(w)):
            same = "".join(" x"[w[i] == w[i + lag]] for i in range(len(w) - lag))
            for least in (1, 2, 3, 5):
                at, length = runs.stretches(runs.planes(ids), len(w), lag, least)
                assert list(zip(at, length, strict=True)) == [(m.start(), len(m[0])) for m in re.finditer("x+", same) if len(m[0]) >= least]


def test_a_long_text_of_one_word_and_of_one_period():
    assert runs.runs_of(np.zeros(300_000, np.int32)).tolist() == [[0, 300_000, 1]]
    assert runs.runs_of(np.tile(np.arange(999, dtype=np.int32), 200)).tolist() == [[0, 199_800, 999]]


def test_numbered_parts(monkeypatch):
    monkeypatch.setattr(runs, "PART", 3)
    text = "  aa b\taa ccccccc\n\x0b b aa é漢 x ".encode()
    ids, words = runs.numbered(text)
    assert [words[i] for i in ids] == text.split() and runs.numbered(None)[0].tolist() == []


EDGE = [(None, "a b " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "go go go go go go"), (4, "go go go go go go"), (5, "x y " * 3000), (6, "a b a b a b a c c c c c c c"), (7, "Go go GO go Go go GO go " * 4), (8, "é 漢 " * 8 + "x")]
EDGE += [(i, " ".join(f"w{j % 37}" for j in range(i % 90))) for i in range(10, 120)]


def test_periodic_runs_equal_plain_rows(spark):
    schema = "doc_id long, text string, start string, period int, n_runs double"
    frame = spark.createDataFrame([(d, t, "clash", 1, 0.5) for d, t in EDGE], schema)
    for plant in (True, False):
        got = runs.periodic_runs(frame, plant=plant).collect()
        assert sorted(map(tuple, got), key=repr) == sorted((plain_row(d, t, plant) for d, t in EDGE), key=repr)
    assert runs.periodic_runs(spark.createDataFrame([], schema)).count() == 0


def test_query_equals_plain_rows(spark):
    got = QUERIES["op11_periodic_runs"](spark, D)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    want = [plain_row(d, t) for d, t in docs]
    assert sorted(map(tuple, got.collect())) == sorted((r[0], *r[2:]) for r in want)
    assert sum(r[2] > 0 for r in want) > 5


def test_collapsed_documents(spark):
    frame = spark.createDataFrame([(1, "keep  this\tas is", "s"), (2, "so so so so so so it goes", "s"), (3, None, None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, runs.collapsed_documents(frame).collect())) == [(1, "keep  this\tas is", "s"), (2, "so it goes", "s"), (3, None, None)]
