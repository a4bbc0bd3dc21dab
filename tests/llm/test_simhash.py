"""SimHash near-dedup against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphspark.llm import simhash
from glyphspark.llm.common import Scratch


def plain_print(text, k=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) > k else [b" ".join(w)] if w else []
    if not sh:
        return 0
    n = [0] * 64
    for x in sh:
        h = xxhash.xxh64_intdigest(x, 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(sh))


def plain_components(items, radius):
    """items: (doc_id, fingerprint)."""
    root = {}
    prints = sorted({f for _, f in items})
    seen, comp = set(), {}
    for f in prints:
        if f in seen:
            continue
        stack, group = [f], []
        seen.add(f)
        while stack:
            x = stack.pop()
            group.append(x)
            for y in prints:
                if y not in seen and (x ^ y).bit_count() <= radius:
                    seen.add(y)
                    stack.append(y)
        ids = [d for d, p in items if p in set(group) and d is not None]
        for x in group:
            comp[x] = min(ids) if ids else None
    return root | comp


def test_fingerprint_hash_is_sparks(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)
    for t in [None, "", "one", "One TWO", "a b c", "a b c d", "é É ß x y z a b", "x " * 900]:
        assert simhash.fingerprint(t.encode() if t is not None else None) == plain_print(t)


@pytest.mark.parametrize("width,radius,size,bucket", [(32, 3, 1, 4096), (16, 3, 0, 4096), (32, 5, 2, 4096), (16, 9, 2, 4096), (32, 3, 1, 2), (16, 3, 0, 3), (16, 9, 2, 5)])
def test_components_equal_brute_force(spark, monkeypatch, width, radius, size, bucket):
    if bucket < 10:
        monkeypatch.setattr(simhash, "PROBES", 4)
    rng = random.Random(width * 10 + radius)
    prints = [rng.getrandbits(64) for _ in range(60)] + [0]
    for _ in range(300):
        p = rng.choice(prints)
        for _ in range(rng.randint(1, radius + 2)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    chain = 12345
    for i in range(40):
        chain ^= ((1 << radius) - 1) << i * radius % 54
        prints.append(chain)
    items = list(enumerate(prints)) + [(1000 + i, prints[5]) for i in range(30)]
    rng.shuffle(items)
    signed = lambda p: p - 2**64 if p >> 63 else p
    one = spark.createDataFrame([(signed(p), p.to_bytes(8, "big"), p.to_bytes(8, "big")) for p in set(prints)], "id long, index binary, verify binary").repartition(4)
    scratch = Scratch(spark, "t")
    roots = {r.node: r.root for r in simhash.components(scratch.keep(simhash.links(one, radius, width, 64 // width, size, bucket), "l"), scratch).collect()}
    want = plain_components(items, radius)
    groups = {}
    for p in set(prints):
        groups.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ({p for p in set(prints) if want[p] == c} for c in set(want.values()))))


@pytest.mark.parametrize("bucket", [7, 64, 2048])
def test_forest_spans_all_links(monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    for n in (1, 2, 3, 40, 200):
        base = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
        prints = []
        for _ in range(n):
            p = rng.choice(base)
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints.append(p)
        probe = np.array([rng.random() < 0.3 for _ in range(n)])
        edges = simhash.forest(np.array(prints, np.uint64)[:, None], probe, 3)
        allowed = {(i, j) for i in range(n) for j in range(n) if i != j and not (probe[i] and probe[j]) and (prints[i] ^ prints[j]).bit_count() <= 3}
        assert all(e in allowed for e in edges)

        def classes(pairs):
            up = list(range(n))
            for i, j in pairs:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
            return up

        assert classes(edges) == classes(allowed) and len(edges) == n - len(set(classes(allowed)))


def test_documents(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 200)))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " tail") for i in range(150)]
    rows += [(400 + i, None if i % 2 else " \t") for i in range(6)] + [(None, rows[3][1]), (7, rows[9][1]), (500, "X " * 20000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, fp string, component_id string")
    got = simhash.near_duplicates(df).collect()
    items = [(d, plain_print(t)) for d, t in rows]
    want = plain_components(items, 3)
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == sorted((str(d), p, want[p]) for d, p in items)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_half_a_ball_meets_every_neighbour():
    masks = simhash.ball(8, 2)
    low = masks & (~masks + np.uint64(1))
    for a in range(256):
        for m, lowest in zip(masks.tolist(), low.tolist()):
            b = a ^ m
            assert (a & lowest == 0) + (b & lowest == 0) == (2 if m == 0 else 1)


def test_incomplete_search_is_refused(spark):
    with pytest.raises(ValueError, match="miss"):
        simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), radius=4)


def shingles(text, k=5):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_similar_groups(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    rows, pairs = [], []
    for i in range(200):
        w = rng.choices(vocab, k=rng.randint(80, 400))
        rows.append((2 * i, " ".join(w)))
        for j in rng.sample(range(len(w)), max(1, len(w) // 60)):
            w[j] = rng.choice(vocab)
        rows.append((2 * i + 1, " ".join(w)))
        pairs.append((2 * i, jaccard(*[t for _, t in rows[-2:]])))
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (5, "other text of a repeated id"), (None, "alone without an id")]
    got = {r.first: r.component_id for r in simhash.similar_groups(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, id string")).collect()}
    near = [d for d, j in pairs if j >= 0.8]
    assert len(near) > 100 and sum(got[d + 1] == d for d in near) / len(near) > 0.93
    assert all(got[d] in (d, 4) for d, _ in pairs) and got[1000] == 1000 and 1001 not in got and got[None] is None
    assert simhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_with_a_block_changed_are_joined(spark):
    rng = random.Random(8)
    made = lambda n: rng.choices(["v%d" % i for i in range(5000)], k=n)
    rows, pairs = [], []
    for i in range(180):
        w = made(300)
        cut = [w[:245], w + made(60), w[:120] + made(25) + w[145:]][i % 3]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(cut))]
        pairs.append((2 * i, jaccard(rows[-2][1], rows[-1][1])))
    got = {r.first: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(0.8 <= j < 0.84 for _, j in pairs)
    assert all(got[d] == got[d + 1] == d for d, _ in pairs)


def test_texts_below_the_similarity_are_not_joined(spark):
    rng = random.Random(9)
    made = lambda n: rng.choices(["v%d" % i for i in range(5000)], k=n)
    line, rows = " ".join(made(12)), []
    for i in range(60):  # one line over and over, else unrelated
        rows.append((i, " ".join([" ".join(made(10)) if j % 3 == 0 else line for j in range(30)])))
    for i in range(60):
        w = made(300)
        rows += [(100 + 2 * i, " ".join(w)), (101 + 2 * i, " ".join(w[: 230 + i % 5]))]
    assert max(jaccard(rows[0][1], rows[i][1]) for i in range(1, 60)) < 0.2 and all(0.7 < jaccard(rows[i][1], rows[i + 1][1]) < 0.8 for i in range(60, 180, 2))
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 180 and all(r.component_id == r.first and r.kept for r in got)


def test_groups_equal_brute_force(spark):
    rng = random.Random(10)
    base, rows = [["v%d" % rng.randrange(400) for _ in range(rng.randint(3, 90))] for _ in range(12)], []
    for i in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "v%d" % rng.randrange(400)
        rows.append((i, " ".join(w[rng.randint(0, 2) :])))
    root = list(range(240))
    for i in range(240):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8 and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert 12 < len(set(root)) < 200
    assert all(r.component_id == root[r.first] for r in got) and sum(r.kept for r in got) == len(set(root))


def test_similar_groups_come_from_fingerprints_checked_by_sets(spark, monkeypatch):
    rng = random.Random(11)
    made = lambda n: rng.choices(["v%d" % i for i in range(5000)], k=n)
    line, rows, linked = " ".join(made(12)), [], []
    for i in range(60):
        w = made(300)
        at = rng.randrange(300)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:at], "changed", *w[at + 1 :]]))]
        a, b = (plain_print(t) for _, t in rows[-2:])
        linked += [2 * i] if (a ^ b).bit_count() <= 3 else []
    # one line over and over, else unrelated: fingerprints link these, their sets don't
    rows += [(200 + i, " ".join([" ".join(made(6)), *[line] * 60])) for i in range(20)]
    rows += [(300, "A b"), (301, " a  B")]
    # the complete search finds no pair here, so that what is joined is joined by fingerprints
    monkeypatch.setattr("glyphspark.llm.jaccard._can", lambda *_: "false")
    got = {r.first: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 30 < len(linked) and all(got[d + 1] == d for d in linked)
    assert all(got[d + 1] == d + 1 for d in range(0, 120, 2) if d not in linked)
    hot = [(d, t) for d, t in rows if 200 <= d < 220]
    assert len(set(plain_components([(d, plain_print(t)) for d, t in hot], 3).values())) < 10
    assert all(jaccard(t, u) < 0.8 for _, t in hot for _, u in hot if t != u) and all(got[d] == d for d, _ in hot)
    assert got[300] == 300 and 301 not in got
