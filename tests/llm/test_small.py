"""Small cases of the operators that SQL can't express, against brute force, and edge cases of all."""

import hashlib
import itertools
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphspark.llm import chat, mixing, packing, simhash, trie_tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, bin_id string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 1, "clash", 7, "clash") for d, t, s in rows], DOCS)


EDGE = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one two three", "b"), (4, "one two three", "b"), (5, "x " * 5000, "b"), (6, "ONE  two\nthree", None), (None, "lost id", "a"), (7, "é漢 ß", "b")]


# token counts -----------------------------------------------------------------
def brute(v, word):
    text = v.mark + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        c = text[end - 1]
        options = [(best[end - 1][0] + v.unknown, best[end - 1][1] + len(c.encode()))]
        options += [(best[b][0] + v.pieces[text[b:end]], best[b][1] + 1) for b in range(end) if text[b:end] in v.pieces]
        best.append(max(options, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


def test_token_counts(spark):
    v = trie_tokens.Vocabulary.load()
    got = {(r.doc_id, r.n_pretokens): r.n_tokens for r in trie_tokens.token_counts(docs(spark, EDGE), cache=2).collect()}
    for d, t, _ in EDGE:
        w = [x.decode() for x in (t or "").encode().split()]
        assert got[d, len(w)] == sum(brute(v, x) for x in w), t
    assert trie_tokens.token_counts(docs(spark, [])).count() == 0


def test_a_worker_keeps_its_trie_for_many_tasks(spark, tmp_path):
    from glyphspark.llm.trie_tokens import TrieCounter

    folder, words = str(tmp_path), "one two three"

    class Noted(TrieCounter):
        def insert(self, found):
            import os
            import uuid

            new = sum(w not in self.terminals for w in found)
            super().insert(found)
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{os.getpid()} {new}")

    real = trie_tokens.TrieCounter
    trie_tokens.TrieCounter = Noted
    try:
        rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(words).alias("text")).repartition(25)
        assert trie_tokens.token_counts(rows).count() == 200
    finally:
        trie_tokens.TrieCounter = real
    notes = [p.read_text().split() for p in tmp_path.iterdir()]
    workers = {pid for pid, _ in notes}
    # each worker walks the three words once, whichever of its tasks comes first
    assert len(notes) >= 25 > len(workers) and sum(int(n) for _, n in notes) == 3 * len(workers)


def test_token_counts_equal_public_unigram_model():
    from tokenizers import Tokenizer, models

    v = trie_tokens.Vocabulary({"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.6, "ab": -3.1, "▁ab": -4.0, "ba": -4.7, "c": -5.0, "abc": -6.5, "bc": -5.1}, "▁")
    model = Tokenizer(models.Unigram([("<unk>", -20.0), *v.pieces.items()], 0, False))
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("abc", repeat=n)]
    counter = trie_tokens.TrieCounter(v)
    counter.insert({w.encode() for w in words})
    for w in words:
        assert counter.terminals[w.encode()] == len(model.encode("▁" + w).ids), w
    # each shared prefix is one node, besides the mark
    assert counter.nodes == len({w[:i] for w in words for i in range(1, len(w) + 1)}) + 1


def test_loaded_vocabulary_has_unigram_scores():
    import math

    import sentencepiece
    from tokenizers import Tokenizer, models

    v = trie_tokens.Vocabulary.load()
    assert math.fsum(math.exp(s) for s in v.pieces.values()) == pytest.approx(1)
    counter = trie_tokens.TrieCounter(v)
    common = b"the of and to in is that for was with international understanding quickly government".split()
    texts = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.dropna()
    words = pd.Series([w for t in texts for w in t.encode().split()]).value_counts()
    counter.insert({*common, *words.index})
    assert [counter.terminals[w] for w in common] == [1] * len(common)
    # the same best segmentations as a public unigram encoder, where pieces cover the word
    model = Tokenizer(models.Unigram([("<unk>", -99.0), *v.pieces.items()], 0, False))
    covered = [w for w in words.index if all(c in v.pieces for c in w.decode())]
    assert len(covered) > 2000
    # of equal sums either may be taken, so that a count may be one more
    equal = [counter.terminals[w] == len(model.encode(v.mark + w.decode()).ids) for w in covered]
    assert sum(equal) / len(equal) > 0.999
    # and mostly as many pieces as the file's own merges make
    own = sentencepiece.SentencePieceProcessor(model_file=trie_tokens.VOCABULARY)
    assert sum(n for w, n in words.items() if counter.terminals[w] == len(own.encode(w.decode()))) / words.sum() > 0.95


# archive ----------------------------------------------------------------------
def test_archive_round_trip(spark):
    big, other = "p" * 1000, "é" * 500
    rows = [(1, "u1", big), (2, "u2\r\nWARC-Type: revisit", big), (3, None, other), (9, "u9", other), (9, "u9b", other), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (None, "u0", big), (7, "u7", "WARC-Type: revisit\r\n\r\nx" * 50), (8, "u8", " WARC/1.1\x00")]
    pages = spark.createDataFrame([(*r, "clash", b"x") for r in rows], "page_id long, url string, html string, digest string, payload binary")
    headers, payloads = warc.write(pages)
    assert payloads.count() == len({h or "" for _, _, h in rows})
    got = sorted(warc.read(warc.records(headers, payloads)).collect(), key=lambda r: (r.page_id or 0, r.url))
    assert len(got) == len(rows)
    kinds = [(r.page_id, r.record_type, r.refers_to) for r in got]
    assert kinds == [(None, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "revisit", 9), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (9, "revisit", 9), (9, "response", None)]
    for r in got:
        html = {p: h for p, _, h in rows}[r.page_id] or ""
        assert (r.payload_digest, r.payload_bytes) == (hashlib.sha1(html.encode()).hexdigest(), len(html.encode()))
    raw = warc.export(warc.records(headers, payloads).where("page_id = 4"))
    head, _, block = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\n") and b"Content-Length: 5" in head and block == b"short\r\n\r\n"
    assert warc.repeats(spark, payloads, 1).first().records == 3
    bad = payloads.withColumn("payload", F.lit("x").cast("binary"))
    with pytest.raises(Exception, match="does not match"):
        warc.read(warc.records(headers, bad)).collect()
    lost = warc.records(headers, payloads.limit(0)).where("page_id = 2")
    with pytest.raises(Exception, match="does not match"):
        warc.read(lost).collect()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_of_one_digest_stay_apart(spark):
    same = lambda c: F.lit("0" * 40)
    rows = [(1, "u", "a" * 1000), (2, "u", "b" * 1000), (3, "u", "a" * 1000), (4, "u", "short"), (5, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    headers, payloads = warc.write(pages, digest=same)
    found = warc.records(headers, payloads)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(found, digest=same).collect()}
    assert got == {1: ("revisit", 3), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None)}
    blocks = {r.page_id: bytes(r.record).partition(b"\r\n\r\n")[2][:-4].decode() for r in found.collect()}
    assert blocks == {1: "", 2: "b" * 1000, 3: "a" * 1000, 4: "short", 5: "other"}
    # payloads exchanged under their common digest are found by the other one
    swapped = payloads.withColumn("payload", F.when(F.col("bytes") == 5, F.lit("mixed").cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="does not match"):
        warc.read(warc.records(headers, swapped), digest=same).collect()


def test_records_of_a_common_small_payload_are_shared_out(spark):
    rows = [(i, f"u{i}", "tiny" if i % 3 else f"own {i}") for i in range(300)] + [(1000 + i, "u", "p" * 1200) for i in range(50)]
    headers, payloads = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    copies = warc._copies(payloads, warc.MIN_REVISIT, 10).collect()
    assert [(r.bytes, r.copies) for r in copies] == [(4, 6)]  # 200 records in shares of a tenth of 350
    for share in (1, 10, 1_000):
        found = warc.records(headers, payloads, share=share)
        got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.read(found).collect()}
        assert found.count() == len(rows) and got == {p: (len(h), "revisit" if 1000 <= p < 1049 else "response") for p, _, h in rows}


# mixing -----------------------------------------------------------------------
def test_fit_is_near_and_within_counts():
    rng = random.Random(3)
    for _ in range(200):
        lengths = rng.sample(range(1, 60), rng.randint(1, 8))
        counts = [rng.randint(1, 9) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randint(0, total + 5)
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        got = sum(t * n for t, n in zip(take, lengths))
        reach = {0}
        for n, c in zip(lengths, counts):
            reach = {r + n * k for r in reach for k in range(c + 1)}
        assert got <= budget
        if budget <= 3 * max(lengths):
            assert got == max(r for r in reach if r <= budget)
        assert budget - got < max(lengths) or got == total


def test_fit_with_very_long_texts_is_small_and_near():
    import tracemalloc

    # even lengths and an odd budget: no sum is exact, so every item is tried
    rng = random.Random(3)
    lengths = sorted({2 * rng.randint(1, 200_000) for _ in range(300)} | {400_000})
    counts = [rng.randint(1, 4) for _ in lengths]
    tracemalloc.start()
    take = mixing.fit(lengths, counts, 20_000_001)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    total = sum(n * t for n, t in zip(lengths, take, strict=True))
    assert total == 20_000_000 and all(0 <= t <= c for t, c in zip(take, counts, strict=True))
    # some hundred items of 150 kB each would be more
    assert most < 40_000_000


def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(spark):
    rng = random.Random(5)
    rows = [*EDGE, *((100 + i, "w " * rng.randint(1, 30), rng.choice(["a", "b", "c", "ü", "z", None])) for i in range(400)), *((1000 + i, "same text here", "a") for i in range(300))]
    table = docs(spark, rows)
    a, b = (mixing.mix(table.repartition(n)).toPandas() for n in (2, 5))
    key = ["doc_id", "size", "taken"]
    pd.testing.assert_frame_equal(a[key].sort_values(key).reset_index(drop=True), b[key].sort_values(key).reset_index(drop=True))
    assert len(a) == len(rows)
    sizes, by_id = {}, {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
        by_id[d] = s
    want = plain_targets(sizes)
    a["source"] = [by_id[None if d != d else int(d)] for d in a.doc_id]
    assert (a.taken <= 2 * a["size"]).all() and (a.taken % a["size"].clip(lower=1) == 0).all()
    for s, size in sizes.items():
        own = a[[x == s for x in a.source]]
        assert set(own.source_size) == {size}
        assert own.target.tolist() == pytest.approx([want[s]] * len(own))
        assert abs(own.taken.sum() - want[s]) <= 1
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, "a")])).first().taken == 0


def test_mix_cuts_through_rows_that_are_alike(spark):
    # one row repeated, texts of one doc_id and length, and others of that length
    rows = [*[(1, "a b c", "s")] * 60, *[(2, f"t{i} u v", "s") for i in range(30)], *[(None, "x y z", "s")] * 20, *[(9 + i, "k l m", "s") for i in range(40)], *[(100 + i, "w " * 200, "t") for i in range(10)]]
    table = docs(spark, rows)
    taken = mixing.mix(table)
    assert taken.count() == len(rows)
    by_size = {r.size: (r.taken, r.target) for r in taken.groupBy("size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(t - want) < 200 for t, want in by_size.values()) and abs(by_size[3][0] - by_size[3][1]) < 3
    back = mixing.mixed_documents(table)
    assert back.columns == table.columns
    n = {(r.doc_id, r.text): r["count"] for r in back.groupBy("doc_id", "text").count().collect()}
    assert sum(len(t.split()) * c for (_, t), c in n.items()) == taken.agg(F.sum("taken")).first()[0]
    times = {d: sum(c for (e, _), c in n.items() if e == d) for d in (1, 2, None)}
    assert times == {d: taken.where(F.col("doc_id").eqNullSafe(d)).agg(F.sum(F.col("taken") / 3)).first()[0] for d in times}


# packing ----------------------------------------------------------------------
def test_successor_search_finds_the_tightest_compatible_bin():
    rng = random.Random(8)
    bins = packing.Bins(50, 5, 70)
    held = []  # residual, sources, clusters
    for _ in range(600):
        length, s, c = rng.randint(1, 30), rng.randint(-1, 4), rng.randint(-1, 69)
        fits = [b for b in held if b[0] >= length and s not in b[1] and c not in b[2]]
        own, place = bins.put(length, s, c)
        if fits:
            assert held[own][0] == min(b[0] for b in fits) and s not in held[own][1] and c not in held[own][2]
        else:
            assert own == len(held)
            held.append([50, set(), set()])
        assert place == 50 - held[own][0]
        held[own][0] -= length
        held[own][1] |= {s} - {-1}
        held[own][2] |= {c} - {-1}


@pytest.mark.parametrize("one_per_source", [True, False])
def test_packing(spark, one_per_source):
    rows = [*EDGE, *((50 + i, " ".join(f"w{i}x{j}" for j in range(i % 37 + 1)), f"s{i % 9}") for i in range(500)), *((900 + i, "a copy", "b") for i in range(40))]
    placed = packing.pack_documents(docs(spark, rows), capacity=64, shard_rows=200, one_per_source=one_per_source).toPandas()
    whole = placed.groupby("doc_id", dropna=False)["length"].sum()
    for d, t, _ in rows:
        n = len((t or "").encode().split()) * (2 if d == 4 else 1)
        assert whole[d if d is not None else float("nan")] == n if d is not None else True
    assert placed[placed["size"] == 0].bin_id.isna().all() and placed[placed["size"] > 0].bin_id.notna().all()
    full = placed[placed.bin_id.notna()]
    for _, b in full.groupby("bin_id"):
        assert b.length.sum() == b.fill.iloc[0] <= 64
        b = b.sort_values("place")
        assert b.place.tolist() == [0, *b.length.cumsum().tolist()[:-1]]
        assert not b.cluster.dropna().duplicated().any()
        if one_per_source:
            assert not b.source.dropna().duplicated().any()
    assert packing.bins_of(packing.pack_documents(docs(spark, rows), capacity=64)).count() > 0
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_packing_keeps_ids_and_does_not_depend_on_partitions(spark):
    big = 2**60 + 1
    rows = [(big, "a b", "s"), (None, "c d e", "s"), (big + 2, "f", "t"), *[(7, "same words", "u")] * 30, *[(1000 + i, "w " * (i % 50), f"s{i % 5}") for i in range(300)]]
    table = docs(spark, rows)
    a, b = (packing.pack_documents(table.repartition(n), capacity=64, shard_rows=100).collect() for n in (1, 6))
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert {r.doc_id for r in a} == {d for d, _, _ in rows} and sum(r.doc_id == 7 for r in a) == 30
    sized = packing.pack_documents(table, capacity=64, size=F.lit(65)).where(F.col("doc_id") == big).orderBy("piece").collect()
    assert [(r.begin, r.length) for r in sized] == [(0, 64), (64, 1)]


def test_near_copies_never_share_a_bin(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(120, 160))) for _ in range(12)]
    # copies in other sources with one word more, which a digest of the words tells apart
    rows = [(10 * i + k, t + " more" * (k % 2) + " " * k, f"s{k}") for i, t in enumerate(base) for k in range(4)] + [(900 + i, "few words here", f"s{i}") for i in range(5)] + [(None, base[0], "s8"), (990, None, "s1"), (991, " ", "s2")]
    table = docs(spark, rows)
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(table).collect()}
    groups = {c: [d for d in near if near[d] == c] for c in set(near.values())}
    assert sum(len(g) >= 4 for g in groups.values()) >= 10
    placed = packing.pack_apart(table, capacity=400).collect()
    assert sorted(str(r.doc_id) for r in placed) == sorted(str(d) for d, _, _ in rows)
    held = {}
    for r in placed:
        if r.bin_id is not None:
            held.setdefault(r.bin_id, []).append(r.doc_id)
    of = lambda d: near[0] if d is None else near[d]
    assert all(len({of(d) for d in b}) == len(b) for b in held.values()) and any(len(b) > 1 for b in held.values())
    # where exact copies alone are clusters, near ones do meet
    plain = {}
    for r in packing.pack_documents(table, capacity=400).collect():
        if r.bin_id is not None:
            plain.setdefault(r.bin_id, []).append(of(r.doc_id))
    assert any(len(set(b)) < len(b) for b in plain.values())


# chat -------------------------------------------------------------------------
def test_chat_edges(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (4, 0, "user", None), (5, 0, "user", ""), (6, 0, "user", "a"), (6, 1, "assistant", "c"), (6, 1, "assistant", "c"), (None, 0, None, "x"), (7, None, "system", "s"), (7, 0, "user", "q " * 9000), (8, 0, "us", "era"), (9, 0, "user", "a"), (9, 1, "assistant", "b"), (9, 2, "user", "more")]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, hash string, turns string")
    got = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert set(got) == {4, 5, 6, None, 7, 8, 9}
    assert got[9].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert (got[6].n_turns, got[9].copies) == (2, 1)
    assert {r.conv_id: r.copies for r in chat.collapse(table.where("conv_id in (2, 3)")).collect()} == {2: 2}
    assert chat.format_chats(table.limit(0)).count() == 0


def test_turns_without_a_conversation_are_their_own(spark, tmp_path):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "unrelated"), (None, 0, "user", "a"), (None, 3, "user", "hi"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "unseen"), (None, 5, "user", "unseen")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((str(r.conv_id), r.n_turns, r.copies, r.rendered) for r in chat.format_chats(table).collect())
    show = lambda *t: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)
    assert got == [("1", 2, 1, show(("user", "a"), ("assistant", "b"))), ("2", 1, 2, show(("user", "unseen"))), ("None", 1, 1, show(("assistant", "unrelated"))), ("None", 1, 2, show(("user", "hi")))]
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in con.execute(chat.ORACLE).fetchall()) == got
