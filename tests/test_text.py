"""Text algebra against plain Python, with Devanagari."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphspark.functions import distance, sequences, text
from glyphspark.operators import vocab

NUKTA_PRE = {chr(a): chr(b) + "़" for a, b in [(0x929, 0x928), (0x931, 0x930), (0x934, 0x933), (0x958, 0x915), (0x959, 0x916), (0x95A, 0x917), (0x95B, 0x91C), (0x95C, 0x921), (0x95D, 0x922), (0x95E, 0x92B), (0x95F, 0x92F)]}
PATTERN = re.compile(text.akshara_pattern().removeprefix("(?d)"))


def plain_normal(s):
    s = unicodedata.normalize("NFC", s)
    return "".join(NUKTA_PRE.get(c, c) for c in s).strip()


def plain_aksharas(s):
    return PATTERN.findall(plain_normal(s))


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


WORDS = ["किताब", "स्त्री", "ज्ञान", "हिन्दी", "हिंदी", "क्षत्रिय", "पढ़ती", "अँधेरा", "।१२", "", " ", "राम श्याम", "a\nb", "  x　", "😀क", "क्‍ष", "ऽवग्रह", "é", "\r\u0085"]


def sample():
    rng = random.Random(7)
    pool = [chr(c) for c in range(0x900, 0x980)] + list("ab \n\r\u0085 😀é")
    return WORDS + ["".join(rng.choices(pool, k=rng.randint(0, 9))) for _ in range(1500)]


def test_aksharas_and_normal_form(spark):
    rows = sample()
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", text.aksharas(F.col("t")).alias("a"), text.normalize(F.col("t")).alias("n"), text.is_devanagari(F.col("t")).alias("d"), text.codepoints(F.col("t")).alias("cp"))
    for r in df.collect():
        assert r.n == plain_normal(rows[r.i]) and r.a == plain_aksharas(rows[r.i]), repr(rows[r.i])
        visible = [c for c in rows[r.i] if not c.isspace()]
        assert r.d == (bool(visible) and sum("ऀ" <= c <= "ॿ" for c in visible) / len(visible) >= 0.5)
        assert r.cp == [f"U+{ord(c):04X}" for c in rows[r.i]]


def test_every_character_that_nfc_changes_is_found(spark):
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    # and compositions of two characters, written apart, and marks out of order
    apart = [unicodedata.normalize("NFD", chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFC", chr(c)) == chr(c)]
    mixed = ["क\u094d\u093c", "a\u0301\u0323", "कि\u0951\u093c", "e\u0301 ज़", "\u1112\u1161\u11ab"]
    rows = [*odd, *apart[::7], *mixed]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", text.normalize(F.col("t")).alias("n")).collect()
    bad = [rows[r.i] for r in got if r.n != plain_normal(rows[r.i])]
    assert len(odd) > 1000 and not bad, bad[:20]


def test_edit_distance(spark):
    rng = random.Random(9)
    words = [w for w in sample() if len(w) < 12]
    pairs = [(i, rng.choice(words), rng.choice(words)) for i in range(600)] + [(600, "किताब", "कीताब"), (601, "", "कख"), (602, "", "")]
    df = spark.createDataFrame(pairs, "i int, a string, b string").select("i", text.aksharas(F.col("a")).alias("x"), text.aksharas(F.col("b")).alias("y"))
    got = df.select("*", distance.edit_distance(F.col("x"), F.col("y")).alias("d"), distance.akshara_error_rate(F.col("x"), F.col("y")).alias("e"), distance.within(F.col("x"), F.col("y"), 2).alias("w")).collect()
    for r in got:
        d = plain_distance(r.x, r.y)
        assert r.d == d and r.w == (d if d <= 2 else -1)
        assert r.e == (d / len(r.x) if r.x else float(bool(r.y)))
    assert {r.i: r.d for r in got}[600] == 1


def test_far_apart_needs_no_comparison(spark):
    many = [f"u{i} " for i in range(9_000)]
    df = spark.createDataFrame([(many, ["x "]), (many, [*many[:-1], "y "]), (["a ", "b "], ["b ", "a "]), (["a ", "b "], ["c ", "d "]), (["a "] * 3, ["a "] * 6)], "a array<string>, b array<string>")
    far = df.where(F.size("b") == 1).select(distance.within(F.col("a"), F.col("b"), 2)).first()[0]
    assert far == -1
    with pytest.raises(Exception, match="too many different units"):
        df.where(F.size("b") == 9_000).select(distance.within(F.col("a"), F.col("b"), 2)).collect()
    assert [r[0] for r in df.where(F.size("a") < 9).select(distance.within(F.col("a"), F.col("b"), 2)).collect()] == [2, 2, -1]
    assert [r[0] for r in df.where(F.size("a") < 9).select(distance.within(F.col("a"), F.col("b"), 1)).collect()] == [-1, -1, -1]


def test_names_of_many_kinds(spark):
    odd = [0x09, 0x20, 0xE9, 0x300, 0x915, 0x94D, 0x2028, 0x4E2D, 0xAC00, 0xD7A3, 0xFFFD, 0x1F600, 0xE000, 0x10FFFF]
    df = spark.createDataFrame([(i, chr(c)) for i, c in enumerate(odd)] + [(99, None), (98, "")], "i int, t string")
    got = {r.i: r.n for r in df.select("i", text.codepoint_names(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(odd))] == [[f"U+{c:04X} {unicodedata.name(chr(c), '?')}"] for c in odd] and got[99] is None and got[98] == []


def test_names(spark):
    assert spark.createDataFrame([("कa",)], "t string").select(text.codepoint_names(F.col("t"))).first()[0] == ["U+0915 DEVANAGARI LETTER KA", "U+0061 LATIN SMALL LETTER A"]


def test_vocab_round_trip(spark):
    texts = spark.createDataFrame([("किताब",), ("कमल",), ("मकान",), (None,)], "text string")
    v = vocab.build_vocab(texts)
    ids = {r.token: r.id for r in v.collect()}
    assert [t for t, i in sorted(ids.items(), key=lambda x: x[1])][:4] == sequences.SPECIALS
    letters = [t for t, i in sorted(ids.items(), key=lambda x: x[1])][4:]
    assert letters == sorted(letters)
    enc = texts.where("text is not null").select("text", vocab.encode(F.col("text"), vocab.map_literal(ids)).alias("ids"))
    out = enc.crossJoin(vocab.itos_of(v)).select("text", "ids", vocab.decode(F.concat("ids", F.array(F.lit(9), F.lit(999))), F.col("itos")).alias("d"), vocab.decode(F.array(F.lit(1), F.lit(5)), F.col("itos"), skip_special=False).alias("raw")).collect()
    assert all(r.d == r.text and r.ids[0] == 1 and r.ids[-1] == 2 for r in out)
    assert out[0].raw == "<s>" + letters[1]
    short = texts.where("text is not null").select(vocab.encode(F.col("text"), vocab.map_literal({}), 4).alias("i")).first().i
    assert short == [1, 3, 3, 2]


def test_sequences(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([5.0],), ([],)], "x array<double>")
    rows = df.select(sequences.softmax(F.col("x")).alias("p"), sequences.argmax(F.col("x")).alias("a"), sequences.pad_to(F.array(F.lit(1)), 3).alias("pad"), sequences.log_softmax(F.col("x")).alias("l")).collect()
    assert [r.a for r in rows] == [1, 0, -1] and rows[0].pad == [1, -100, -100]
    assert abs(sum(rows[0].p) - 1) < 1e-12 and rows[1].p == [1.0] and rows[1].l == [0.0]
    m = df.select(sequences.margin(sequences.softmax(F.col("x"))).alias("m"), sequences.normalized_entropy(sequences.softmax(F.col("x"))).alias("h")).collect()
    assert m[1].m == 1.0 and m[1].h == 0.0 and abs(m[0].m) < 1e-12
    c = spark.createDataFrame([(0.5,), (-1.0,), (None,)], "s double").select(sequences.sequence_confidence(F.col("s")).alias("c")).collect()
    assert c[0].c == 1.0 and abs(c[1].c - 0.36787944) < 1e-6 and c[2].c == 0.5
