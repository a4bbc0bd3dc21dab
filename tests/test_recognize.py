"""Recognition end to end with an injected model, page texts, rounding, and the corrector's interface."""

import numpy as np
from pyspark.sql import functions as F

from glyphspark.functions import pixels
from glyphspark.operators import audit, correction, images, recognize


def load():
    def model(rows, passes):
        out = []
        for r in rows:
            n = 2 + int(r["width"]) % 3
            out.append({"text": "कलम" if n > 3 else "घर", "tokens": list(range(n)), "token_probs": [0.9] * (n - 1) + [0.2], "token_entropies": [0.1] * n, "token_margins": [0.5] * n, "mc_variants": []})
        return out

    return model


def word(width, ink=30):
    img = np.full((60, width), 245, np.uint8)
    img[20:24, 10 : width - 10] = ink
    for x in range(14, width - 14, 12):
        img[24:45, x : x + 3] = ink
    return img


def test_words(spark):
    rows = [images.to_row("good", word(180)), images.to_row("blank", np.full((60, 180), 250, np.uint8)), images.to_row("tall", word(60))]
    table = spark.createDataFrame(rows, images.IMAGE)
    refs = spark.createDataFrame([("good", "घर"), ("blank", "घरa")], "origin string, reference string")
    got = {r.origin: r for r in recognize.read_words(table, load, "widths", refs).collect()}
    assert set(got) == {"good", "blank", "tall"}
    assert not got["good"].rejected and got["good"].errors == [] and got["blank"].rejected and got["blank"].errors == ["no ink"] and got["tall"].errors == ["not a word"]
    for r in got.values():
        assert r.final == r.raw and len(r.char_probs) == len(r.final) and r.confidence == np.mean([0.9] * (len(r.entropy_per_char) - 1) + [0.2]) and r.weakest_position == len(r.entropy_per_char) - 1
    assert got["tall"].error_rate is None and got["blank"].error_rate is not None
    # the refused image was read as it is, the other one cropped
    assert len(got["blank"].entropy_per_char) == 2 + 180 % 3
    seen = recognize.as_detected(recognize.read_words(table, load, "widths")).where("origin = 'good'").first()
    assert seen.box.asDict() == {"x": 0, "y": 0, "w": 180, "h": 60} and (seen.detection_accuracy, seen.line_number, seen.word_number) == (1.0, 1, 1)


def test_pages(spark):
    page = np.full((200, 420), 245, np.uint8)
    for y in (20, 110):
        for x in (10, 220):
            page[y : y + 60, x : x + 180] = np.minimum(page[y : y + 60, x : x + 180], word(180))
    words = recognize.read_pages(spark.createDataFrame([images.to_row("p", page)], images.IMAGE), load, "widths", level=False)
    got = words.orderBy("line_number", "word_number").collect()
    assert [(r.origin, r.line_number, r.word_number) for r in got] == [("p", 1, 1), ("p", 1, 2), ("p", 2, 1), ("p", 2, 2)]
    assert all(150 < r.box.w < 200 for r in got)
    text = recognize.page_texts(words).first()
    lines = [" ".join(r.final for r in got if r.line_number == n) for n in (1, 2)]
    assert text.text == "\n".join(lines) and text.n_words == 4 and text.n_corrected == 0


def test_rounding_reaches_nested_numbers(spark):
    report = spark.range(1).select(F.lit(0.123456).alias("a"), F.struct(F.lit(2.00005001).alias("b"), F.lit(7).alias("n")).alias("s"), F.array(F.struct(F.lit(0.99999).alias("c"), F.lit("x").alias("t"))).alias("l"), F.create_map(F.lit("k"), F.lit(1 / 3)).alias("m"), F.lit(None).cast("double").alias("z"))
    assert audit.rounded(report).first().asDict(True) == {"a": 0.1235, "s": {"b": 2.0001, "n": 7}, "l": [{"c": 1.0, "t": "x"}], "m": {"k": 0.3333}, "z": None}


CORPUS = ["राम स्कूल जाता है", "सीता किताब पढ़ती है", "राम पानी पीता है", "सीता स्कूल जाती है", "राम किताब पढ़ता है", "किताब मेज पर है"] * 2


def test_lexicon_models_and_corrector(spark):
    lines = spark.createDataFrame([(x,) for x in CORPUS], "value string")
    lexicon = correction.Lexicon.from_corpus(lines)
    asked = spark.createDataFrame([("किताब",), ("कीताब",)], "word string")
    assert {r.word: r.known for r in lexicon.contains(asked).collect()} == {"किताब": True, "कीताब": False}
    assert lexicon.nearest(asked.where("word = 'कीताब'")).orderBy("rank").first().candidate == "किताब"
    aksharas = correction.akshara_model(lexicon.table)
    p = {r.word: r.logprob for r in aksharas.word_logprob(spark.createDataFrame([("किताब",), ("ािकबत",)], "word string")).collect()}
    assert p["किताब"] > p["ािकबत"]
    words = correction.word_model(lines, text="value")
    s = spark.createDataFrame([(1, ["राम", "स्कूल", "जाता", "है"]), (2, ["है", "जाता", "राम", "स्कूल"])], "sentence_id long, words array<string>")
    p = {r.sentence_id: r.logprob for r in words.sentence_logprob(s).collect()}
    assert p[1] > p[2]
    asked = spark.createDataFrame([(1, ["सीता", "कीताब", "पढ़ती", "है"], [False, True, False, False]), (2, ["सीता", "किताब"], None)], "sentence_id long, words array<string>, flags array<boolean>")
    for lm in (None, words):
        got = {r.sentence_id: r.text for r in correction.Corrector(lexicon, lm, aksharas).correct_sentences(asked).collect()}
        assert got == {1: "सीता किताब पढ़ती है", 2: "सीता किताब"}


def test_augmentation(spark):
    img = word(180)
    assert (pixels.augmented(img, 3, 0.0) == img).all()
    assert (pixels.augmented(img, 3, 1.0) == pixels.augmented(img, 3, 1.0)).all()
    assert sum((pixels.augmented(img, i) == img).all() for i in range(200)) > 60
    still = pixels.perspective(img.astype(float), np.random.default_rng(0), 0.0)
    assert np.allclose(still, img) and np.allclose(pixels.grid_warped(img.astype(float), np.random.default_rng(0), 5, 0.0), img)
    for f in (pixels.perspective, pixels.grid_warped):
        moved = f(img.astype(float), np.random.default_rng(1))
        assert moved.shape == img.shape and 0.5 < (moved < 128).sum() / (img < 128).sum() < 1.6 and np.abs(moved - img).max() > 50


def test_overlay(spark):
    page = np.full((120, 420), 245, np.uint8)
    for x in (10, 220):
        page[30:90, x : x + 180] = word(180)
    table = spark.createDataFrame([images.to_row("p", page)], images.IMAGE)
    boxes = images.segment_pages(table, level=False).collect()
    drawn = images.to_array(images.overlay(table, level=False).first().asDict())
    assert drawn.shape == (120, 420, 3)
    for b in boxes:
        assert drawn[b.y, b.x].tolist() == [0, 60, 200] and drawn[b.y + b.h, b.x + b.w].tolist() == [0, 60, 200]
    inside = np.ones((120, 420), bool)
    for x, y, w, h in [(b.x, b.y, b.w, b.h) for b in boxes] + pixels.find_lines(pixels.binarize(page)):
        inside[max(y - 1, 0) : y + h + 1, max(x - 1, 0) : x + w + 1] = False
        inside[y + 1 : y + h - 1, x + 1 : x + w - 1] = True
    same = (drawn == page[:, :, None]).all(2)
    assert same[inside].mean() > 0.9 and not same.all()
