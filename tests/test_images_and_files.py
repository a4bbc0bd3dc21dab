"""Pixel kernels on drawn pages, files in and out, and preparation end to end."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphspark.functions import pixels
from glyphspark.operators import images
from glyphspark.plans import prepare, synthetic
from glyphspark.sources import files


def png(path, pixels_):
    """A PNG file of bytes (h, w) or (h, w, 3), red first."""
    a = np.asarray(pixels_, np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in a)
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0 if a.ndim == 2 else 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def page(seed=7):
    """Four lines of three to five words, with a light gradient; the true number of words in each line."""
    rng = np.random.default_rng(seed)
    img, truth = np.full((420, 900), 250.0), []
    for line in range(4):
        y, x, n = 40 + 88 * line, 40, int(rng.integers(3, 6))
        for _ in range(n):
            units = int(rng.integers(2, 5))
            img[y : y + 5, x : x + 26 * units] = 30
            for u in range(units):
                img[y + 5 : y + 34, x + 26 * u + 12 : x + 26 * u + 16] = 40
                img[y + 20 : y + 24, x + 26 * u + 4 : x + 26 * u + 16] = 40
            x += 26 * units + int(rng.integers(30, 44))
        truth.append(n)
    return np.clip(img * np.linspace(1, 0.82, 900)[None, :], 0, 255).astype(np.uint8), truth


def frame(spark, named):
    return spark.createDataFrame([tuple(images.to_row(o, a).values()) for o, a in named], images.IMAGE)


def test_segmentation(spark):
    img, truth = page()
    turned = np.rint(pixels.rotated(img, 3.0, 230, nearest=False)).astype(np.uint8)
    got = images.segment_pages(frame(spark, [("flat", img), ("turned", turned), ("blank", np.full((60, 60), 255, np.uint8))])).collect()
    lines = {}
    for r in got:
        lines.setdefault(r.origin, {}).setdefault(r.line_no, []).append(r)
        assert len(r.data) == r.w * r.h and (min(r.data) < 128 or r.origin == "turned")  # its corners are drawn too
    assert [len(v) for _, v in sorted(lines["flat"].items())] == truth
    assert len(lines["turned"]) == 4 and "blank" not in lines
    scores = images.skew(images.skew_scores(frame(spark, [("turned", turned)]))).first()
    assert abs(abs(scores.angle) - 3.0) < 0.6


def test_segmentation_agrees_with_profile_windows(spark):
    from glyphspark.operators import profile

    img, _ = page()
    bw = pixels.binarize(img)
    prof = profile.explode_profiles(spark.createDataFrame([(1, (bw > 0).sum(1).astype(float).tolist())], "profile_id long, profile array<double>"))
    got = sorted((r.start, r.end) for r in profile.bands(profile.smooth(prof, 3), least=12).collect())
    assert got == [(y, y + h) for _, y, _, h in pixels.find_lines(bw)]
    x, y, w, h = pixels.find_lines(bw)[0]
    line = bw[y : y + h, x : x + w]
    cols = profile.explode_profiles(spark.createDataFrame([(1, (line > 0).sum(0).astype(float).tolist())], "profile_id long, profile array<double>"))
    heights = spark.createDataFrame([(1, h)], "profile_id long, height int")
    assert sorted((r.start, r.end) for r in profile.words(cols, heights).collect()) == [(a, a + c) for a, _, c, _ in pixels.find_words(line)]


def test_quality_and_preparation(spark):
    img, _ = page()
    word = img[30:90, 20:240]
    named = [("word", word), ("blank", np.full((50, 200), 255, np.uint8)), ("colour", np.stack([word] * 3, 2))]
    m = images.preflight(images.inspect(frame(spark, named)))
    got = {r.origin: r for r in m.collect()}
    assert got["word"].ok and got["word"].errors == [] and got["blank"].errors == ["no ink"]
    assert got["colour"].ink_pixels == got["word"].ink_pixels and math.isclose(got["word"].aspect, 220 / 60)
    wide = np.pad(word, 200, constant_values=245)
    crop = images.auto_crop(frame(spark, [("wide", wide)])).first()
    assert crop.height < wide.shape[0] and crop.width < wide.shape[1]
    shaded = (word * np.linspace(1, 0.5, 220)[None, :]).astype(np.uint8)
    p = images.prepare(frame(spark, [("shaded", shaded), ("even", np.tile(np.arange(200, 220, dtype=np.uint8), (40, 10)))])).collect()
    assert {r.origin: r.lighting for r in p} == {"shaded": True, "even": False}
    a, b = (images.augment(frame(spark, [("w", word)]), seed=3).first().data for _ in range(2))
    assert a == b and a != images.augment(frame(spark, [("w", word)]), seed=4).first().data


def test_components_are_8_connected():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 1, 0, 1]])
    labels = pixels.components(m)
    assert labels[0, 0] == labels[1, 1] and len(set(labels[m > 0].tolist())) == 4


@pytest.mark.parametrize("metric,value,bad", [("ink_pixels", 39, True), ("ink_pixels", 40, False), ("aspect", 1.249, True), ("aspect", 1.25, False), ("contrast", 59.9, True), ("contrast", 60.0, False), ("sharpness", 11.99, True), ("sharpness", 12.0, False)])
def test_preflight_limits(spark, metric, value, bad):
    base = {"width": 10, "height": 5, "aspect": 2.0, "sharpness": 50.0, "contrast": 200.0, "shadow": 25.0, "ink_pixels": 100, "margin": 0.28}
    row = images.preflight(spark.createDataFrame([tuple((base | {metric: value}).values())], images.METRICS)).first()
    assert row.ok != bad and row.warnings == []


def test_prepare_end_to_end(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "img" / "deep").mkdir(parents=True)
    for i in range(30):
        png(raw / "img" / ("deep" if i % 2 else ".") / f"{i}.PNG", np.full((8, 8), 255))
    words = ["कल", "घर", "राम", "सीता", "पानी", "किताब", "स्त्री", "नल", "फल", "जल"]
    (raw / "all.txt").write_text("﻿" + "\n".join(f"img/{i}.PNG {words[i % 10]}" for i in range(30)) + "\nimg/99.PNG कल\nimg/1.PNG\n\nimg/2.PNG abc\n", encoding="utf-8")
    (raw / "empty.txt").write_text("")
    rows, skipped = prepare.manifest(files.annotation_lines(spark, str(raw)), files.image_files(spark, str(raw)), str(raw))
    assert tuple(skipped.first()) == (30, 1, 0, 1, 1)
    out = str(tmp_path / "out")
    written = prepare.prepare(spark, str(raw), out, min_freq=1)
    by = {r.split: r.n for r in written.groupBy("split").agg(F.count_distinct("text").alias("n")).collect()}
    assert by == {"train": 8, "val": 1, "test": 1} and written.where("image like '%/img/%'").count() == 30
    charset = files.read_value(spark, f"{out}/charset")["itos"]
    assert charset[:4] == ["<pad>", "<s>", "</s>", "<unk>"]
    assert [r.token for r in files.read_charset(spark, f"{out}/charset").orderBy("id").collect()] == charset
    lex = [r.value for r in spark.read.text(f"{out}/lexicon").collect()]
    assert lex == sorted(lex) and len(lex) == 8
    stats = files.read_value(spark, f"{out}/stats")
    assert stats["unique_train_labels"] == 8 and stats["charset_size"] == len(charset) and stats["splits"]["train"] == 24


def test_sources(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"image": "a", "text": "कल"}\n\n{"image": "b", "text": "घर"}\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()] == [("a", "कल"), ("b", "घर")]
    files.append_json_lines(spark.createDataFrame([("c", "जल")], "image string, text string"), str(tmp_path / "grow"))
    files.append_json_lines(spark.createDataFrame([("d", "जल")], "image string, text string"), str(tmp_path / "grow"))
    assert files.read_manifest(spark, str(tmp_path / "grow")).count() == 2
    (tmp_path / "w.txt").write_text("कल घर जल\n\n कल", encoding="utf-8")
    assert [r.word for r in files.word_list(spark, str(tmp_path / "w.txt")).collect()] == ["कल", "घर", "जल", "कल"]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.jpg").write_bytes(b"x" * 10)
    (tmp_path / "up" / "b.jpeg").write_bytes(b"x" * 2000)
    (tmp_path / "up" / "c.jpg").write_bytes(b"")
    got = {r.path[-6:]: (r.status, r.content is None) for r in files.uploads(spark, str(tmp_path / "up"), 0.001).collect()}
    assert got["/a.jpg"] == (200, False) and got["b.jpeg"] == (413, True)
    assert [r.path[-6:] for r in files.photos(spark, str(tmp_path / "up")).collect()] == ["/a.jpg", "b.jpeg"]
    fc = spark.createDataFrame([("/f/NotoSansDevanagari.ttf: Noto",), ("/f/Arial.ttf: Arial",), ("/f/deva.pfb: x",), ("/f/NotoSansDevanagari.ttf: Bold",)], "value string")
    assert [r.font for r in files.fonts(fc).collect()] == ["/f/NotoSansDevanagari.ttf"]
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert files.read_config(str(tmp_path / "c.json")) == {"a": {"b": 1}}
    assert files.with_base64(spark.createDataFrame([(b"abc",)], "data binary")).first()[0] == "YWJj"
    png(tmp_path / "p.png", np.tile(np.array([30, 20, 10], np.uint8), (10, 20, 1)))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    rows = {r.origin[-7:]: r for r in images.load(spark, str(tmp_path) + "/*.png").collect()}
    assert images.to_array(rows["bad.png"].asDict()).shape == (384, 384)
    assert images.to_array(rows["p.png" if "p.png" in rows else [k for k in rows if k.endswith("p.png")][0]].asDict())[0, 0].tolist() == [10, 20, 30]


def test_plan(spark):
    u = synthetic.units(spark)
    assert u.count() == len({r.unit for r in u.collect()}) == 33 * 13 + 11 + 33 * 7
    fonts = spark.createDataFrame([("a",), ("b",)], "font string")
    plan = synthetic.render_plan(u, fonts, 3).collect()
    assert len(plan) == 3 * u.count() and {r.font for r in plan} == {"a", "b"}
    assert synthetic.repeats_for(250_000, 9495) == 26 and synthetic.repeats_for(1, 5) == 1


def test_ink_of_a_noisy_page():
    noise = np.random.default_rng(5)
    for sd in (12, 15):
        blank = np.clip(np.rint(200 + noise.normal(0, sd, (200, 500))), 0, 255).astype(np.uint8)
        assert (pixels.ink_mask(blank) > 0).sum() < 40 and (pixels.binarize(blank) > 0).sum() < 400
        written = blank.copy()
        written[80:110, 100:104] = 30
        assert (pixels.ink_mask(written)[80:110, 100:104] > 0).mean() > 0.95
