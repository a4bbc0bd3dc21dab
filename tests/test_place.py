"""Order by place against plain lists."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphspark import shared
from glyphspark.operators import audit, dataset, place, recognition, vocab
from glyphspark.sources import files


def test_lines_of_many_splits_are_numbered_as_they_stand(spark, tmp_path):
    rng = random.Random(0)
    for name, n in (("a/one.txt", 900), ("a/empty.txt", 0), ("b.txt", 1), ("c.txt", 333)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(f"{name} {i} {'x' * rng.randrange(40)}\n" for i in range(n)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = files.annotation_lines(spark, str(tmp_path), places=True).orderBy("place").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(str(tmp_path / name), i, f"{name} {i}") for name, n in (("a/one.txt", 900), ("b.txt", 1), ("c.txt", 333)) for i in range(n)]
    assert [(r.path, r.line_no, " ".join(r.value.split()[:2])) for r in got] == want
    assert [r.place for r in got] == list(range(len(want)))


def test_rows_of_many_files_and_extra_columns(spark, tmp_path):
    rows = [(i, f"v{(i * 7919) % 1000}", 5, 6, 7) for i in range(1000)]
    for k in range(3):
        part = rows[k * 300 : (k + 1) * 300 + 100 * (k == 2)]
        spark.createDataFrame(part, "i int, v string, file int, row int, before int").coalesce(1).write.option("parquet.block.size", 1024).parquet(str(tmp_path / f"t{k}"))
    got = place.table_places(spark, *[str(tmp_path / f"t{k}") for k in (2, 0, 1)]).orderBy("place").collect()
    assert [r.i for r in got] == list(range(1000)) and [r.place for r in got] == list(range(1000)) and got[0].file == 5


def test_order_places(spark):
    rows = [(random.Random(i).randrange(40), i % 3, None if i % 9 == 0 else f"t{i % 5}") for i in range(500)]
    df = spark.createDataFrame(rows, "part int, inside int, t string")
    got = place.order_places(df, F.desc("part"), F.asc_nulls_last("t"), F.asc("inside")).orderBy("place").collect()
    want = sorted(rows, key=lambda r: (-r[0], r[2] is None, r[2] or "", r[1]))
    assert [tuple(r)[:3] for r in got] == want and [r.place for r in got] == list(range(500))
    assert place.order_places(df.limit(0), "t").count() == 0


def test_ties_come_in_first_seen_order(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghij ", k=rng.randrange(9))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "place long, text string").repartition(7)
    chars = Counter(c for t in texts for c in t.strip())
    words = Counter(w for t in texts for w in t.split())
    for k in (3, 8, 100):
        assert [tuple(r) for r in vocab.first_seen_chars(df, k).collect()] == chars.most_common(k)
        assert [tuple(r) for r in vocab.first_seen_words(df, k).collect()] == words.most_common(k)


def test_confusions_come_in_first_seen_order(spark):
    rng = random.Random(5)
    pairs = [(i, "".join(rng.choices("abcd", k=4)), "".join(rng.choices("abcd", k=rng.randrange(6)))) for i in range(40)]
    want = Counter((r, h) for _, ref, hyp in pairs for r, h in zip(ref, hyp) if r != h)
    df = spark.createDataFrame(pairs, "place long, ref string, hyp string").repartition(5)
    assert [((r.expected, r.read_as), r.n) for r in audit.first_seen_confusions(df, 6).collect()] == want.most_common(6)


@pytest.mark.parametrize("n", [0, 3, 8])
def test_zip_ends_with_the_shorter_side(spark, tmp_path, n):
    (tmp_path / "refs.txt").write_text("".join(f"r{i}\n" for i in range(5)))
    (tmp_path / "hyps.txt").write_text("".join(f"h{i}\n" for i in range(n)))
    side = lambda name: files.annotation_lines(spark, str(tmp_path / name), places=True).select("place", F.col("value").alias(name[:-5]))
    got = recognition.zip_pairs(side("refs.txt"), side("hyps.txt")).orderBy("place").collect()
    assert [(r.ref, r.hyp) for r in got] == list(zip([f"r{i}" for i in range(5)], [f"h{i}" for i in range(n)]))


def test_first_rows_and_written_tables(spark):
    df = spark.createDataFrame([(3, "d"), (0, "a"), (1, "b"), (2, "c")], "place long, text string")
    assert {r.text for r in dataset.first_rows(df, 2).collect()} == {"a", "b"}
    kept = shared.written(df, "test")
    assert kept.schema == df.schema and kept.count() == 4
    shared.forget(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|not exist"):
        kept.collect()


def test_groups_come_in_chunks(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else None if rng.random() < 0.1 else f"l{rng.randrange(30)}", f"i{rng.randrange(400):03d}") for _ in range(900)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, image string, chunk int, n int")
    got = dataset.group_labels(df, size=50).collect()
    want = {}
    for t, i in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.setdefault(t, []).append(i)
    assert all(len(r.rows) <= 50 and r.n == len(want[r.text]) for r in got)
    for t, images in want.items():
        own = sorted((r for r in got if r.text == t), key=lambda r: r.chunk)
        assert [r.chunk for r in own] == list(range(len(own))) and [i for r in own for i in r.rows] == images
        assert all(len(r.rows) == 50 for r in own[:-1])
    assert dataset.group_labels(df.limit(0)).count() == 0
