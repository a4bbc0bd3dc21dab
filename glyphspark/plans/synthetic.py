"""What to render: units and words times repeats, each with a seeded font. Rendering is not done here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dataset import shuffled
from ..operators.prefix import fresh, running

# Letters, vowels, vowel signs (the first one none) and conjuncts that units are made of.
CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह"
VOWELS = "अआइईउऊऋएऐओऔ"
MATRAS = ["", "ा", "ि", "ी", "ु", "ू", "ृ", "े", "ै", "ो", "ौ", "ं", "ः"]
CONJUNCTS = [
    "क्ष", "ज्ञ", "त्र", "श्र", "स्त", "स्थ", "न्द", "न्ध", "न्त", "न्ह", "क्क",
    "क्त", "ग्र", "द्ध", "द्व", "द्य", "ट्ट", "ड्ड", "प्र", "ब्र", "म्ह", "ल्ल",
    "व्य", "श्च", "ष्ट", "स्व", "ह्म", "त्त", "च्छ", "ङ्क", "द्र", "ह्य", "न्न",
]
CONJUNCT_MATRAS = 7


def units(spark: SparkSession) -> DataFrame:
    """(unit) distinct, in order of code points: letters, vowels, conjuncts, and their products with vowel signs."""
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    signs = frame(MATRAS, "sign")
    few = frame(MATRAS[:CONJUNCT_MATRAS], "sign")
    simple = frame([*CONSONANTS, *VOWELS, *CONJUNCTS], "unit")
    product = lambda base, sign: base.crossJoin(sign).select(F.concat("unit", "sign").alias("unit"))
    return simple.unionByName(product(frame(CONSONANTS, "unit"), signs)).unionByName(product(frame(CONJUNCTS, "unit"), few)).distinct().orderBy("unit")


def drawn_units(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """rows with a unit each, drawn by a seeded hash of their key."""
    listed = units(rows.sparkSession)
    number, h = fresh(rows, "number"), fresh(rows, "h")
    # a fixed list
    numbered = listed.withColumn(number, F.row_number().over(Window.orderBy("unit")) - 1)
    drawn = rows.withColumn(h, F.conv(F.substring(shuffled(F.col(key), seed), 1, 8), 16, 10).cast("long") % listed.count())
    return drawn.join(F.broadcast(numbered), F.col(h) == F.col(number)).drop(h, number)


def render_plan(items: DataFrame, fonts: DataFrame, repeats: int, seed: int = 11, item: str = "unit") -> DataFrame:
    """(item, repeat, font): each item `repeats` times, each with a font drawn by a seeded hash.

    fonts(font) are numbered in order, by ranges, and the draw is an equi-join on that number.
    """
    # the first bytes as a number, which orders as the names do
    start = F.conv(F.rpad(F.substring(F.hex("font"), 1, 12), 12, "0"), 16, 10).cast("double")
    known = fonts.select("font").where(F.col("font").isNotNull()).distinct()
    ranked = running(known.withColumn("start", start), "start", ["font"], {"number": F.lit(1)})
    n = known.agg(F.count("*").alias("fonts"))
    numbered = ranked.select("font", (F.col("number") - 1).alias("number"))
    # one row
    plan = items.select(F.col(item).alias("item")).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).crossJoin(F.broadcast(n))
    draw = F.conv(F.substring(shuffled(F.concat_ws(":", "item", "repeat"), seed), 1, 8), 16, 10).cast("long")
    drawn = plan.withColumn("number", F.when(F.col("fonts") > 0, draw % F.col("fonts")))
    return drawn.join(numbered, "number", "left").select("item", "repeat", "font")


def repeats_for(target: int, n_items: int) -> int:
    """Repeats that bring n items near a target, at least one."""
    return max(1, target // max(n_items, 1))


def training_union(*manifests: DataFrame) -> DataFrame:
    """UNION ALL of manifests(image, text), each row with its source's number."""
    out = None
    for i, m in enumerate(manifests):
        part = m.select("image", "text", F.lit(i).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out
