"""Vocabularies, encoding and decoding, lexicon counts and length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import BOS, EOS, SPECIALS, UNK
from ..functions.text import SPACE, akshara_count, characters, is_devanagari, normalize, strip
from .place import most_common_first
from .prefix import once


def char_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over the code points of normal forms."""
    return texts.select(F.explode(characters(normalize(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def build_vocab(texts: DataFrame, text: str = "text", min_freq: int = 1, specials: list[str] | None = None) -> DataFrame:
    """(token, id): special tokens first, then characters seen min_freq times, by code point."""
    specials = SPECIALS if specials is None else specials
    kept = char_counts(texts, text).where((F.col("n") >= min_freq) & ~F.col("token").isin(specials))
    # a vocabulary of characters: at most as many rows as Unicode has
    ranked = kept.select("token", (F.row_number().over(Window.orderBy("token")) + (len(specials) - 1)).cast("int").alias("id"))
    first = texts.sparkSession.createDataFrame(list(enumerate(specials)), "id int, token string").select("token", "id")
    return first.unionByName(ranked)


def as_map(vocab: DataFrame) -> dict[str, int]:
    """A character vocabulary on the driver (bounded by Unicode's size)."""
    return {r.token: r.id for r in vocab.collect()}


def map_literal(vocab: dict[str, int]) -> Column:
    return F.create_map(*[x for t, i in vocab.items() for x in (F.lit(t), F.lit(i))])


def encode(text: Column, vocab: Column, max_length: int = 32) -> Column:
    """Ids of the normal form's characters between begin and end, cut to max_length; unknown ones as UNK."""
    ids = F.transform(characters(normalize(text)), lambda c: F.coalesce(F.try_element_at(vocab, c), F.lit(UNK)))
    return F.slice(F.concat(F.array(F.lit(BOS)), F.slice(ids, 1, max(max_length - 2, 0)), F.array(F.lit(EOS))), 1, max_length)


def decode(ids: Column, itos: Column, skip_special: bool = True) -> Column:
    """Text of ids up to the first end token; ids outside the vocabulary are skipped."""
    end = F.array_position(ids, EOS)
    upto = F.when(end > 0, F.slice(ids, 1, F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(ids)
    known = F.filter(upto, lambda i: (i >= (len(SPECIALS) if skip_special else 0)) & (i < F.size(itos)))
    return normalize(F.array_join(F.transform(known, lambda i: F.get(itos, i)), ""))


def itos_of(vocab: DataFrame) -> DataFrame:
    """One row: tokens in order of id, as charset files hold them."""
    return vocab.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "token"))), lambda s: s["token"]).alias("itos"))


def out_of_vocab(texts: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """(token, n): characters of texts that vocab lacks."""
    return char_counts(texts, text).join(vocab.select("token"), "token", "left_anti")


def lexicon(*sources: DataFrame, mode: str = "any") -> DataFrame:
    """(word, freq) over sources(word): normal forms with any Devanagari (mode none: all that aren't empty)."""
    words = None
    for s in sources:
        w = s.select(normalize(F.col("word")).alias("word"))
        words = w if words is None else words.unionByName(w)
    kept = words.where(F.col("word") != "") if mode == "none" else words.where(is_devanagari(F.col("word"), mode))
    return kept.groupBy("word").agg(F.count("*").alias("freq"))


def unique_labels(rows: DataFrame, text: str = "text") -> DataFrame:
    """Distinct labels in order of code points."""
    return rows.select(F.col(text).alias("label")).distinct().orderBy("label")


def length_stats(texts: DataFrame, text: str = "text") -> DataFrame:
    """min, max, mean and p99 of akshara counts; 0 if there are none.

    p99 is the value at place floor(0.99 n) in order, counted from 0. Lengths are few, so the place
    is found in their counts.
    """
    by = texts.select(akshara_count(F.col(text)).alias("length")).groupBy("length").agg(F.count("*").alias("c"))
    # one row a distinct length
    upto = F.sum("c").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0))
    counted = by.withColumn("upto", upto).withColumn("total", F.sum("c").over(Window.partitionBy(F.lit(1))))
    place = F.floor(F.col("total") * F.lit(0.99))
    stats = counted.agg(F.sum("c").alias("n"), F.min("length").alias("min"), F.max("length").alias("max"), (F.sum(F.col("length") * F.col("c")) / F.sum("c")).alias("mean"), F.min(F.when(F.col("upto") > place, F.col("length"))).alias("p99"))
    return stats.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "min", "max", "mean", "p99")])


def first_seen_chars(texts: DataFrame, k: int, text: str = "text", place: str = "place") -> DataFrame:
    """(token, n): the k most common code points of normal forms, ties in the order in which they first appear."""
    each = once(texts.select(F.col(place).alias("place"), F.col(text).alias("text")), normal=normalize(F.col("text")))
    chars = each.select("place", F.posexplode(characters(F.col("normal"))).alias("at", "token"))
    return most_common_first(chars, k, "token", seen=("place", "at"))


def first_seen_words(texts: DataFrame, k: int, text: str = "text", place: str = "place") -> DataFrame:
    """(word, n): the k most common words by white space, ties in the order in which they first appear."""
    words = texts.select(F.col(place).alias("place"), F.posexplode(F.split(strip(F.col(text)), f"{SPACE}+")).alias("at", "word")).where("word <> ''")
    return most_common_first(words, k, "word", seen=("place", "at"))


def most_common(counts: DataFrame, k: int, *keys: str, n: str = "n") -> DataFrame:
    """The k largest counts, ties by keys."""
    return counts.orderBy(F.desc(n), *keys).limit(k)
