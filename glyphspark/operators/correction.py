"""Lexicon search, n-gram models of words, and the corrector.

The combining formula is this library's own:

    gain(c) = lm * (log P(c) - log P(word)) / max(aksharas of the word, 1)
            - distance * edit distance + visual * visual similarity + frequency * ln(1 + freq(c))

with the word itself at distance 0, similarity 1 and its own frequency. The best candidate replaces
the word if it gains more than the margin on it. A word of the lexicon stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import within
from ..functions.text import aksharas, normalize
from ..shared import written
from .prefix import once
from .skew import lookup
from .vocab import lexicon as lexicon_of

WEIGHTS = {"lm": 1.0, "distance": 1.2, "visual": 1.5, "frequency": 0.3}
MARGIN = 0.5
MAX_DISTANCE = 2
MAX_CANDIDATES = 12
BEGIN, END = "<w>", "</w>"

#: Letters that handwriting confuses, as far as this library knows without measured confusions.
CONFUSABLE = [
    ("ब", "व"), ("भ", "म"), ("घ", "ध"), ("ख", "रव"), ("प", "य"), ("ड", "ङ"), ("ड", "इ"),
    ("ि", "ी"), ("ु", "ू"), ("े", "ै"), ("ो", "ौ"), ("ं", "ँ"), ("त", "न"), ("ट", "ढ"),
]
SIMILAR, SAME, DIFFERENT = 0.8, 1.0, 0.0


def visual_similarity(a: Column, b: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    """1 for equal aksharas, SIMILAR for confusable ones, else 0."""
    either = [F.lit(False)] + [((a == x) & (b == y)) | ((a == y) & (b == x)) for x, y in (CONFUSABLE if pairs is None else pairs)]
    hit = either[0]
    for e in either[1:]:
        hit = hit | e
    return F.when(a == b, SAME).when(hit, SIMILAR).otherwise(DIFFERENT)


def word_similarity(a: Column, b: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    """Mean similarity of the characters at each place of two words, over the longer one."""
    n = F.greatest(F.length(a), F.length(b))
    # by character, so that a changed vowel sign inside an akshara counts as near
    zipped = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(visual_similarity(x, y, pairs), F.lit(0.0)))
    return F.when(n > 0, F.aggregate(zipped, F.lit(0.0), lambda acc, v: acc + v) / n).otherwise(F.lit(1.0))


def confusable_pairs(confusions: DataFrame, least: int = 2, top: int | None = None) -> list[tuple[str, str]]:
    """Measured confusions (expected, read_as, n) as pairs for visual_similarity; top keeps the most common ones.

    There are at most as many as pairs of aksharas that were confused `least` times.
    """
    found = confusions.where(F.col("n") >= least).orderBy(F.desc("n"), "expected", "read_as")
    return [(r.expected, r.read_as) for r in (found if top is None else found.limit(top)).collect()]


def _begin(length: Column, i: int, parts: int) -> Column:
    """Where the i-th of so many parts of a word of that length begins; none is empty where the length allows it."""
    return F.floor(length * i / parts).cast("int")


def _key(tag: str, length: Column, i: int, units: Column) -> Column:
    return F.xxhash64(F.lit(tag), length, F.lit(i), F.array_join(units, "\x1f"))


def _segments(units: Column, most: int, tag: str) -> list[Column]:
    """Keys of a word's most + 1 segments; a word too short for them has none."""
    n, parts = F.size(units), most + 1
    return [F.when(n > most, _key(tag, n, i, F.slice(units, _begin(n, i, parts) + 1, _begin(n, i + 1, parts) - _begin(n, i, parts)))) for i in range(parts)]


def _substrings(units: Column, most: int, tag: str, longer: range) -> list[Column]:
    """Keys of a word's substrings that may be a segment of a word that is longer by one of `longer`.

    If a word is within `most` edits of one of most + 1 segments, then for some i the i-th segment stands in it with at
    most i edits before it and most - i after it; so it begins at most so far from its own place.
    """
    n, parts, out = F.size(units), most + 1, []
    for more in longer:
        length = n + more
        for i in range(parts):
            begin, size = _begin(length, i, parts), _begin(length, i + 1, parts) - _begin(length, i, parts)
            for off in range(max(-i, -more - (most - i)), min(i, -more + (most - i)) + 1):
                fits = (length > most) & (begin + off >= 0) & (begin + off + size <= n)
                out.append(F.when(fits, _key(tag, length, i, F.slice(units, F.greatest(begin + off, F.lit(0)) + 1, size))))
    return out


#: Parts over which words too short for segments are dealt.
SHORT = 16


def search_keys(words: DataFrame, word: str, max_distance: int, entry: bool) -> DataFrame:
    """words with key: one row for each key under which a word is kept (entry) or asked for.

    The longer word of a pair is cut into max_distance + 1 segments, the other gives its substrings; of words too short for that
    any two are near. A word has at most some (max_distance + 1) ** 3 keys, however long it is.
    """
    # an asked word that is as long as an entry is the one that is cut
    asked, kept = ("a", "e")
    units = F.col("units")
    if entry:
        keys = _segments(units, max_distance, kept) + _substrings(units, max_distance, asked, range(max_distance + 1))
        short = F.array(F.xxhash64(F.lit("short"), F.pmod(F.xxhash64(word), F.lit(SHORT))))
    else:
        keys = _segments(units, max_distance, asked) + _substrings(units, max_distance, kept, range(1, max_distance + 1))
        short = F.transform(F.sequence(F.lit(0), F.lit(SHORT - 1)), lambda k: F.xxhash64(F.lit("short"), k.cast("long")))
    own = F.filter(F.array(*keys), lambda k: k.isNotNull())
    with_units = once(words, units=aksharas(F.col(word)))
    every = F.when(F.size("units") <= max_distance, F.concat(own, short)).otherwise(own)
    return with_units.withColumn("key", F.explode(F.array_distinct(every))).drop("units")


def nearest(words: DataFrame, lexicon: DataFrame, max_distance: int = MAX_DISTANCE, limit: int | None = MAX_CANDIDATES) -> DataFrame:
    """(word, candidate, distance, freq, rank): lexicon words within max_distance aksharas of each word.

    Of max_distance + 1 segments of a word, one at least stands unchanged in any word so near, at nearly its place. An
    equi-join on segments and the substrings that may be one (search_keys) meets every candidate, and distances
    verify it: no pairs of all words with all entries. Order: distance, falling frequency, then the word.
    """
    asked = search_keys(words.select("word").distinct(), "word", max_distance, False)
    entries = search_keys(lexicon.select(F.col("word").alias("candidate"), "freq"), "candidate", max_distance, True)
    met = asked.join(entries, "key").select("word", "candidate", "freq").distinct()
    arrays = once(met, a=aksharas(F.col("word")), b=aksharas(F.col("candidate")))
    near = once(arrays, distance=within(F.col("a"), F.col("b"), max_distance)).where(F.col("distance") >= 0)
    rank = F.row_number().over(Window.partitionBy("word").orderBy("distance", F.desc("freq"), "candidate"))
    out = near.select("word", "candidate", "distance", "freq", rank.alias("rank"))
    return out if limit is None else out.where(F.col("rank") <= limit)


# n-gram model -----------------------------------------------------------------
def ngram_counts(sequences: DataFrame, order: int, units: str = "units", weight: str | None = None) -> DataFrame:
    """(n, context, unit, c) for n up to order over arrays with begin marks and an end."""
    padded = F.concat(F.array_repeat(F.lit(BEGIN), order - 1), F.col(units), F.array(F.lit(END)))
    w = F.lit(1) if weight is None else F.col(weight)
    rows = sequences.select(padded.alias("p"), w.alias("w")).select("w", "p", F.explode(F.sequence(F.lit(order), F.size("p"))).alias("at"))
    grams = rows.select("w", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.array_join(F.slice("p", F.col("at") - n + 1, n - 1), "\x1f").alias("context"), F.get("p", F.col("at") - 1).alias("unit")) for n in range(1, order + 1)])).alias("g"))
    return grams.groupBy("g.n", "g.context", "g.unit").agg(F.sum("w").alias("c"))


class NgramModel:
    """Interpolated n-grams (Witten-Bell), as tables: (n, context, unit, c) and (n, context, total, types)."""

    def __init__(self, counts: DataFrame, order: int) -> None:
        self.counts, self.order = counts, order
        self.contexts = counts.groupBy("n", "context").agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        self.vocab = counts.where("n = 1").select("unit")

    @classmethod
    def fit(cls, sequences: DataFrame, order: int, units: str = "units", weight: str | None = None) -> NgramModel:
        return cls(ngram_counts(sequences, order, units, weight), order)

    def logprob(self, sequences: DataFrame, key: str, units: str = "units") -> DataFrame:
        """(key, logprob, n): natural log probability of each sequence with its end."""
        order = self.order
        padded = F.concat(F.array_repeat(F.lit(BEGIN), order - 1), F.col(units), F.array(F.lit(END)))
        at = sequences.select(key, padded.alias("p")).select(key, "p", F.explode(F.sequence(F.lit(order), F.size("p"))).alias("at"))
        steps = at.select(key, "at", F.get("p", F.col("at") - 1).alias("unit"), F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.array_join(F.slice("p", F.col("at") - n + 1, n - 1), "\x1f").alias("context")) for n in range(1, order + 1)])).alias("g")).select(key, "at", "unit", "g.n", "g.context")
        # one more unit than seen, for those that weren't
        size = self.vocab.agg((F.count("*") + 1).alias("v"))
        # the empty context is every step's, and common units' contexts are many steps'
        counted = lookup(written(steps, "steps"), self.counts, ["n", "context", "unit"])
        known = lookup(written(counted, "steps"), self.contexts, ["n", "context"]).crossJoin(F.broadcast(size))
        level = F.sort_array(F.collect_list(F.struct("n", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("types", F.lit(0)).alias("types"))))
        each = known.groupBy(key, "at").agg(level.alias("levels"), F.first("v").alias("v"))
        mix = lambda acc, s: F.when(s["total"] > 0, (s["c"] + s["types"] * acc) / (s["total"] + s["types"])).otherwise(acc)
        p = F.aggregate("levels", (F.lit(1.0) / F.col("v")).cast("double"), mix)
        return each.select(key, F.ln(p).alias("lp")).groupBy(key).agg(F.sum("lp").alias("logprob"), F.count("*").alias("n"))

    def word_logprob(self, words: DataFrame) -> DataFrame:
        """(word, logprob) of words(word) by a model of aksharas."""
        rows = words.select("word").distinct().withColumn("units", aksharas(F.col("word")))
        return self.logprob(rows, "word").select("word", "logprob")

    def sentence_logprob(self, sentences: DataFrame, key: str = "sentence_id") -> DataFrame:
        """(key, logprob) of sentences(key, words) by a model of words."""
        return self.logprob(sentences, key, "words").select(key, "logprob")


class Lexicon:
    """Words with frequencies, as a table (word, freq)."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    @classmethod
    def from_corpus(cls, lines: DataFrame, text: str = "value", mode: str = "any") -> Lexicon:
        """Words of lines, by white space."""
        return cls(lexicon_of(lines.select(F.explode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("word")), mode=mode))

    def contains(self, words: DataFrame) -> DataFrame:
        """(word, known) of words(word), normal forms compared."""
        asked = words.select("word").distinct().withColumn("normal", normalize(F.col("word")))
        held = self.table.select(F.col("word").alias("normal")).distinct().withColumn("known", F.lit(True))
        return asked.join(held, "normal", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))

    def nearest(self, words: DataFrame, max_distance: int = MAX_DISTANCE, limit: int | None = MAX_CANDIDATES) -> DataFrame:
        return nearest(words, self.table, max_distance, limit)


class Corrector:
    """A lexicon with its model of aksharas and, for words in context, one of words."""

    def __init__(self, lexicon: Lexicon, word_lm: NgramModel | None = None, akshara_lm: NgramModel | None = None, margin: float = MARGIN) -> None:
        self.lexicon, self.word_lm, self.margin = lexicon, word_lm, margin
        self.akshara_lm = akshara_lm or akshara_model(lexicon.table)

    def correct_words(self, words: DataFrame) -> DataFrame:
        return correct_words(words, self.lexicon.table, self.akshara_lm, margin=self.margin)

    def correct_sentences(self, sentences: DataFrame) -> DataFrame:
        """sentences(sentence_id, words, flags): in context if there is a model of words, else word by word."""
        if self.word_lm is not None:
            return correct_in_context(sentences, self.lexicon.table, self.akshara_lm, self.word_lm, margin=self.margin)
        found = self.correct_words(sentences.select(F.explode("words").alias("word")))
        return correct_sentences(sentences, found)


def akshara_model(lexicon: DataFrame, order: int = 4) -> NgramModel:
    """Aksharas of the lexicon's words, each word once."""
    return NgramModel.fit(lexicon.select(aksharas(F.col("word")).alias("units")), order)


def word_model(sentences: DataFrame, order: int = 3, text: str = "sentence") -> NgramModel:
    return NgramModel.fit(sentences.select(F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("units")), order)


def candidate_values(words: DataFrame, lexicon: DataFrame, model: NgramModel, weights: dict[str, float] = WEIGHTS, max_distance: int = MAX_DISTANCE, max_candidates: int = MAX_CANDIDATES, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(word, candidate, distance, freq, value) for each distinct word of words(word), itself included."""
    one = words.select("word").distinct()
    found = nearest(one, lexicon, max_distance, max_candidates).select("word", "candidate", "distance", "freq")
    own = one.join(lexicon.select("word", "freq"), "word", "left").select("word", F.col("word").alias("candidate"), F.lit(0).alias("distance"), F.coalesce("freq", F.lit(0)).alias("freq"))
    options = found.where("candidate <> word").unionByName(own)
    texts = options.select(F.col("candidate")).distinct().withColumn("units", aksharas(F.col("candidate")))
    scored = options.join(model.logprob(texts, "candidate").select("candidate", "logprob"), "candidate")
    size = F.greatest(F.size(aksharas(F.col("word"))), F.lit(1))
    value = F.lit(weights["lm"]) * F.col("logprob") / size - F.lit(weights["distance"]) * F.col("distance") + F.lit(weights["visual"]) * word_similarity(F.col("word"), F.col("candidate"), pairs) + F.lit(weights["frequency"]) * F.ln(1 + F.col("freq"))
    return scored.select("word", "candidate", "distance", "freq", value.alias("value"))


def _chosen(valued: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """The best candidate where it gains more than margin on a word that the lexicon lacks."""
    best = valued.groupBy(*keys).agg(
        F.max(F.when(F.col("candidate") == F.col("word"), F.struct("value", "freq"))).alias("own"),
        F.max(F.when(F.col("candidate") != F.col("word"), F.struct("value", (-F.col("distance")).alias("near"), "candidate"))).alias("best"),
    )
    accepted = F.coalesce((F.col("own.freq") == 0) & (F.col("best.value") - F.col("own.value") > margin), F.lit(False))
    return best.select(*keys, F.when(accepted, F.col("best.candidate")).otherwise(F.col("word")).alias("suggestion"), accepted.alias("accepted"), F.when(accepted, -F.col("best.near")).otherwise(0).alias("distance"), (F.col("best.value") - F.col("own.value")).alias("gain"))


def correct_words(words: DataFrame, lexicon: DataFrame, model: NgramModel, weights: dict[str, float] = WEIGHTS, margin: float = MARGIN, max_distance: int = MAX_DISTANCE, max_candidates: int = MAX_CANDIDATES, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(word, suggestion, accepted, distance, gain) for each distinct word of words(word)."""
    return _chosen(candidate_values(words, lexicon, model, weights, max_distance, max_candidates, pairs), ["word"], margin)


def correct_in_context(sentences: DataFrame, lexicon: DataFrame, model: NgramModel, context: NgramModel, weights: dict[str, float] = WEIGHTS, margin: float = MARGIN, max_distance: int = MAX_DISTANCE, max_candidates: int = MAX_CANDIDATES, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """sentences(sentence_id, words, flags) with corrected and text: flagged words in view of their neighbours.

    A candidate's gain is that of correct_words, and lm times the change of the context model's log
    probability over the words within its order, a step each.
    """
    reach = context.order - 1
    flags = F.coalesce("flags", F.transform("words", lambda w: F.lit(True)))
    each = sentences.select("sentence_id", "words", F.posexplode("words").alias("at", "word"), flags.alias("f")).withColumn("flag", F.get("f", F.col("at")))
    around = lambda start, n: F.slice("words", start, F.greatest(n, F.lit(0)))
    left = around(F.greatest(F.col("at") - reach, F.lit(0)) + 1, F.least(F.col("at"), F.lit(reach)))
    right = around(F.col("at") + 2, F.least(F.size("words") - F.col("at") - 1, F.lit(reach)))
    flagged = each.where("flag").select("sentence_id", "at", "word", left.alias("left"), right.alias("right"))
    gains = candidate_values(flagged, lexicon, model, weights, max_distance, max_candidates, pairs)
    options = flagged.join(gains, "word")
    keyed = options.withColumn("key", F.concat_ws("\x1f", "sentence_id", "at", "candidate")).withColumn("units", F.concat("left", F.array("candidate"), "right"))
    told = context.logprob(keyed, "key").select("key", F.col("logprob").alias("in_context"), F.col("n").alias("steps"))
    valued = keyed.join(told, "key").withColumn("value", F.col("value") + F.lit(weights["lm"]) * F.col("in_context") / F.col("steps"))
    best = _chosen(valued, ["sentence_id", "at", "word"], margin)
    fixed = each.join(best.select("sentence_id", "at", "suggestion"), ["sentence_id", "at"], "left").withColumn("out", F.coalesce("suggestion", "word"))
    return fixed.groupBy("sentence_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "out"))), lambda s: s["out"]).alias("corrected")).withColumn("text", F.array_join("corrected", " "))


def correct_sentences(sentences: DataFrame, corrections: DataFrame) -> DataFrame:
    """sentences(sentence_id, words, flags) with corrected: flagged words replaced, others as they are.

    Missing flags flag every word; flags of another length raise an error.
    """
    flags = F.coalesce("flags", F.transform("words", lambda w: F.lit(True)))
    checked = F.when(F.size(flags) != F.size("words"), F.raise_error(F.lit("flags must match the words"))).otherwise(F.arrays_zip(F.col("words").alias("word"), flags.alias("flag")))
    each = sentences.select("sentence_id", F.posexplode(checked).alias("at", "x")).select("sentence_id", "at", F.col("x.word").alias("word"), F.col("x.flag").alias("flag"))
    fixed = each.join(corrections.select("word", "suggestion"), "word", "left").withColumn("out", F.when(F.col("flag"), F.coalesce("suggestion", "word")).otherwise(F.col("word")))
    return fixed.groupBy("sentence_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "out"))), lambda s: s["out"]).alias("corrected")).withColumn("text", F.array_join("corrected", " "))


def is_equal_set(a: DataFrame, b: DataFrame) -> bool:
    """Both hold the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
