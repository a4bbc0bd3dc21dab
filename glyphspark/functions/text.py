"""Text algebra on columns: normal form, grapheme clusters (aksharas), script tests, code points.

All of it runs in the JVM. NFC has no built-in function: texts that it might change, told by a search,
go through ICU, which Spark ships; a normal form can't stand inside an aggregate function for that, so
select it first. Names of code points are ICU's too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Devanagari character classes that define an akshara.
CONSONANT = r"[\u0915-\u0939\u0958-\u095F\u0978-\u097F]"
VOWEL = r"[\u0904-\u0914\u0960\u0961\u0972-\u0977]"
MATRA = r"[\u093A\u093B\u093E-\u094C\u094E\u094F\u0955-\u0957\u0962\u0963]"
HALANT = r"\u094D"
NUKTA = r"\u093C"
SIGN = r"[\u0900-\u0903]"
DIGIT = r"[\u0966-\u096F]"
PUNCTUATION = r"[\u0964\u0965\u0970\u0971]"
AVAGRAHA = r"\u093D"
DEVANAGARI = r"\u0900-\u097F"

# Precomposed nukta consonants and what they fold to.
FOLDS = {
    "\u0929": "\u0928\u093C",
    "\u0931": "\u0930\u093C",
    "\u0934": "\u0933\u093C",
    "\u0958": "\u0915\u093C",
    "\u0959": "\u0916\u093C",
    "\u095A": "\u0917\u093C",
    "\u095B": "\u091C\u093C",
    "\u095C": "\u0921\u093C",
    "\u095D": "\u0922\u093C",
    "\u095E": "\u092B\u093C",
    "\u095F": "\u092F\u093C",
}

# White space as Python's str.isspace has it.
SPACE = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def akshara_pattern() -> str:
    """One cluster: joined consonants, a base, its signs; else any one character but a line feed."""
    letter = f"{CONSONANT}{NUKTA}?"
    base = f"(?:{letter}|{VOWEL}|{AVAGRAHA})"
    cluster = f"(?:{letter}{HALANT})*{base}{MATRA}*{NUKTA}?{SIGN}*{HALANT}?"
    # (?d): a dot leaves out the line feed alone
    return f"(?d){cluster}|{DIGIT}|{PUNCTUATION}|."


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    # most texts have none there, and need no search from end to end
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(SPACE), F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")).otherwise(text)


def fold(text: Column) -> Column:
    """Precomposed nukta consonants as base and nukta."""
    folded = text
    for one, parts in FOLDS.items():
        folded = F.replace(folded, F.lit(one), F.lit(parts))
    return F.when(text.rlike(f"[{''.join(FOLDS)}]"), folded).otherwise(text)


# What NFC leaves as it is, Devanagari aside, begins below U+0300; where it can change a text there is a
# mark of another script, two marks that may be out of order, a conjoining Hangul letter, or a character
# that stands for another one.
LATIN = r"[^\u0000-\u02FF]"
UNCOMPOSED = r"[\p{M}&&[^\u0900-\u0963]]|[\u093C\u094D\u0951-\u0954]{2}|[\u1160-\u11FF\u0340-\u0344\u0374\u037E\u0387\u0958-\u095F\u09DC-\u09DF\u0A33-\u0A5E\u0B5C\u0B5D\u0F43-\u0FB9\u1F00-\u1FFF\u2000\u2001\u2126-\u212B\u2329\u232A\u2ADC\uF900-\uFAFF\uFB1D-\uFB4E\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"


def composed(text: Column) -> Column:
    """Unicode NFC, but for nukta letters written apart, which fold() would take apart again."""
    through = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False))
    return F.when(text.rlike(UNCOMPOSED), through).otherwise(text)


def normalize(text: Column) -> Column:
    """Canonical form: NFC, nukta folds, strip."""
    return F.when(text.rlike(LATIN), strip(fold(composed(text)))).otherwise(strip(text))


def aksharas(text: Column) -> Column:
    """Grapheme clusters of the normal form."""
    return F.regexp_extract_all(normalize(text), F.lit(akshara_pattern()), F.lit(0))


def akshara_count(text: Column) -> Column:
    """Number of clusters, without making them; outside Devanagari each character but a line feed is one."""
    normal = normalize(text)
    plain = F.length(F.translate(normal, "\n", ""))
    return F.when(text.rlike(f"[{DEVANAGARI}]"), F.regexp_count(normal, F.lit(akshara_pattern()))).otherwise(plain).cast("int")


def characters(text: Column) -> Column:
    """Code points as an array of one-character strings."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def devanagari_ratio(text: Column, of_all: bool = False) -> Column:
    """Share of code points in U+0900..097F among those that are not space (or among all); 0 if none."""
    rest = text if of_all else F.regexp_replace(text, SPACE, "")
    inside = F.length(F.regexp_replace(rest, f"[^{DEVANAGARI}]", ""))
    # most texts that have none are told by a search, without being copied
    return F.when(text.rlike(f"[{DEVANAGARI}]"), inside / F.length(rest)).otherwise(F.lit(0.0))


def is_devanagari(text: Column, mode: str = "ratio", threshold: float = 0.5) -> Column:
    """mode ratio: at least threshold of the visible code points; any: at least one."""
    if mode == "any":
        return text.rlike(f"[{DEVANAGARI}]")
    if mode != "ratio":
        raise ValueError("mode is ratio or any")
    if threshold <= 0:
        return text.rlike(f"[^{SPACE[1:]}")
    return devanagari_ratio(text) >= threshold


def codepoints(text: Column, first: int | None = None) -> Column:
    """U+XXXX of each code point."""
    chars = characters(text)
    chars = chars if first is None else F.slice(chars, 1, first)
    # UTF-32 is big-endian without a mark
    return F.transform(chars, lambda c: F.concat(F.lit("U+"), F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0{1,4}", "")))


def codepoint_names(text: Column, first: int = 6) -> Column:
    """'U+XXXX NAME' of the first code points, by ICU's names; those without a name get a question mark."""
    name = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("getName"), F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))
    chars = F.slice(characters(text), 1, first)
    return F.zip_with(codepoints(text, first), F.transform(chars, name), lambda point, named: F.concat(point, F.lit(" "), F.when(named == "null", "?").otherwise(named)))


def join_words(words: Column) -> Column:
    return F.array_join(words, " ")
