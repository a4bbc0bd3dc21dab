"""Edit distance over arrays of units, and the error rate of one reading of a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of a pair are written as private-use characters; so many fit.
PRIVATE_USE, MOST_UNITS = 0xE000, 6400


def _coded(units: Column, alphabet: Column) -> Column:
    """Each unit as one private-use character, by its place in the pair's alphabet."""
    code = lambda u: F.decode(F.unhex(F.hex(F.array_position(alphabet, u) + (PRIVATE_USE - 1))), "UTF-16BE")
    return F.array_join(F.transform(units, code), "")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of strings, unit costs; null if either is.

    Where all units are single characters the arrays are compared as text, in generated code;
    otherwise the pair's units become one character each first. Time is the product of the lengths:
    meant for words and lines. More than MOST_UNITS different units in a pair raise an error.
    """
    single = (F.length(F.array_join(a, "")) == F.size(a)) & (F.length(F.array_join(b, "")) == F.size(b))
    alphabet = F.array_union(a, b)
    checked = F.when(F.size(alphabet) > MOST_UNITS, F.raise_error(F.lit("too many different units to compare"))).otherwise(alphabet)
    return F.when(single, F.levenshtein(F.array_join(a, ""), F.array_join(b, ""))).otherwise(F.levenshtein(_coded(a, checked), _coded(b, checked)))


def within(a: Column, b: Column, most: int) -> Column:
    """edit_distance where it is at most `most`, else -1; gives up early.

    Arrays that differ by more units than `most`, in number or in kind, are far apart without being compared.
    """
    alphabet = F.array_union(a, b)
    # an edit brings or takes one kind of unit at most on either side
    kinds = F.greatest(F.size(F.array_except(a, b)), F.size(F.array_except(b, a)))
    far = (F.abs(F.size(a) - F.size(b)) > most) | (kinds > most)
    single = (F.length(F.array_join(a, "")) == F.size(a)) & (F.length(F.array_join(b, "")) == F.size(b))
    checked = F.when(F.size(alphabet) > MOST_UNITS, F.raise_error(F.lit("too many different units to compare"))).otherwise(alphabet)
    plain = F.levenshtein(F.array_join(a, ""), F.array_join(b, ""), most)
    return F.when(far, -1).when(single, plain).otherwise(F.levenshtein(_coded(a, checked), _coded(b, checked), most))


def error_rate(distance: Column, ref_size: Column, hyp_size: Column) -> Column:
    """distance / length of the reference; for an empty one 0 if nothing was read, else 1. May exceed 1."""
    return F.when(ref_size == 0, F.when(hyp_size == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(distance / ref_size)


def akshara_error_rate(ref: Column, hyp: Column) -> Column:
    """Error rate of two akshara arrays."""
    return error_rate(edit_distance(ref, hyp), F.size(ref), F.size(hyp))


def exact(ref: Column, hyp: Column) -> Column:
    """Equal akshara arrays."""
    return ref == hyp
