"""Arrays of token ids, probabilities and logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the special tokens, and the label that losses ignore.
PAD, BOS, EOS, UNK = 0, 1, 2, 3
SPECIALS = ["<pad>", "<s>", "</s>", "<unk>"]
IGNORED = -100


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column, empty: float = 0.0) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(F.lit(empty))


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def softmax(logits: Column) -> Column:
    shifted = let(F.array_max(logits).cast("double"), lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top)))
    return let(shifted, lambda s: let(total(s), lambda t: F.transform(s, lambda e: e / t)))


def log_softmax(logits: Column) -> Column:
    norm = lambda top: F.ln(total(F.transform(logits, lambda x: F.exp(x.cast("double") - top))))
    return let(F.array_max(logits).cast("double"), lambda top: let(norm(top), lambda n: F.transform(logits, lambda x: x.cast("double") - top - n)))


def normalized_entropy(probs: Column) -> Column:
    """Shannon entropy over its largest value, ln of the number of classes."""
    terms = F.transform(probs, lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0)))
    return F.when(F.size(probs) > 1, total(terms) / F.ln(F.size(probs).cast("double"))).otherwise(F.lit(0.0))


def margin(probs: Column) -> Column:
    """Largest less second largest probability; 1 for a single class."""
    best = F.sort_array(probs, asc=False)
    return F.when(F.size(probs) > 1, F.get(best, F.lit(0)) - F.get(best, F.lit(1))).otherwise(F.lit(1.0))


def argmax(values: Column) -> Column:
    """Place of the largest, the first on a tie; -1 if empty."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values)) - 1).otherwise(F.lit(-1)).cast("int")


def argmin(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.array_position(values, F.array_min(values)) - 1).otherwise(F.lit(-1)).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    # least and greatest pass over nulls
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def safe_divide(x: Column, y: Column, floor: float = 1.0) -> Column:
    return x / F.greatest(y, F.lit(floor))


def sequence_confidence(score: Column) -> Column:
    """A log score as confidence in [0, 1]; one half if there is none."""
    return F.coalesce(clamp(F.exp(score), 0.0, 1.0), F.lit(0.5))


def unmask(labels: Column, pad: int = PAD) -> Column:
    """Ignored labels as padding."""
    return F.transform(labels, lambda x: F.when(x < 0, F.lit(pad)).otherwise(x))


def pad_to(values: Column, length: Column | int, fill: int = IGNORED) -> Column:
    """Padded on the right; longer arrays stay whole."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(length - F.size(values), F.lit(0))))


def shift_left(values: Column) -> Column:
    return F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))


def linspace(bins: int) -> list[float]:
    """Edges 0, 1/bins, ... 1 as i * (1 / bins), the last exactly 1."""
    return [*(i * (1.0 / bins) for i in range(bins)), 1.0]
