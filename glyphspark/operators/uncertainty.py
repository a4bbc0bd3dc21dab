"""Uncertainty of predictions: token statistics, sequence features, word results, and the model hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..functions import sequences as S
from ..functions.distance import akshara_error_rate
from ..functions.text import aksharas, characters
from .models import Model, sent
from .prefix import fresh
from .quantile import percentile


def token_statistics(df: DataFrame, logits: str = "logits") -> DataFrame:
    """df with token, prob, entropy and margin of one step's logits."""
    p = fresh(df, "probabilities")
    steps = df.withColumn(p, S.softmax(F.col(logits)))
    return steps.withColumns({"token": S.argmax(F.col(logits)), "prob": F.array_max(p), "entropy": S.normalized_entropy(F.col(p)), "margin": S.margin(F.col(p))}).drop(p)


def mc_disagreement(variants: Column, text: Column) -> Column:
    """Share of the extra readings that differ from text; 0 without any."""
    n = F.size(variants)
    return F.when(n > 0, F.size(F.filter(variants, lambda v: v != text)) / n).otherwise(F.lit(0.0))


def sequence_features(df: DataFrame) -> DataFrame:
    """df(text, token_probs, token_entropies, token_margins, mc_variants) with features of the sequence."""
    p, e, m = F.col("token_probs"), F.col("token_entropies"), F.col("token_margins")
    logs = F.transform(p, lambda x: F.ln(S.clamp(x, 1e-12, 1.0)))
    return df.withColumns({
        "mean_prob": S.mean(p), "min_prob": F.coalesce(F.array_min(p), F.lit(0.0)), "norm_logprob": S.mean(logs, -20.0),
        "mean_entropy": S.mean(e), "max_entropy": F.coalesce(F.array_max(e), F.lit(0.0)), "min_margin": F.coalesce(F.array_min(m), F.lit(0.0)),
        "mc_disagreement": mc_disagreement(F.col("mc_variants"), F.col("text")), "n_tokens": F.size(p), "weakest": S.argmin(p),
    })


def char_probs(text: Column, probs: Column) -> Column:
    """Each character with its probability; 0 where probabilities run out, and extra ones go."""
    return F.transform(characters(text), lambda c, i: F.struct(c.alias("char"), F.coalesce(F.get(probs, i), F.lit(0.0)).alias("prob")))


def truncate_at_end(tokens: Column, *others: Column) -> list[Column]:
    """Arrays cut before the first end or padding token."""
    stop = F.array_position(F.transform(tokens, lambda t: t.isin(S.EOS, S.PAD)), True)
    n = F.when(stop > 0, stop - 1).otherwise(F.size(tokens)).cast("int")
    return [F.slice(c, 1, F.greatest(n, F.lit(0))) for c in (tokens, *others)]


def word_results(df: DataFrame, low: float = 0.60) -> DataFrame:
    """df of sequence_features (and optional reference) as word results.

    confidence is the mean token probability; a word below low is flagged. error_rate is null
    without a reference.
    """
    ref = F.col("reference") if "reference" in df.columns else F.lit(None).cast("string")
    flagged = F.col("mean_prob") < low
    return df.withColumns({
        "confidence": F.col("mean_prob"), "char_probs": char_probs(F.col("text"), F.col("token_probs")),
        "flagged": flagged, "reasons": F.when(flagged, F.array(F.lit("low confidence"))).otherwise(F.array().cast("array<string>")),
        "error_rate": F.when(ref.isNotNull(), akshara_error_rate(aksharas(ref), aksharas(F.col("text")))),
        "word_length": F.size(aksharas(F.col("text"))), "character_count": F.length("text"),
    })


def response_statistics(words: DataFrame, by: str = "page_id") -> DataFrame:
    """Of each page: words, flagged, corrected (final differs from raw), mean accuracy."""
    n = F.count("*")
    return words.groupBy(by).agg(n.alias("n_words"), F.count_if("flagged").alias("n_flagged"), F.count_if(F.col("final") != F.col("raw")).alias("n_corrected"), (F.coalesce(F.sum("confidence"), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("mean_accuracy"))


def low_confidence_threshold(df: DataFrame, pct: float = 80.0, conf: str = "conf") -> DataFrame:
    """One row: the percentile of confidence, between neighbours linearly; null without any."""
    return df.sparkSession.range(1).select(F.lit(percentile(df, conf, pct / 100)).cast("double").alias("threshold"))


def correct_below(df: DataFrame, threshold: DataFrame, pred: str = "hyp", corrected: str = "corrected", conf: str = "conf") -> DataFrame:
    """df with after: the corrected word where confidence lies below the threshold."""
    limit = fresh(df, "threshold")
    one = threshold.select(F.col(threshold.columns[0]).alias(limit))
    return df.crossJoin(F.broadcast(one)).withColumn("after", F.when(F.col(conf) < F.col(limit), F.col(corrected)).otherwise(F.col(pred))).drop(limit)


#: What a model hook returns for each image.
PREDICTION = "text string, tokens array<int>, token_probs array<double>, token_entropies array<double>, token_margins array<double>, mc_variants array<string>"

#: What a model gives for one pass over one row.
READING = "text string, tokens array<int>, token_probs array<double>, token_entropies array<double>, token_margins array<double>"
#: Cost of the rows and passes of a task, about, where rows say theirs; else one each.
TASK_COST = 20_000


def _called(rows: DataFrame, model: Model, keep: list[str], schema: str, batch: int, args: tuple) -> DataFrame:
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = model.get()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                out = pd.DataFrame(read(part.to_dict("records"), *args))
                yield pd.concat([part[keep].reset_index(drop=True), out], axis=1)

    return rows.mapInPandas(run, schema)


def predict(images: DataFrame, load: Callable, name: str, keep: str = "image string", batch: int = 48, mc_passes: int = 0, weights: bytes | str | None = None) -> DataFrame:
    """Predictions of an injected model, batch by batch, each row with its kept columns.

    load(), or load(path) where there are weights, returns a function of (list of row dicts, mc_passes) that gives one dict of
    PREDICTION a row. A worker calls it once for all its tasks (see models); a failing row must be the model's own decision.
    """
    ship(images.sparkSession)
    kept = [f.split()[0] for f in keep.split(", ")]
    return _called(images, sent(images.sparkSession, load, name, weights), kept, f"{keep}, {PREDICTION}", batch, (mc_passes,))


def predict_passes(images: DataFrame, load: Callable, name: str, key: str, passes: int, keep: str = "image string", batch: int = 48, weights: bytes | str | None = None, cost: Column | None = None) -> DataFrame:
    """PREDICTION of each row, with a reading for each of `passes` further passes, which are rows of their own until they meet again.

    The model's function gets a list of row dicts that also hold pass (0 is the plain reading) and seed (of key and pass,
    the same however rows are dealt) and gives one dict of READING each. keep names key too. Rows and
    passes are dealt anew, to as many tasks as their cost asks for, so that long rows and many passes don't meet in one.
    """
    spark = images.sparkSession
    ship(spark)
    if not {"pass", "seed"}.isdisjoint(images.columns):
        raise ValueError("rows may not have columns called pass and seed")
    kept = [f.split()[0] for f in keep.split(", ")]
    total = images.agg(F.coalesce(F.sum(cost if cost is not None else F.lit(1)), F.lit(0))).first()[0]
    tasks = max(1, -(-int(total * (passes + 1)) // TASK_COST))
    each = images.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes)))).withColumn("seed", F.xxhash64(key, "pass"))
    dealt = each.repartition(min(tasks, 100_000), key, "pass")
    read = _called(dealt, sent(spark, load, name, weights), [*kept, "pass"], f"{keep}, pass int, {READING}", batch, ())
    fields = [f.split()[0] for f in READING.split(", ")]
    # passes are few, and were one row before
    plain = F.max(F.when(F.col("pass") == 0, F.struct(*kept, *fields)))
    more = F.sort_array(F.collect_list(F.when(F.col("pass") > 0, F.struct("pass", "text"))))
    return read.groupBy(F.col(key).alias("of_key")).agg(plain.alias("r"), more.alias("v")).select("r.*", F.transform("v", lambda x: x["text"]).alias("mc_variants"))
