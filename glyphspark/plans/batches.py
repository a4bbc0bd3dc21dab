"""Training batches of encoded labels, padded to the longest of each batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import PAD, pad_to, shift_left
from ..operators.prefix import once, running
from ..operators.vocab import encode


def collated(rows: DataFrame, vocab: Column, key: str = "row_id", text: str = "text", size: int = 24, max_length: int = 48, shift: bool = False) -> DataFrame:
    """(key, batch, labels, decoder_input_ids): rows in order of a numeric key, `size` to a batch.

    Labels are padded with the ignored label, inputs with PAD. With shift a label is the input's
    next token, for decoders that don't shift by themselves. Rows without a key are left out.
    """
    ids = once(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")), ids=encode(F.col("text"), vocab, max_length))
    placed = running(ids, "key", ["text"], {"place": F.lit(1)}).withColumn("batch", F.floor((F.col("place") - 1) / size))
    # at most `size` rows
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    padded = placed.withColumn("longest", longest)
    labels = pad_to(shift_left(F.col("ids")) if shift else F.col("ids"), F.col("longest"))
    return padded.select(F.col("key").alias(key), "batch", labels.alias("labels"), pad_to(F.col("ids"), F.col("longest"), PAD).alias("decoder_input_ids"))
