"""Running metrics of evaluations as they come in: a line each so many words, as a stream.

The state of a run is three sums, kept by transformWithState, so that a stream that is stopped goes on from its
checkpoint. Distances are measured where the rows are read; what meets by run are two numbers a word.

Order: batches as they come, rows of a batch by key. A batch's rows of one run are sorted in one task, three
numbers each; how many come at once is up to the source (maxFilesPerTrigger, maxBytesPerTrigger).

Edge cases: null words measure as the batch operators measure them; a run whose words are fewer than `every` gives no line; a null
run is a run; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import ship
from ..operators.recognition import measured

EVERY = 500
LINES = "run string, seen long, accuracy double, mean_aer double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Running(StatefulProcessor):
    """Sums of one run: words seen, words right, error rates."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "seen long, right long, errors double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, right, errors = self.sums.get() if self.sums.exists() else (0, 0, 0.0)
        frames = [f[["key", "ok", "aer"]] for f in rows]
        new = pd.concat(frames).sort_values("key", kind="stable")
        # one after the other, as a single pass would add them
        rights = right + np.cumsum(new["ok"].to_numpy(np.int64))
        totals = np.cumsum(np.append(errors, new["aer"].to_numpy(np.float64)))[1:]
        counts = seen + 1 + np.arange(len(new))
        self.sums.update((int(counts[-1]), int(rights[-1]), float(totals[-1])))
        at = np.flatnonzero(counts % self.every == 0)
        if len(at):
            yield pd.DataFrame({"run": [key[0]] * len(at), "seen": counts[at], "accuracy": rights[at] / counts[at], "mean_aer": totals[at] / counts[at]})

    def close(self) -> None:
        pass


def running_lines(pairs: DataFrame, key: str = "row_id", run: str | None = None, every: int = EVERY) -> DataFrame:
    """(run, seen, accuracy, mean_aer) after each `every` words of a run, over a stream of pairs(key, ref, hyp).

    The session must keep its state in RocksDB (see with_rocks).
    """
    ship(pairs.sparkSession)
    m = measured(pairs).select((F.col(run).cast("string") if run else F.lit("")).alias("run"), F.col(key).alias("key"), F.col("exact").cast("int").alias("ok"), "aer")
    return m.groupBy("run").transformWithStateInPandas(statefulProcessor=Running(every), outputStructType=LINES, outputMode="Append", timeMode="None")


def with_rocks(spark: SparkSession) -> SparkSession:
    """The session, with streaming state in RocksDB, as transformWithState asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def run_to_end(lines: DataFrame, out: str, checkpoint: str) -> None:
    """Everything that is there now, each line once, as Parquet below out; called again, it goes on from where it was."""
    query = lines.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
