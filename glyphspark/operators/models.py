"""Models inside tasks: weights by their content through Spark's files, loaded once a worker.

A model is its weights and the function that loads them. Its key is a digest of both, so two models of one
name in a session are two models. Weights go to the executors as one file each, named by that key. A worker keeps the MOST
models that it used last, across tasks.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkFiles, cloudpickle
from pyspark.sql import SparkSession

#: Models that a worker keeps.
MOST = 2

#: Of this worker, by key, the last used one last. Functions sent to tasks reach it by importing this module.
_LOADED: OrderedDict[str, object] = OrderedDict()

#: Files of weights that a context has been given, by its id.
_SENT: dict[str, set[str]] = {}


@dataclass(frozen=True)
class Model:
    """What a task needs to get a model: its key, whether there is a file of weights, and the pickled load function."""

    key: str
    has_weights: bool
    load: bytes

    def get(self):
        """The model, loaded if this worker hasn't it; load is called with the path of the weights, if there are any."""
        model = _LOADED.get(self.key)
        if model is None:
            load = cloudpickle.loads(self.load)
            model = load(SparkFiles.get(self.key)) if self.has_weights else load()
            _LOADED[self.key] = model
        _LOADED.move_to_end(self.key)
        while len(_LOADED) > MOST:
            _LOADED.popitem(last=False)
        return model


def sent(spark: SparkSession, load: Callable, name: str = "model", weights: bytes | str | None = None) -> Model:
    """Give the executors a model: load() or load(path of the weights) makes it. weights: bytes, or the path of a file on the driver."""
    pickled = cloudpickle.dumps(load)
    digest = hashlib.sha256(pickled)
    if isinstance(weights, str):
        with open(weights, "rb") as f:
            digest.update(hashlib.file_digest(f, "sha256").digest())
    elif weights is not None:
        digest.update(hashlib.sha256(weights).digest())
    key = f"{name}-{digest.hexdigest()}"
    there = _SENT.setdefault(spark.sparkContext.applicationId, set())
    if weights is not None and key not in there:
        path = os.path.join(tempfile.mkdtemp(), key)
        if isinstance(weights, str):
            shutil.copyfile(weights, path)
        else:
            with open(path, "wb") as f:
                f.write(weights)
        spark.sparkContext.addFile(path)
        there.add(key)
    return Model(key, weights is not None, pickled)
