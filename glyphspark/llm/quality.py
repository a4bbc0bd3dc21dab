"""Quality by attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE bytes, all of its text. A passage's input is how often
each pair of adjoining byte classes (lower case, upper case, digit, space, kinds of punctuation,
parts of other characters) and each of GRAMS groups of byte trigrams, A-Z lower-cased, occurs, as
square roots of shares, and its length. An encoder of one
layer makes h of it; gated attention weighs the passages of a document, and the weighted sum is
scored:

    h = tanh(x W + b)    e = w . (tanh(h V) * sigmoid(h U))    a = softmax of e over the document
    score = sigmoid(c . sum(a h) + c0)

Only document labels teach it: encoder, attention and score are trained together, by Adam on
cross-entropy with both classes weighing the same. lang, source and doc_id are no inputs.

Scale. The sample of labelled documents is bounded: of each class those with the least seeded hash, at most SAMPLE, and
whole: in that order a document is taken if its passages still fit into PASSAGES, else passed over. Their counts are what the driver
receives, some 1.5 kB a passage. Of several texts of a doc_id it learns from that with the least hash. Scoring is one pass in which no row leaves its task;
passages are encoded a few megabytes at a time, and a long text keeps only its encoded passages.

Edge cases: a null or empty text is one empty passage and gets a score like any other; a doc_id
with several labels takes their mean, one half or more counting as 1, and null labels are none;
where a class has no label every score is that of the labels' share, (ones + 1) / (labels + 2);
repeated rows are scored row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from .common import Scratch, bucket, pack, trim, unpack

PASSAGE = 512
#: Labelled documents of each class that the model learns from, and all passages of these documents, at most.
SAMPLE, PASSAGES = 2_000, 24_000
#: Groups of byte trigrams.
GRAMS = 512
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE = 24, 64, 0.01
DECAY, GRAM_DECAY = 1e-5, 2e-4
SEED = 11
#: Bytes encoded, and texts scored, at a time.
CHUNK, TEXTS = 500_000, 512
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

CLASSES = 16


def _classes() -> np.ndarray:
    table = np.full(256, 5, np.int64)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\r\n", "\t\x0b\x0c", ".", ",;:", "!?", "|", "$%&#*@^~+=<>", "\"'`()[]{}", "-_/\\"]
    for i, g in enumerate(groups):
        table[list(g.encode())] = i
    table[0x80:0xC0], table[0xC0:0xE0], table[0xE0:] = 13, 14, 15
    return table


TABLE = _classes()
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint32)
PAIRS = CLASSES * CLASSES
WIDTH = PAIRS + GRAMS + 1


def grams(text: bytes) -> np.ndarray:
    """The group of each byte trigram: high bits of a product."""
    b = LOWER[np.frombuffer(text, np.uint8)]
    return ((b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]) * np.uint32(2654435761) >> np.uint32(23)).astype(np.int64)


def counts(text: bytes) -> np.ndarray:
    """(passages, WIDTH) counts of class pairs and trigrams, and bytes, of at most CHUNK bytes of text."""
    n = max(1, -(-len(text) // PASSAGE))
    kinds = TABLE[np.frombuffer(text, np.uint8)]
    out = np.zeros((n, WIDTH), np.int32)
    each = lambda kind, width: np.bincount(np.arange(len(kind)) // PASSAGE * width + kind, minlength=n * width).reshape(n, width)
    if len(kinds) > 1:
        out[:, :PAIRS] = each(kinds[:-1] * CLASSES + kinds[1:], PAIRS)
    if len(kinds) > 2:
        out[:, PAIRS:-1] = each(grams(text), GRAMS)
    out[:, -1] = np.clip(len(kinds) - np.arange(n) * PASSAGE, 0, PASSAGE)
    return out


def inputs(found: np.ndarray) -> np.ndarray:
    x = found.astype(np.float32)
    size = x[:, -1].copy()
    x /= np.maximum(size, 1)[:, None]
    np.sqrt(x, out=x)
    x[:, -1] = np.log2(1 + size) / np.float32(np.log2(1 + PASSAGE))
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder, gated attention and score, or one score for all."""

    def __init__(self, constant: float | None = None, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.constant = constant
        scale = lambda *s: rng.normal(size=s) / np.sqrt(s[0])
        self.p = {"W": scale(WIDTH, HIDDEN) * 4, "b": np.zeros(HIDDEN), "V": scale(HIDDEN, GATE), "U": scale(HIDDEN, GATE), "w": scale(GATE), "c": scale(HIDDEN), "c0": np.zeros(1)}

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["W"] + self.p["b"])

    def attend(self, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        """Attention and logit of bags, each a run of rows of h."""
        p = self.p
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"t": t, "g": g, "a": a, "z": z, "logit": z @ p["c"] + p["c0"][0]}

    def gradients(self, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, np.cumsum(sizes) - sizes
        h = self.encode(x)
        f = self.attend(h, starts, sizes)
        dy = (_sigmoid(f["logit"]) - labels) * weights / len(labels)
        dz = np.repeat(dy[:, None] * p["c"], sizes, axis=0)
        a = f["a"]
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "c0": dy.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
        rng = np.random.default_rng(seed + 1)
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        # single precision for the many small steps
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        labels, weight = labels.astype(np.float32), weight.astype(np.float32)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step, total = 0, epochs * -(-len(bags) // BATCH)
        decay = np.full((WIDTH, 1), DECAY, np.float32)
        decay[PAIRS:-1] = GRAM_DECAY  # many rare inputs, which would learn single documents
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                x = inputs(np.concatenate([bags[i] for i in own]))
                step += 1
                now = rate * (1 - step / (total + 1))
                for k, g in self.gradients(x, np.array([len(bags[i]) for i in own]), labels[own], weight[own]).items():
                    g = g + (decay if k == "W" else DECAY) * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - np.float32(now / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
        self.p = {k: x.astype(float) for k, x in self.p.items()}
        return self

    def explain(self, text: bytes) -> tuple[float, np.ndarray]:
        """Score, and the weight of each passage."""
        h = np.concatenate([self.encode(inputs(counts(text[i : i + CHUNK // PASSAGE * PASSAGE]))) for i in range(0, max(1, len(text)), CHUNK // PASSAGE * PASSAGE)])
        f = self.attend(h, np.array([0]), np.array([len(h)]))
        return float(_sigmoid(f["logit"])[0]), f["a"]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        encoded, sizes, held, n = [], [], [], 0
        small = self.p["W"].astype(np.float32)

        def flush() -> None:
            if held:
                encoded.append(np.tanh(inputs(np.concatenate(held)) @ small + self.p["b"]))
                held.clear()

        piece = CHUNK // PASSAGE * PASSAGE
        for t in texts:
            sizes.append(max(1, -(-len(t) // PASSAGE)))
            for i in range(0, max(1, len(t)), piece):
                held.append(counts(t[i : i + piece]))
                n += len(held[-1])
                if n * PASSAGE >= piece:
                    flush()
                    n = 0
        flush()
        sizes = np.array(sizes)
        return _sigmoid(self.attend(np.concatenate(encoded), np.cumsum(sizes) - sizes, sizes)["logit"])


def _whole(text: bytes) -> np.ndarray:
    """Counts of all passages of a text, as scores() makes them."""
    piece = CHUNK // PASSAGE * PASSAGE
    return np.concatenate([counts(text[i : i + piece]).astype(np.uint16) for i in range(0, max(1, len(text)), piece)])


def _counted(most: int):
    """A labelled document's passages, and their counts, packed; null for one that no sample can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1) for whole in batches for at in range(whole.num_rows)):
            text = batch.column(2)[0].as_py() or b""
            n = max(1, -(-len(text) // PASSAGE))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([n], pa.int64()), pa.array([pack(_whole(text)) if n <= most else None], pa.binary()), batch.column(3)], names=["doc_id", "label", "n", "bag", "h"])

    return run


def chosen(candidates: list[tuple[int, int, int]], most: int) -> list[int]:
    """doc_ids of candidates(doc_id, label, passages), in order, that fit: each whole, and at most so many passages of a label."""
    left, out = {}, []
    for doc_id, label, n in candidates:
        if n <= left.setdefault(label, most):
            left[label] -= n
            out.append(doc_id)
    return out


def _sampled(docs: DataFrame, picked: list, seed: int, passages: int) -> list:
    """Rows (doc_id, label, bag) of the picked (doc_id, label) that fit into the sample, in their order."""
    spark, place = docs.sparkSession, {r.doc_id: i for i, r in enumerate(picked)}
    # at most 2 * SAMPLE ids
    ids = F.broadcast(spark.createDataFrame([(r.doc_id, r.label) for r in picked], "doc_id long, label int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(ids, "doc_id").select("doc_id", "label", "text", F.xxhash64("text", F.lit(seed)).alias("h"))
    bags = texts.mapInArrow(_counted(passages), "doc_id long, label int, n long, bag binary, h long").groupBy("doc_id").agg(F.min_by(F.struct("label", "n", "bag"), "h").alias("b")).select("doc_id", "b.*")
    held = Scratch(spark, "quality").keep(bags, "bags")
    fitting = chosen(sorted(((r.doc_id, r.label, r.n) for r in held.select("doc_id", "label", "n").collect()), key=lambda r: place[r[0]]), passages)
    # at most 2 * passages passages
    return held.join(F.broadcast(spark.createDataFrame([(i,) for i in fitting], "doc_id long")), "doc_id").select("doc_id", "label", "bag").collect()


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, seed: int = SEED, passages: int = PASSAGES) -> Model:
    """Learn from labels(doc_id, quality) of docs(doc_id, text) for which learn holds."""
    spark = docs.sparkSession
    ship(spark)
    learn = bucket(F.col("doc_id"), 3) != 1 if learn is None else learn
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label")).where(learn)
    of = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    picked = [of.where(F.col("label") == c).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).collect() for c in (0, 1)]
    own = _sampled(docs, [r for p in picked for r in p], seed, passages) if all(picked) else []
    if len({r.label for r in own}) < 2:
        ones, n = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
        return Model((ones + 1) / (n + 2))
    own.sort(key=lambda r: r.doc_id)
    return Model(seed=seed).fit([unpack(r.bag)[0] for r in own], np.array([r.label for r in own], float))


def _scoring(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                score = model.scores([t or b"" for t in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        trim()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_scoring(sent), SCHEMA)


def filter_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of docs that score at least threshold, with all their columns; decided row by row."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array(sent.value.scores([t or b"" for t in texts]) >= threshold))
        trim()

    return docs.mapInArrow(run, docs.schema)
