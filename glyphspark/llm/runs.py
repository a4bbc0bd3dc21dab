"""Periodic runs of words by bit-parallel lags.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(LEAST, TIMES * q) that no neighbouring word extends keeping period q.

Method. The words of a text are numbered, and bit b of all numbers is one big integer, a plane.
At lag q each plane is XORed with itself shifted by q, and the results are ORed: a bit is zero where
words q apart are identical. A run is a long stretch of zeros, so the zeros' own bits are ANDed with
themselves shifted by 1, 2, 4 and so on, until only the first bits of sufficiently long stretches are left.

Not every lag needs its planes. A stretch of 3q places whose words recur q later has three multiples
of q in a row, so the words at four multiples are alike; all lags are screened for that at once, which
takes about n log n comparisons for n words. A place whose four multiples lie inside one run that is
known already is skipped, for a run of period q there would have a smaller period: of two periods of
such a stretch, their greatest common divisor is one too. Both screens are exact.

collapsed() drops the words that only repeat: those that a run contains after its first q.

Scale. A text meets no other, so rows aren't shuffled. A task holds one text's numbers, its different
words and its planes: some 4 bytes and as many bits as the largest number has, a word. A text's words
are read in parts of PART bytes, and lags are screened for PLACES places at a time.

Edge cases: null, empty and white-space texts have no words, no runs and the digests of nothing; rows
repeated are rows of their own; a null doc_id counts as the empty text where its checksum is taken; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship

#: A run has at least LEAST words, and TIMES its period.
LEAST, TIMES = 6, 4
#: Bytes of a text split at a time, places screened at a time, words joined at a time, texts handled at a time.
PART, PLACES, JOINED, TEXTS = 1 << 20, 1 << 20, 65_536, 256

_SPACE = re.compile(rb"[\x20\x09-\x0D]")

SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def numbered(text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word of a text, by first place, and the different words."""
    seen: dict[bytes, int] = {}
    parts, at, end = [], 0, len(text or b"")
    while at < end:
        cut = _SPACE.search(text, at + PART) if at + PART < end else None
        upto = cut.start() if cut else end
        parts.append(np.array([seen.setdefault(w, len(seen)) for w in text[at:upto].split()], np.int32))
        at = upto
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(seen)


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of every number as one big integer, word 0 lowest."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(bits)]


def stretches(planes: list[int], n: int, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the maximal stretches of `least` places or more whose words recur `lag` later."""
    places = n - lag
    differ = 0
    for plane in planes:
        differ |= plane ^ plane >> lag
    left = ~differ & (1 << places) - 1
    have = 1
    while have < least and left:
        step = min(have, least - have)
        left &= left >> step
        have += step
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a bit that differs from the one before begins or ends a stretch
    edges = (left ^ left << 1).to_bytes(places // 8 + 1, "little")
    at = np.flatnonzero(np.unpackbits(np.frombuffer(edges, np.uint8), bitorder="little"))
    return at[::2], at[1::2] - at[::2] + least - 1


def _candidates(ids: np.ndarray, times: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each lag, rising, with the places where words at `times` multiples of it in a row are alike."""
    n = len(ids)
    lags = np.arange(1, n // times + 1)
    counts = (n - 1) // lags - (times - 2)
    upto = np.cumsum(counts)
    begin = 0
    while begin < len(lags):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PLACES, "right")))
        each = counts[begin:end]
        lag = np.repeat(lags[begin:end], each)
        place = (np.arange(len(lag)) - np.repeat(np.cumsum(each) - each, each)) * lag
        for k in range(1, times):
            same = np.flatnonzero(ids[place] == ids[place + k * lag])
            place, lag = place[same], lag[same]
        cuts = np.flatnonzero(np.diff(lag)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(lag)], strict=True):
            if a < b:
                yield int(lag[a]), place[a:b]
        begin = end


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs of numbered words, by start, then period."""
    if times < 3:
        raise ValueError("a run must have three periods or more")
    n = len(ids)
    if n < least:
        return np.zeros((0, 3), np.int64)
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    bits: list[int] | None = None
    # to where a known run reaches that begins at or before a place
    reach = np.zeros(n, np.int64)
    for lag, places in _candidates(ids, times):
        if (reach[places] > places + (times - 1) * lag).all():
            continue
        bits = planes(ids) if bits is None else bits
        for start, length in zip(*(c.tolist() for c in stretches(bits, n, lag, max(least - lag, (times - 1) * lag))), strict=True):
            length += lag
            if (start, length) not in known:  # else its period is a multiple of the run's own
                known.add((start, length))
                found.append((start, length, lag))
                np.maximum(reach[start : start + length], start + length, out=reach[start : start + length])
    rows = np.array(found, np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run repeats."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def collapsed(ids: np.ndarray, words: list[bytes], runs: np.ndarray) -> Iterator[bytes]:
    """The kept words joined by one space, in parts."""
    left = ids[kept(len(ids), runs)]
    for at in range(0, len(left), JOINED):
        yield (b" " if at else b"") + b" ".join([words[i] for i in left[at : at + JOINED].tolist()])


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of several that with the smallest start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def planted(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with a repetition that doc_id's checksum may ask for: about every tenth text's end repeats."""
    n, h = len(ids), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if not n or h % 10:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


def _row(doc_id: int | None, text: bytes | None, least: int, times: int, plant: bool) -> tuple:
    ids, words = numbered(text)
    ids = planted(ids, doc_id) if plant else ids
    runs = runs_of(ids, least, times)
    best = strongest(runs)
    whole = sha256()
    for part in collapsed(ids, words, runs):
        whole.update(part)
    lines = sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist()).encode())
    return (doc_id, len(ids), len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], lines.hexdigest(), whole.hexdigest())


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, plant: bool = False) -> DataFrame:
    """For each row of docs(doc_id, text) its number of words and runs, its strongest run, and digests of all runs and of the collapsed text.

    start, length, period and exponent_milli are null where there is no run. plant repeats some texts' ends first (see planted).
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            rows = [_row(d, t, least, times, plant) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def collapsed_documents(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with all their columns, texts without the words that a run only repeats.

    A text without runs stays as it is, white space and all; another's kept words are joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                ids, words = numbered(text and text.encode())
                runs = runs_of(ids, least, times)
                out.append(b"".join(collapsed(ids, words, runs)).decode() if len(runs) else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
