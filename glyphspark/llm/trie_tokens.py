"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A text is cut at white space ([\\x20\\x09-\\x0D]+) into pre-tokens; each gets the vocabulary's
word mark in front. A pre-token's segmentation is the one with the highest sum of piece scores,
and among equal sums the one with fewest pieces. A character that no piece covers costs UNKNOWN
below the lowest score and counts as its UTF-8 bytes (byte fallback).

The distinct pre-tokens of TEXTS rows form a trie, walked in sorted order: the forward state
(best score, fewest pieces) of a node depends on its prefix alone, so it is computed once for all
pre-tokens below it, and the state of a terminal node is stored as that pre-token's count. Stored
terminals are kept from batch to batch and task to task, CACHE of them a worker besides those of
the batch at hand (the oldest half goes when full; that changes no result). Rows never leave their
task: no shuffle, no collection, no skew.

The vocabulary is a file of a public tokenizer, its path a parameter; the driver reads it and
sends it out, about half a megabyte whatever the corpus. Nothing is trained. A file of merges holds
an order instead of probabilities, so scores are logarithms of Zipf's law over that order: the
piece of rank r has a share of 1 / (r + OFFSET), and all shares sum to one. With that offset no two
pieces beat a whole one that they make, so words that are pieces count one. Any other scores can be
given as a Vocabulary.

Edge cases: null, empty and white-space texts have 0 pre-tokens and 0 tokens; repeated
rows are counted row by row; a null doc_id stays null; an empty table gives no rows; columns other
than doc_id and text are ignored. A pre-token of n characters costs n states whatever its length.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Stored terminals a worker keeps.
CACHE = 1_000_000
#: Texts whose pre-tokens form one trie.
TEXTS = 1_024
UNKNOWN = 10.0
#: Flattens the first ranks: those pieces are mostly parts of later ones.
OFFSET = 75
MARK = "▁"
SCHEMA = "doc_id long, n_pretokens long, n_tokens long"


class Vocabulary:
    """Pieces with scores, and what an uncovered character costs."""

    def __init__(self, pieces: dict[str, float], mark: str) -> None:
        self.pieces, self.mark = pieces, mark
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN

    @classmethod
    def by_rank(cls, pieces: list[str], mark: str = MARK, offset: float = OFFSET) -> Vocabulary:
        """Scores by Zipf's law for pieces in order of frequency."""
        shares = [1 / (r + offset) for r in range(1, len(pieces) + 1)]
        total = math.fsum(shares)
        return cls({p: math.log(s / total) for p, s in zip(pieces, shares, strict=True)}, mark)

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        found = [(sp.get_score(i), i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not odd(i)]
        # a pre-token has one mark, so that runs of them are in none; the mark alone comes last
        ranked = [p for _, _, p in sorted(found, key=lambda x: (-x[0], x[1])) if p.strip(MARK)]
        return cls.by_rank([*ranked, MARK])


class TrieCounter:
    """Counts of distinct pre-tokens; forward states are shared along the trie's paths."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE) -> None:
        self.v, self.cache = vocabulary, cache
        self.terminals: dict[bytes, int] = {}
        self.nodes = 0

    def insert(self, words: set[bytes]) -> None:
        """Store the terminals of words not stored yet."""
        new = sorted(w.decode("utf-8", "replace") for w in words if w not in self.terminals)
        if len(self.terminals) + len(new) > self.cache:
            keep = list(self.terminals.items())[len(self.terminals) // 2 :]
            # those in use stay whatever their age
            self.terminals = dict(keep) | {w: self.terminals[w] for w in words if w in self.terminals}
        get, longest, unknown = self.v.pieces.get, self.v.longest, self.v.unknown
        mark = self.v.mark
        # states of the path from the root to the current node; position 0 is before the mark
        score, count = [0.0], [0]
        path = ""
        for word in new:
            text = mark + word
            shared = 0
            for a, b in zip(path, text, strict=False):
                if a != b:
                    break
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                self.nodes += 1
                c = text[end - 1]
                # one character that no piece covers, as bytes
                best, fewest = score[end - 1] + unknown, count[end - 1] + (len(c.encode()) if c > "\x7f" else 1)
                for begin in range(max(0, end - longest), end):
                    s = get(text[begin:end])
                    if s is not None:
                        s += score[begin]
                        if s > best or s == best and count[begin] + 1 < fewest:
                            best, fewest = s, count[begin] + 1
                score.append(best)
                count.append(fewest)
            path = text
            self.terminals[word.encode()] = count[-1]


#: A worker's counter, by the name of its run; the one in use alone is kept.
_COUNTERS: dict[str, TrieCounter] = {}


def kept(run_name: str, make) -> TrieCounter:
    """The worker's counter of that run, made if it has another's or none."""
    if run_name not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[run_name] = make()
    return _COUNTERS[run_name]


def _counting(sent, cache: int, run_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # this function is sent by value, with copies of what it names; the module is the worker's own
        from glyphspark.llm import trie_tokens

        counter = trie_tokens.kept(run_name, lambda: TrieCounter(sent.value, cache))
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            texts = [t.split() if t else [] for t in batch.column(1).to_pylist()]
            counter.insert({w for t in texts for w in t})
            count = counter.terminals.__getitem__
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(map(count, t)) for t in texts], pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: Vocabulary | None = None, cache: int = CACHE) -> DataFrame:
    """doc_id, n_pretokens and n_tokens for each row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_counting(sent, cache, uuid.uuid4().hex), SCHEMA)
