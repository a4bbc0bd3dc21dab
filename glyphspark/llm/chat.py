"""Cumulative-snapshot collapse of logged conversations, then rendering.

A chat is often logged again after every turn, so the log holds its prefixes too. Each turn's
rolling hash covers all turns up to it: SHA-256 of the hash before and of the turn. A conversation
whose last hash is another's hash at an earlier turn is a prefix of that one; an anti-join against
the distinct earlier hashes keeps the maximal conversations. Equal conversations are one, under the
smallest conv_id. The kept ones are rendered. Turns without a conv_id can't be put together: each is
a conversation of its own, of one turn.

Turn text is hashed with lengths of its parts, so no two different prefixes read alike.

Scale. A conversation's own turns meet in one task, as its rendered value must; conversations meet
only by hash. Copies are folded to one row a last hash and earlier hashes to distinct ones, summed
in each task first, before the anti-join: a conversation logged by a third of all rows is one row.

Edge cases: a null role or text counts as empty text but hashes apart from it; turns sort by turn,
null first, then role and text; a turn that repeats exactly (same turn, role, text) counts once, but
without a conv_id each repetition is a copy; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _part(c: Column) -> Column:
    """A value that says its length; null differs from empty."""
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def _rolling(turns: Column) -> Column:
    """Hashes of every prefix of an array of (role, text)."""
    step = lambda acc, t: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")), _part(t["role"]), _part(t["text"])), 256)))
    return F.aggregate(turns, F.array().cast("array<string>"), step)


def render(turns: Column) -> Column:
    """Turns as one marked-up text."""
    one = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(f"{CLOSE}\n"))
    return F.array_join(F.transform(turns, one), "")


def conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation of turns(conv_id, turn, role, text): its turns in order, prefix hashes, and how often it is there."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set("row")).alias("turns")).withColumn("copies", F.lit(1).cast("long"))
    # counted, not collected, so that any number of them may be alike
    like = ["conv_id", F.col("row.role").alias("role"), F.col("row.text").alias("text")]
    alone = rows.where("conv_id is null").groupBy(*like).agg(F.min("row.turn").alias("turn"), F.count("*").alias("copies")).select("conv_id", F.array(F.struct("turn", "role", "text")).alias("turns"), "copies")
    return whole.unionByName(alone).withColumn("hashes", _rolling(F.col("turns")))


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations: conv_id, turns, hash, copies (equal conversations, itself included)."""
    whole = Scratch(turns.sparkSession, "chat").keep(conversations(turns), "conversations")
    # what needs no text: the last hash, and those before it
    last = F.element_at("hashes", -1)
    one = whole.select("conv_id", last.alias("hash"), "copies").groupBy("hash").agg(F.min("conv_id").alias("kept"), F.sum("copies").alias("copies"))
    earlier = whole.select(F.explode(F.slice("hashes", 1, F.greatest(F.size("hashes") - 1, F.lit(0)))).alias("hash")).distinct()
    maximal = one.join(earlier, "hash", "left_anti")
    texts = whole.select("conv_id", "turns", last.alias("of"))
    return maximal.join(texts, (F.col("hash") == F.col("of")) & F.col("kept").eqNullSafe(F.col("conv_id"))).select("conv_id", "turns", "hash", "copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and rendered text of the maximal conversations."""
    return collapse(turns).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", render(F.col("turns")).alias("rendered"))


#: The same by comparing the prefixes themselves.
ORACLE = """
WITH lone AS (SELECT turn, role, text, row_number() OVER (ORDER BY turn, role, text) AS own FROM conversations WHERE conv_id IS NULL),
t AS (SELECT DISTINCT conv_id, 0 AS own, turn, role, text FROM conversations WHERE conv_id IS NOT NULL UNION ALL SELECT NULL, own, turn, role, text FROM lone),
marked AS (SELECT *, coalesce(strlen(role)::VARCHAR || ':' || role, '-') || coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS part,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS shown FROM t),
prefixes AS (SELECT conv_id, own, string_agg(part, '') OVER w AS prefix, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id, own) AS n FROM marked
    WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)),
one AS (SELECT prefix, arg_min({'conv_id': conv_id, 'own': own}, (conv_id IS NULL, conv_id, own)) AS least, count(*) AS copies FROM prefixes WHERE k = n GROUP BY prefix),
kept AS (SELECT * FROM one WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE k < n))
SELECT m.conv_id, count(*) AS n_turns, any_value(k.copies) AS copies,
    string_agg(shown, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM kept k JOIN marked m ON m.conv_id IS NOT DISTINCT FROM k.least.conv_id AND m.own = k.least.own GROUP BY m.conv_id, m.own
"""
