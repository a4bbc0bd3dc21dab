"""A corpus from raw documents to packed sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes and reads again
as the next stage's docs. All but the last return the columns of documents, whatever these are.

1. quality: documents that the classifier scores below one half go. It learns from labels.
2. near_duplicates: of each group of near copies (see similar_groups: SimHash links, checked exactly, then
   what fingerprints miss) one text stays, as one row: that of the smallest doc_id. Rows are told apart by
   text, so that another text of the same doc_id is unaffected.
3. mix: sources meet their target weights; a document taken twice is two rows, one not taken goes.
4. pack: pieces of documents with their bins. Two rows of equal words, or of one source, never share one.

Nulls, empty texts, repeated rows and extra columns: as each operator says. A stage of no rows
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphspark.llm.common import Scratch, clear, few, made, table
from glyphspark.llm.jaccard import node
from glyphspark.llm.mixing import mixed_documents
from glyphspark.llm.packing import pack_documents
from glyphspark.llm.quality import filter_documents, train
from glyphspark.llm.simhash import similar_groups


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = similar_groups(docs).where("kept")
    # by text and doc_id: a doc_id may have several texts, and a text several doc_ids
    key = lambda text_node, doc_id: F.concat_ws(":", text_node.cast("string"), doc_id.cast("long").cast("string"))
    stay = kept.select(key(F.col("id"), F.col("first")).alias("key"))
    rows = docs.select(F.struct("*").alias("row"), key(node(F.col("text").cast("binary")), F.col("doc_id")).alias("key"))
    # rows of one doc_id and text are one document; folded and joined by one key, texts are shuffled once
    return rows.dropDuplicates(["key"]).join(stay, "key", "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return few(pack_documents(docs).drop("cluster"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: No SQL says what the classifier, the components, the budget fit and the packing do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents. What a stage wrote goes when the next one is written; the result reads the last one's table."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        mark = made()
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        clear(spark, mark)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
