"""The queries of this subpackage, with production parameters over whole tables, and SQL where it can say the same.

Results come in few partitions (see common.few), as they are mostly written next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, table


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"))


def op2_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie_tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op3_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ball_tree import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def op4_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cross_polytope import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first_page FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first_page <> page_id THEN first_page END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_apart

    return pack_apart(table(spark, sf_dir, "documents")).drop("cluster")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), plant=True).drop("n_words")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def _written(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return wraps(query)(lambda spark, sf_dir: few(query(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _written(f) for f in (op1_katz, op2_trie_tokens, op3_ball_tree, op4_quality_mil, op5_cross_polytope, op6_simhash, op7_warc, op8_mixing, op9_packing, op10_chat, op11_periodic_runs, op12_ranked_search, op13_license_scan)
}


def _oracles() -> dict[str, str]:
    from . import chat, katz, licenses, ranked

    return {"op1_katz": katz.ORACLE, "op3_ball_tree": OP3_SQL, "op7_warc": OP7_SQL, "op10_chat": chat.ORACLE, "op12_ranked_search": ranked.ORACLE, "op13_license_scan": licenses.oracle()}


ORACLES: dict[str, str] = _oracles()
