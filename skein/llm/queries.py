"""The pN_ queries, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.tables import table


def mail_and_memory(spark: SparkSession, d: str) -> DataFrame:
    """(collection, rowid, text) of all message bodies and memory contents."""
    mail = table(spark, d, "messages_fts").select(F.lit("messages").alias("collection"), "rowid", F.col("body").alias("text"))
    return mail.unionByName(table(spark, d, "memory_fts").select(F.lit("memory").alias("collection"), "rowid", F.col("content").alias("text")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p01_rank_aggregation import aggregate_ranks, top_places

    ranked = aggregate_ranks(table(spark, d, "hybrid_candidates"), ["text_score", "vector_score"])
    return top_places(ranked, table(spark, d, "hybrid_queries")).select("query_id", "rowid")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p01_rank_aggregation import aggregate_ranks, full_ranking

    ranked = full_ranking(aggregate_ranks(table(spark, d, "hybrid_candidates"), ["text_score", "vector_score"]))
    return ranked.select("query_id", "rowid", "position", "supported", F.round("significance", 9).alias("significance"))


def _near(spark: SparkSession, d: str):
    from skein.llm.p02_near_duplicates import near_duplicates

    subject, body = F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))
    return near_duplicates(table(spark, d, "messages_fts"), "rowid", F.concat(subject, F.lit(" "), body))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p02_near_duplicates import all_pairs

    return all_pairs(*_near(spark, d)).select(F.col("a").alias("rowid_a"), F.col("b").alias("rowid_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p02_near_duplicates import groups

    return groups(*_near(spark, d)).select(F.col("id").alias("rowid"), F.col("group").alias("group_id"), "links")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    mail = table(spark, d, "messages_vec").select(F.lit("messages").alias("collection"), "rowid", "embedding")
    return mail.unionByName(table(spark, d, "memory_vec").select(F.lit("memory").alias("collection"), "rowid", "embedding"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 50, against all rows."""
    from skein.llm.p03_vectors import search_vectors

    both = _vectors(spark, d)
    return search_vectors(both, both.where("rowid % 50 = 0"), "collection", "rowid", "embedding").withColumn("similarity", F.round("similarity", 5))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p03_vectors import similar_vectors

    near = similar_vectors(_vectors(spark, d), "collection", "rowid", "embedding", k=10, min_similarity=0.9)
    return near.select("collection", F.least("rowid", "neighbour").alias("rowid_a"), F.greatest("rowid", "neighbour").alias("rowid_b")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p04_conversations import rebuild

    return rebuild(table(spark, d, "memory_fts"), table(spark, d, "memory_meta")).select("sessionId", "position", "rowid")


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p04_conversations import rebuild

    return rebuild(table(spark, d, "memory_fts"), table(spark, d, "memory_meta"))


def _finder(spark: SparkSession, d: str):
    from skein.llm.p05_personal import fit

    return fit(mail_and_memory(spark, d), "rowid", "text", table(spark, d, "messages_fts"), ["from_", "to_", "cc", "bcc"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p05_personal import occurrences

    return occurrences(mail_and_memory(spark, d), ["collection", "rowid"], "text", _finder(spark, d)).select("collection", "rowid", "kind", "start")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p05_personal import redact

    return redact(mail_and_memory(spark, d), "text", _finder(spark, d)).select("collection", "rowid", "redacted")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).where("piece_no = 1").select("collection", "rowid")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p06_splitting import split_texts

    return split_texts(mail_and_memory(spark, d), "text", ["collection", "rowid"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p07_new_text import not_new

    return not_new(table(spark, d, "messages_fts"), "rowid", "body")


def p7_new_text(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p07_new_text import with_new_text

    return with_new_text(table(spark, d, "messages_fts"), "body").select("rowid", "new_text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p08_encoding import encode

    return encode(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p09_contamination import leaked

    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id")


def _residue(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p10_residue import residue

    return residue(table(spark, d, "documents"), "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).select("doc_id", "kind")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.p10_residue import without_residue

    return without_residue(table(spark, d, "documents"), _residue(spark, d), "doc_id").select("doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_ranking, p2_found, p2_groups, p3_found, p3_neighbours, p4_found, p4_conversations, p5_found, p5_redacted, p6_found, p6_pieces, p7_found, p7_new_text, p8_ids, p9_found, p9_leaks, p10_found, p10_clean)}

_TURNS = r"""
valid AS (SELECT * FROM memory_fts QUALIFY row_number() OVER (PARTITION BY coalesce('m' || memId, 'r' || rowid) ORDER BY rowid) = 1),
facts AS (SELECT DISTINCT rowid, turnIndex, sessionId FROM memory_meta),
turns AS (
  SELECT trim(coalesce(v.sessionId, f.sessionId), ' ') AS sessionId, v.rowid, v.content,
         coalesce(f.turnIndex, try_cast(nullif(regexp_extract(v.memId, '([0-9]+)$', 1), '') AS BIGINT)) AS number,
         CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot') THEN 'assistant'
              WHEN lower(trim(role)) = 'kb' THEN 'kb' END AS role
  FROM valid v LEFT JOIN facts f USING (rowid)),
chat AS (SELECT * FROM turns WHERE role IS DISTINCT FROM 'kb' AND sessionId IS NOT NULL),
kept AS (
  SELECT sessionId, min(number) AS first FROM chat GROUP BY sessionId
  HAVING bool_and(number IS NOT NULL AND role IS NOT NULL AND coalesce(regexp_matches(content, '[\p{L}\p{N}]'), false))
     AND min(number) IN (0, 1) AND count(*) = count(DISTINCT number) AND max(number) - min(number) + 1 = count(*) AND count(*) % 2 = 0
     AND sum(CASE WHEN (number % 2 = 0) = (role = 'user') THEN 1 ELSE 0 END) = CASE WHEN min(number) = 0 THEN count(*) ELSE 0 END)
"""
_RANKS = """
rows AS (
  SELECT query_id, rowid, max(CASE WHEN isnan(text_score) OR text_score = 0 THEN NULL ELSE text_score END) AS t,
         max(CASE WHEN isnan(vector_score) OR vector_score = 0 THEN NULL ELSE vector_score END) AS v
  FROM hybrid_candidates WHERE query_id IS NOT NULL AND rowid IS NOT NULL GROUP BY query_id, rowid),
normal AS (
  SELECT query_id, rowid, count(*) OVER q AS n,
         CASE WHEN t IS NULL THEN 1.0::DOUBLE ELSE (rank() OVER (PARTITION BY query_id ORDER BY t DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, t) - 1) / 2.0::DOUBLE)::DOUBLE / count(*) OVER q END AS a,
         CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE (rank() OVER (PARTITION BY query_id ORDER BY v DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, v) - 1) / 2.0::DOUBLE)::DOUBLE / count(*) OVER q END AS b
  FROM rows WINDOW q AS (PARTITION BY query_id)),
tests AS (
  SELECT query_id, rowid, a + b AS total, greatest(a, b) <= 0.4 AS supported,
         2.0::DOUBLE * least(a, b) * (1.0::DOUBLE - least(a, b)) + least(a, b) * least(a, b) AS first_of_two, greatest(a, b) * greatest(a, b) AS second_of_two FROM normal),
signified AS (SELECT query_id, rowid, supported, total, least(1.0::DOUBLE, 2.0::DOUBLE * least(first_of_two, second_of_two)) AS significance FROM tests),
ranked AS (SELECT query_id, rowid, supported, significance,
           row_number() OVER (PARTITION BY query_id ORDER BY supported DESC, significance, total, rowid) AS position FROM signified)
"""
ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_RANKS} SELECT r.query_id, r.rowid FROM ranked r JOIN (SELECT query_id, max(top_n) AS n FROM hybrid_queries GROUP BY query_id) q USING (query_id) WHERE position <= n",
    "p1_ranking": f"WITH {_RANKS} SELECT query_id, rowid, position, supported, round(significance, 9) AS significance FROM ranked",
    "p4_found": f"WITH {_TURNS} SELECT sessionId, number - first AS position, rowid FROM chat JOIN kept USING (sessionId)",
    "p4_conversations": f"WITH {_TURNS} SELECT sessionId, number - first AS position, rowid, role, content FROM chat JOIN kept USING (sessionId)",
    "p2_found": r"""
WITH words AS (
  SELECT rowid, regexp_extract_all(lower(coalesce(subject, '') || ' ' || coalesce(body, '')), '[\p{L}\p{N}]+') AS w FROM messages_fts),
s AS (SELECT DISTINCT rowid, unnest(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS h FROM words WHERE len(w) >= 20),
n AS (SELECT rowid, count(*) AS n FROM s GROUP BY rowid),
c AS (SELECT a.rowid AS rowid_a, b.rowid AS rowid_b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.rowid < b.rowid GROUP BY ALL)
SELECT rowid_a, rowid_b FROM c JOIN n x ON x.rowid = rowid_a JOIN n y ON y.rowid = rowid_b WHERE c >= 0.6 * (x.n + y.n - c)""",
    "p3_found": """
WITH v AS (
  SELECT DISTINCT 'messages' AS collection, rowid, embedding::DOUBLE[] AS e FROM messages_vec UNION ALL SELECT DISTINCT 'memory', rowid, embedding::DOUBLE[] FROM memory_vec),
g AS (SELECT collection, rowid, e::DOUBLE[64] AS e FROM v WHERE len(e) = 64 AND NOT list_bool_or(list_transform(e, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0)))
SELECT DISTINCT a.collection, a.rowid AS rowid_a, b.rowid AS rowid_b FROM g a JOIN g b ON a.collection = b.collection AND a.rowid < b.rowid WHERE array_cosine_similarity(a.e, b.e) >= 0.9""",
    "p9_found": r"""
WITH w AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents UNION ALL
  SELECT 1, item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') FROM eval_items),
g AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM w WHERE len(w) >= 12)
SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM g a JOIN g b ON a.g = b.g AND a.side = 0 AND b.side = 1""",
    "p6_found": "SELECT 'messages' AS collection, rowid FROM messages_fts WHERE length(body) > 2000 UNION ALL SELECT 'memory', rowid FROM memory_fts WHERE length(content) > 2000",
}
