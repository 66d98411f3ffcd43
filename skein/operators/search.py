"""Keyword and hybrid searches over message and memory collections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.fusion import OVERFETCH, fuse
from skein.operators.lookup import between, check_limit, newest
from skein.operators.postings import hits_of_postings, hits_of_texts, rank_many, ranked_by_postings
from skein.operators.snippet import with_snippets
from skein.operators.vector_search import nearest
from skein.plans.match import MEMORY, MESSAGES, Layout, ranked
from skein.plans.query import QueryError, compile_query, parse_match, phrases
from skein.plans.synonyms import Synonyms, default_synonyms



#: Result rows up to which they are broadcast to the texts.
MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class Index:
    """The postings of a collection and its numbers of rows and tokens; `stems` tells whether terms are stems."""

    postings: DataFrame
    size: tuple[int, int]
    stems: bool = False


def _ranked(df: DataFrame, tree: object, layout: Layout, stems: bool, index: Index | None) -> DataFrame:
    """The matching rows with their rank: by the index where there is one, else by a scan."""
    if index is None:
        return ranked(df, tree, layout, stems)
    return df.join(ranked_by_postings(index.postings, index.size, tree, layout, index.stems), "rowid")


def tree_of(query: str, layout: Layout, synonyms: Synonyms | None = None) -> object | None:
    """The syntax tree of a user's query, or None if nothing is asked."""
    return parse_match(compile_query(query, synonyms or default_synonyms()), layout.columns)


def _projection(layout: Layout) -> list:
    if layout is MESSAGES or layout.key == "msgId":
        return ["rowid", F.col("msgId").alias("uniqueId"), F.col("from_").alias("author"), "subject", "dateMs", "hasAttachments"]
    return ["rowid", "memId", "role", "content", "sessionId", "dateMs"]


def keyword_search(df: DataFrame, query: str, layout: Layout, low: int | None = None, high: int | None = None, limit: int = 50, synonyms: Synonyms | None = None, stems: bool = False, snippets: bool = True, index: Index | None = None) -> DataFrame:
    """Matching rows: messages by date and then rank, memory by rank and then date.

    Dates are filtered before the limit, statistics are those of the whole
    collection. Snippets are made for the result rows only.
    """
    check_limit(limit)
    tree = tree_of(query, layout, synonyms)
    if tree is None:
        return df.limit(0).select(*_projection(layout), F.lit(None).cast("string").alias("snippet"), F.lit(0.0).alias("rank")) if snippets else df.limit(0).select(*_projection(layout), F.lit(0.0).alias("rank"))
    found = between(_ranked(df, tree, layout, stems, index), "dateMs", low, high)
    order = [F.desc("dateMs"), F.asc("rank")] if layout.key == "msgId" else [F.asc("rank"), F.desc("dateMs")]
    found = found.orderBy(*order, "rowid").limit(limit)
    if not snippets:
        return found.select(*_projection(layout), "rank")
    return with_snippets(found, tree, layout).select(*_projection(layout), "snippet", "rank")


def browse(memory: DataFrame, low: int | None = None, high: int | None = None, limit: int = 50) -> DataFrame:
    """The newest memory entries, for an empty query."""
    found = newest(between(memory, "dateMs", low, high), limit)
    return found.select(*_projection(MEMORY), F.lit(None).cast("string").alias("snippet"), F.lit(0.0).alias("rank"))


def text_candidates(df: DataFrame, tree: object, layout: Layout, limit: int, low: int | None = None, high: int | None = None, stems: bool = False, index: Index | None = None) -> DataFrame:
    """(rowid, rank) of the best matches."""
    return between(_ranked(df, tree, layout, stems, index), "dateMs", low, high).select("rowid", "rank").orderBy("rank", "rowid").limit(limit)


def hybrid_search(
    df: DataFrame, vectors: DataFrame | None, query: str, query_vector: list[float] | None, layout: Layout, low: int | None = None, high: int | None = None, limit: int = 50, synonyms: Synonyms | None = None, stems: bool = False, snippets: bool = True, index: Index | None = None, unique: bool = False
) -> DataFrame:
    """Keyword and vector candidates, four times the limit of each, fused; rank is minus the score.

    Without vectors or query vector the search is keyword-only; a query without
    words uses vectors only. Dates bound the keyword candidates before their
    limit and the fused rows after theirs. A hit without a text row is dropped;
    a hit without a keyword match has an empty snippet.
    """
    check_limit(limit)
    if vectors is None or query_vector is None:
        return keyword_search(df, query, layout, low, high, limit, synonyms, stems, snippets, index)
    tree = tree_of(query, layout, synonyms)
    many = OVERFETCH * limit
    by_vector = nearest(vectors, query_vector, many, unique=unique)
    by_text = text_candidates(df, tree, layout, many, low, high, stems, index) if tree is not None else by_vector.limit(0).select("rowid", F.lit(0.0).alias("rank"))
    fused = fuse(by_text, by_vector, limit)
    few = F.broadcast(fused) if limit <= MOST_BROADCAST else fused  # at most `limit` rows by construction
    rows = between(df.join(few, "rowid"), "dateMs", low, high)
    rank = (-F.col("final_score")).alias("rank")
    if not snippets:
        return rows.select(*_projection(layout), rank).orderBy("rank", "rowid")
    shown = with_snippets(rows, tree, layout) if tree is not None else rows.withColumn("snippet", F.lit(""))
    snippet = F.when(F.col("text_score") > 0, F.col("snippet")).otherwise("").alias("snippet")
    return shown.select(*_projection(layout), snippet, rank).orderBy("rank", "rowid")


def search_many(source: Index | DataFrame, queries: DataFrame, layout: Layout, limit: int = 10, synonyms: Synonyms | None = None, valid: DataFrame | None = None) -> DataFrame:
    """(query_id, rowid, rank, position): the best rows of each of queries(query_id, query), taken as they are: fields, phrases, AND, OR, NOT.

    `source` is a stored index or, for one large batch of queries, the rows
    themselves, whose texts are read once and need no index. `valid` (key,
    rowid) are then the rows that count; they are joined when texts have become
    numbers. Queries that ask nothing or can't be parsed have no rows.
    """
    trees: dict[str, object] = {}
    for (text,) in queries.select("query").where("query IS NOT NULL").distinct().collect():
        try:
            tree = tree_of(text, layout, synonyms)
        except QueryError:
            continue
        if tree is not None:
            trees[text] = tree
    asked = list(dict.fromkeys(p for t in trees.values() for p in phrases(t)))
    if isinstance(source, Index):
        return rank_many(hits_of_postings(source.postings, asked, layout), source.size, queries, trees, asked, layout, limit)
    hits = hits_of_texts(source, asked, layout)
    hits = hits if valid is None else hits.join(valid, [layout.key, "rowid"], "left_semi")
    return rank_many(hits.drop(layout.key), None, queries, trees, asked, layout, limit)
