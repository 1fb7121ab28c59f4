"""Reciprocal-rank fusion, reranking and the final cut."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusqa.functions.text import tokenize
from corpusqa.operators.ranking import top_k
from corpusqa.schema import CHUNK_KEY

# Fixed values
RRF_K = 50
RERANK_CANDIDATES = 12
RERANK_THRESHOLD = 3.0
FINAL_HITS = 6
RERANK_DEFAULT = 5.0


def rank_hits(hits: DataFrame, score: str = "score", key: Sequence[str] = CHUNK_KEY) -> DataFrame:
    """0-based rank by falling score within each question, ties by key."""
    order = [F.desc(score), *[F.asc(c) for c in key]]
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(*order)) - 1)


def rrf_merge(vector_hits: DataFrame, bm25_hits: DataFrame, key: Sequence[str] = CHUNK_KEY, row: Sequence[str] = ()) -> DataFrame:
    """Both rankings side by side per (question, chunk); a chunk listed twice keeps its last rank.

    Where a table holds several rows of one key, the columns of ``row`` tell them apart: they are those of the last hit, of the lexical ranking if
    it has one.
    """
    on = ["question_id", *key]
    last = [F.max_by(F.struct(*row), "rank").alias("hit")] if row else []
    vector = vector_hits.groupBy(*on).agg(F.max("rank").alias("vector_rank"), *last)
    lexical = bm25_hits.groupBy(*on).agg(
        F.max("rank").alias("bm25_rank"),
        F.max_by("score", "rank").alias("bm25_score"),
        F.max_by("matched_terms", "rank").alias("matched_terms"),
        *last,
    )
    hit = F.coalesce(F.col("l.hit"), F.col("v.hit")) if row else None
    return vector.alias("v").join(lexical.alias("l"), on, "full_outer").select(
        *on,
        "vector_rank",
        "bm25_rank",
        F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"),
        F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matched_terms"),
        *[hit[c].alias(c) for c in row],
    )


def rank_share(rank: Column) -> Column:
    return F.coalesce(1 / (RRF_K + rank + 1), F.lit(0.0))


def rrf_score(merged: DataFrame) -> DataFrame:
    vector = rank_share(F.col("vector_rank"))
    return merged.withColumn("vector_score", vector).withColumn(
        "rrf_score", vector + rank_share(F.col("bm25_rank"))
    )


def rrf_topk(scored: DataFrame, k: int = RERANK_CANDIDATES, key: Sequence[str] = CHUNK_KEY) -> DataFrame:
    """Best ``k`` fused hits; ties go to the vector side first, then by rank and key."""
    order = [
        F.desc("rrf_score"),
        F.asc_nulls_last("vector_rank"),
        F.asc_nulls_last("bm25_rank"),
        *[F.asc(c) for c in key],
    ]
    return top_k(scored, ["question_id"], order, k, "fused_rank")


def lexical_coverage(question: Column, text: Column) -> Column:
    """Offline scorer: tenths of the distinct question words that the text contains."""
    asked, given = F.array_distinct(tokenize(question)), tokenize(text)
    shared = F.size(F.array_intersect(asked, given))
    return F.when(F.size(asked) > 0, 10.0 * shared / F.size(asked))


def constant_score(question: Column, text: Column) -> Column:
    """What every candidate gets when no scoring model answers."""
    return F.lit(RERANK_DEFAULT)


def rerank(
    candidates: DataFrame,
    scorer: Callable[[Column, Column], Column] = constant_score,
    missing: float = RERANK_DEFAULT,
) -> DataFrame:
    """Score ``candidates(question, text)``; a score the scorer leaves null becomes ``missing``.

    ``scorer`` maps (question, text) columns to a score column: a native expression, or a pandas UDF
    around a model (see ``models.batch_scorer``, which can give its model an excerpt). Both see the whole
    text. A cross-encoder declares 0 as its missing score, a chat model 5.
    """
    score = scorer(F.col("question"), F.col("text"))
    return candidates.withColumn("rerank_score", F.coalesce(score.cast("double"), F.lit(missing)))


def rerank_filter(reranked: DataFrame, threshold: float = RERANK_THRESHOLD) -> DataFrame:
    return reranked.where(F.col("rerank_score") >= threshold)


def rerank_documents(hits: DataFrame, scorer=constant_score, threshold: float = RERANK_THRESHOLD, **scoring) -> DataFrame:
    """Older variant: every hit is scored, all above the threshold stay, best first (``final_rank``)."""
    kept = rerank_filter(rerank(hits, scorer, **scoring), threshold)
    order = W.partitionBy("question_id").orderBy(F.desc("rerank_score"), F.asc("rank"))
    return kept.withColumn("final_rank", F.row_number().over(order) - 1)


def final_topk(reranked: DataFrame, k: int = FINAL_HITS, threshold: float = RERANK_THRESHOLD) -> DataFrame:
    """Threshold, then the best ``k`` per question; equal scores keep their fused order."""
    return top_k(
        rerank_filter(reranked, threshold), ["question_id"], [F.desc("rerank_score"), F.asc("fused_rank")], k, "final_rank"
    )
