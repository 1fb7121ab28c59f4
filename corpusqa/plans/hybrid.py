"""Questions to ranked chunks, and ranked chunks to answers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.models import Embedder, embed_questions, generate_answers
from corpusqa.operators.bm25 import bm25_search
from corpusqa.operators.context import (
    EMPTY_CORPUS,
    NO_CONTEXT,
    PROMPT_TEMPLATE,
    answer_sources,
    build_context,
    build_prompt,
    collect_images,
)
from corpusqa.operators.fusion import constant_score, final_topk, rerank, rrf_merge, rrf_score, rrf_topk
from corpusqa.operators.lexical_index import LexicalIndex
from corpusqa.operators.vectors import MIN_SIMILARITY, vector_search
from corpusqa.schema import CHUNK_KEY, prepare_questions
from corpusqa.session import HELD_BYTES, hold, materialise


@dataclass(frozen=True)
class SearchSettings:
    k: int = 10
    min_similarity: float = MIN_SIMILARITY
    rerank_candidates: int = 12
    rerank_threshold: float = 3.0
    final_hits: int = 6


_HIT_BYTES = 1024
_TERM_BYTES = 32
# values of a key column up to which they are given to the scan of the chunks
SOUGHT_KEYS = 1000


def chunk_lookup(hits: DataFrame, chunks: DataFrame, key: Sequence[str] = CHUNK_KEY, few: bool = False) -> DataFrame:
    """Bring text and image back to the hits: wide columns are read for winners only.

    One row per hit, also where the table holds several rows of that key. Where hits are known to be ``few``, the values of their keys
    go to the scan: folders of other commits are left out, and Parquet passes over row groups and pages that hold none of them.
    """
    if few:
        keys = hits.select(*key).collect()
        for c in key:
            values = {r[c] for r in keys} - {None}
            if len(values) <= SOUGHT_KEYS:
                chunks = chunks.where(F.col(c).isin(list(values)))
    wanted = hits.select(*key).distinct()
    found = (
        chunks.join(wanted, list(key), "left_semi")
        .groupBy(*key)
        .agg(F.max(F.struct("type", "text", "image")).alias("c"))
        .select(*key, "c.*")
    )
    return hits.join(found, list(key))


def fused_candidates(
    questions: DataFrame, index: LexicalIndex, vectors: DataFrame, settings: SearchSettings = SearchSettings(), row: Sequence[str] = ()
) -> DataFrame:
    """BM25 and nearest vectors side by side, fused by rank; ``questions`` carry their vector, hits the columns of ``row``."""
    lexical = bm25_search(questions, index, settings.k)
    near = vector_search(questions.select("question_id", "vector"), vectors, settings.k, settings.min_similarity, [*CHUNK_KEY, *row])
    return rrf_topk(rrf_score(rrf_merge(near, lexical, row=row)), settings.rerank_candidates)


def candidate_bytes(questions: DataFrame, settings: SearchSettings) -> int:
    """More bytes than the candidates of the questions take: keys, ranks and the terms that match (stretches of up to three characters of each word)."""
    words = F.octet_length(F.concat_ws(" ", "question", "rewritten", "keywords"))
    return questions.agg((settings.rerank_candidates * F.sum(_HIT_BYTES + _TERM_BYTES * words)).alias("most")).first()["most"] or 0


def hybrid_search(
    questions: DataFrame,
    index: LexicalIndex,
    vectors: DataFrame,
    chunks: DataFrame,
    scorer=constant_score,
    embedder: Embedder | None = None,
    settings: SearchSettings = SearchSettings(),
    **scoring,
) -> DataFrame:
    """Final hits per question with text and image: (question_id, final_rank, filename, …).

    ``questions(question_id, question[, rewritten, keywords, vector])``; ``vectors`` and ``chunks`` are
    keyed by (filename, chunk_index). Where the index has further columns in its key (``ROW_KEY`` of the knowledge base) and both tables have
    them too, a file that is stored twice gives the text of the row that was hit.
    """
    row = [c for c in index.key if c not in CHUNK_KEY and c in vectors.columns and c in chunks.columns]
    asked = prepare_questions(questions)
    if "vector" not in asked.columns:
        asked = embed_questions(asked, embedder)
    asked = materialise(asked, "questions")  # used several times: models are asked once
    most = candidate_bytes(asked, settings)
    candidates = hold(fused_candidates(asked, index, vectors, settings, row), "fused", most)
    with_text = chunk_lookup(candidates, chunks, [*CHUNK_KEY, *row], few=most <= HELD_BYTES).join(asked.select("question_id", "question"), "question_id")
    return final_topk(rerank(with_text, scorer, **scoring), settings.final_hits, settings.rerank_threshold).drop("question")


def answer_questions(
    questions: DataFrame,
    hits: DataFrame,
    history: DataFrame | None = None,
    generate=None,
    corpus_is_empty: bool = False,
    template: str = PROMPT_TEMPLATE,
) -> DataFrame:
    """(question_id, context, sources, images, prompt, answer) for every question."""
    hits = materialise(hits, "hits")
    no_list = F.array().cast("array<string>")
    base = questions.select("question_id", "question")
    if history is not None:
        base = base.join(history.select("question_id", "history"), "question_id", "left")
    else:
        base = base.withColumn("history", F.lit(None).cast("string"))
    joined = (
        base.join(build_context(hits), "question_id", "left")
        .join(answer_sources(hits), "question_id", "left")
        .join(collect_images(hits), "question_id", "left")
        .withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))
        .withColumn("sources", F.coalesce("sources", no_list))
        .withColumn("images", F.coalesce("images", no_list))
        .withColumn("prompt", build_prompt(F.col("context"), F.col("history"), template))
    )
    if corpus_is_empty:
        return joined.withColumn("answer", F.lit(EMPTY_CORPUS))
    return generate_answers(joined, generate)
