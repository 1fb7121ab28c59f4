"""BM25 for a whole table of questions at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusqa.functions.text import build_search_terms
from corpusqa.operators.lexical_index import BM25_B, BM25_K1, LexicalIndex, block_of, saturation
from corpusqa.operators.ranking import top_k
from corpusqa.schema import prepare_questions
from corpusqa.session import materialise

# bytes of question terms that are sent to a pass over the forward index; more are worked off in several passes
BLOCK_BYTES = 64 * 1024 * 1024
# a batch of questions with more different terms than this, or whose terms have more postings than this share of all, goes to the
# forward index, and so does any batch where all postings are so few that a pass over them is done before the lookups are planned (measured: 0.5 s
# against 1.7 s at 0.25 million); both ways give the same rows
SOUGHT_TERMS = 2000
SOUGHT_SHARE = 1 / 4
SOUGHT_FROM = 2_000_000
_ROW_BYTES = 96  # of a question term besides its text
_SLACK = 1 + 1e-9
_BITS = 62
_UNIT = float(1 << 30)
# pairs, and matches, that are looked at together; and terms of chunks that are unpacked together, so that a task holds no more of a large batch
_CELLS = 1 << 19
_ENTRIES = 1 << 19


def question_terms(questions: DataFrame) -> DataFrame:
    """(question_id, pos, term), in the order the terms are searched."""
    prepared = prepare_questions(questions)
    terms = build_search_terms(F.col("question"), F.col("rewritten"), F.col("keywords"))
    return prepared.select("question_id", F.posexplode(terms).alias("pos", "term"))


def known_terms(questions: DataFrame, index: LexicalIndex) -> DataFrame:
    """Terms of the questions that occur in the corpus, with their statistics."""
    return (
        question_terms(questions)
        .join(index.term_stats, "term")
        .select(
            "question_id",
            "pos",
            "term",
            "df",
            "idf",
            index.corpus_stats.select("avg_len").scalar().alias("avg_len"),
            F.floor(F.col("pos") / _BITS).cast("int").alias("word"),
            F.pow(F.lit(2.0), F.col("pos") % _BITS).cast("bigint").alias("bit"),
        )
    )


def bm25_match(questions: DataFrame, index: LexicalIndex) -> DataFrame:
    """Every (question, chunk, term) match with its share of the score."""
    matches = _matches(known_terms(questions, index), index.postings)
    return index.with_keys(matches.select("question_id", "doc_no", "term", "tf", "weight"))


def bm25_score(questions: DataFrame, index: LexicalIndex) -> DataFrame:
    """Score of every matching (question, chunk) pair; ``bm25_search`` keeps the best ones.

    A pass over the forward index, where all matches of a chunk and its key are at hand: no pair is shuffled.
    """
    terms = materialise(known_terms(questions, index), "terms")
    parts = [_scan(block, index, None, []) for block in _blocks(terms, terms.agg(_term_bytes()).first()[0], BLOCK_BYTES)]
    return _with_score(reduce(DataFrame.unionByName, parts)).select("question_id", "score", *index.key)


def _term_bytes() -> Column:
    return F.sum(F.octet_length("term") + _ROW_BYTES)


def _blocks(terms: DataFrame, size: int | None, block_bytes: int) -> list[DataFrame]:
    """The terms of whole questions, in parts of about ``block_bytes``."""
    n_blocks = max(1, -(-(size or 0) // block_bytes))
    block = F.pmod(F.xxhash64("question_id"), F.lit(n_blocks))
    return [terms.where(block == n) for n in range(n_blocks)]


def bm25_search(questions: DataFrame, index: LexicalIndex, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Best ``k`` chunks per question: (question_id, key…, rank, score, matched_terms).

    A few questions of a large index read the postings of their own terms, less the blocks of chunks that cannot hold one of the best (``_sought``).
    For a large batch the question terms go to a pass over the forward index, where all matches of a chunk are at hand: nothing is
    shuffled but the ``k`` best per question and task, however frequent the terms are. Questions are cut into blocks of about
    ``block_bytes``, each a pass of its own, so what is sent to the tasks does not grow with the questions. A question id
    may be of any type.
    """
    terms = materialise(known_terms(questions, index), "terms")
    size = _term_bytes()
    postings = index.corpus_stats.select("n_postings").scalar()
    few = (F.count_distinct("term") <= SOUGHT_TERMS) & (F.sum("df") <= SOUGHT_SHARE * postings) & (size <= block_bytes) & (postings >= SOUGHT_FROM)
    totals = terms.agg(size.alias("bytes"), F.max("word").alias("words"), few.alias("few")).first()
    masks = [f"mask_{i}" for i in range((totals["words"] or 0) + 1)]
    if totals["few"]:  # null without any term
        scored = _accumulate(_sought(terms, index, k), masks)
    else:
        parts = [_scan(block, index, k, masks) for block in _blocks(terms, totals["bytes"], block_bytes)]
        scored = _with_score(reduce(DataFrame.unionByName, parts))
    # chunk numbers follow the keys: equal scores come in key order
    best = top_k(scored.where(F.col("score") > 0), ["question_id"], [F.desc("score"), F.asc("doc_no")], k)
    best = index.with_keys(best)
    # one row per question, as long as the question itself
    spelled = terms.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term", "word", "bit"))).alias("all"))
    words = F.array(*masks)
    matched = F.filter("all", lambda t: F.get(words, t["word"]).bitwiseAND(t["bit"]) != 0)
    return best.join(spelled, "question_id").select(
        "question_id", *index.key, "rank", "score", F.transform(matched, lambda t: t["term"]).alias("matched_terms")
    )


def _sought(terms: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """Matches of the chunks that can be among the best ``k`` of a question.

    Only pages that hold the sought terms are read, of both tables. In a block of chunks, the largest weights of a question's
    terms add up to more than any chunk can have, and the largest single one is a score that some chunk has at least. So
    the ``k``-th best of the latter is reached by ``k`` chunks, and blocks whose sum is below are left out.
    """
    names = [r["term"] for r in terms.select("term").distinct().collect()]  # SOUGHT_TERMS at most
    sought = F.col("term").isin(names)
    best = index.blocks.where(sought).join(F.broadcast(terms), "term").withColumn("weight", F.col("idf") * F.col("best"))
    bounds = best.groupBy("question_id", "block").agg(F.sum("weight").alias("most"), F.max("weight").alias("sure"))
    reached = top_k(bounds, ["question_id"], [F.desc("sure")], k).where(F.col("rank") == k - 1).select("question_id", F.col("sure").alias("reached"))
    able = F.col("reached").isNull() | (F.col("most") * _SLACK >= F.col("reached"))
    open_ = bounds.join(reached, "question_id", "left").where(able).select("question_id", "block")
    matches = _matches(F.broadcast(terms), index.postings.where(sought)).withColumn("block", block_of(F.col("doc_no")))
    return matches.join(open_, ["question_id", "block"], "left_semi")


def _matches(terms: DataFrame, postings: DataFrame) -> DataFrame:
    weight = F.col("idf") * saturation(F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    return postings.join(terms, "term").withColumn("weight", weight)


def _accumulate(matches: DataFrame, masks) -> DataFrame:
    """Add up per pair; the matched terms travel as bits, not as lists of strings.

    Weights are added as two whole numbers, the coarse and the fine part: their sums do not depend on
    the order of addition, so copies of a text always tie.
    """
    coarse = F.floor(F.col("weight") * _UNIT)
    return _with_score(
        matches.groupBy("question_id", "doc_no").agg(
            F.sum(coarse).alias("coarse"),
            F.sum(F.floor((F.col("weight") * _UNIT - coarse) * _UNIT)).alias("fine"),
            *[F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0))).alias(m) for i, m in enumerate(masks)],
        )
    )


def _with_score(sums: DataFrame) -> DataFrame:
    return sums.withColumn("score", (F.col("coarse") + F.col("fine") / _UNIT) / _UNIT)


def _scan(terms: DataFrame, index: LexicalIndex, k: int | None, masks) -> DataFrame:
    """The ``k`` best pairs per question and task, with their sums and bits; all pairs, with the keys of the chunks, if ``k`` is None."""
    block = terms.toArrow()  # of bounded size
    asked = block.to_pandas()
    asked["question_id"] = pd.Series(block["question_id"].to_pylist(), dtype=object)  # a null makes no other number inexact
    asked = asked.sort_values("term", kind="stable", ignore_index=True)
    question, ids = pd.factorize(asked["question_id"], use_na_sentinel=False)
    id_type = terms.schema["question_id"]
    arrow_type = to_arrow_type(id_type.dataType)
    vocabulary, first, uses = np.unique(asked["term"].to_numpy(dtype=str), return_index=True, return_counts=True)
    query = {
        "ids": pa.array(ids.tolist(), arrow_type, from_pandas=True),
        "vocabulary": [str(t) for t in vocabulary],
        "idf": asked["idf"].to_numpy()[first],
        "first": first,
        "uses": uses,
        "question": question,
        "word": asked["word"].to_numpy(),
        "bit": asked["bit"].to_numpy(),
        "avg_len": float(asked["avg_len"].iloc[0]) if len(asked) else 1.0,
    }
    shared = terms.sparkSession.sparkContext.broadcast(query)
    numbers, key = ["coarse", "fine", *masks], list(index.key)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        query = shared.value
        vocabulary = pa.array(query["vocabulary"], pa.string())
        for batch in batches:
            for some in _portions(batch):
                for found in _score_batch(query, vocabulary, some, k, len(masks)):
                    yield some, found

    def named(found: dict, chunk: list[pa.Array], names: list[str]) -> pa.RecordBatch:
        asked = shared.value["ids"].take(pa.array(found["question_id"]))
        return pa.RecordBatch.from_arrays([asked, *chunk, *[pa.array(found[c].astype(np.int64)) for c in numbers]], names=["question_id", *names, *numbers])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for _, found in parts(batches):
            best = found if best is None else _keep_best({c: np.concatenate([best[c], found[c]]) for c in found}, k)
        if best is not None:
            yield named(best, [pa.array(best["doc_no"].astype(np.int64))], ["doc_no"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, found in parts(batches):
            at = pa.array(found["row"])
            yield named(found, [some.column(c).take(at) for c in key], key)

    chunk = index.doc_terms.select(*(key if k is None else ["doc_no"])).schema.fields
    kinds = T.StructType([id_type, *chunk, *[T.StructField(c, T.LongType()) for c in numbers]])
    if k is None:
        return index.doc_terms.select("doc_no", *key, "doc_len", "terms").mapInArrow(every, kinds)
    return index.doc_terms.select("doc_no", "doc_len", "terms").mapInArrow(search, kinds)


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that have at most so many terms in all, one row at least."""
    reached = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(reached):
        done = reached[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(reached, done + _ENTRIES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _score_batch(query: dict, vocabulary: pa.Array, batch: pa.RecordBatch, k: int | None, n_masks: int) -> Iterator[dict]:
    """Score the chunks of a batch against all questions, a few chunks at a time; without ``k`` every match is found, by its row in the batch."""
    numbers = batch.column("doc_no").to_numpy()
    lengths = batch.column("doc_len").to_numpy()
    lists = batch.column("terms")
    entries = lists.flatten()
    term = pc.index_in(entries.field("term"), value_set=vocabulary)
    known = pc.is_valid(term).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    row = np.repeat(np.arange(len(numbers)), sizes)[known]
    term = pc.drop_null(term).to_numpy().astype(np.int64)
    tf = entries.field("tf").to_numpy(zero_copy_only=False)[known]
    norm = BM25_K1 * (1 - BM25_B + BM25_B * (lengths[row] / query["avg_len"]))
    weight = query["idf"][term] * (tf * (BM25_K1 + 1) / (tf + norm))
    coarse = np.floor(weight * _UNIT)
    fine = np.floor((weight * _UNIT - coarse) * _UNIT)
    n_questions = len(query["ids"])
    step = max(1, _CELLS // max(1, n_questions))
    reached = np.cumsum(np.bincount(row, query["uses"][term], len(numbers)))  # matches up to each chunk
    start = stop = 0
    while stop < len(numbers):
        start, done = stop, reached[stop - 1] if stop else 0
        stop = min(start + step, max(start + 1, int(np.searchsorted(reached, done + _CELLS, side="right"))))
        stop = min(stop, len(numbers))
        low, high = np.searchsorted(row, (start, stop))
        if low == high:
            continue
        # every match once per question that has the term
        uses = query["uses"][term[low:high]]
        match = np.repeat(np.arange(low, high), uses)
        nth = np.arange(len(match)) - np.repeat(np.cumsum(uses) - uses, uses)
        use = query["first"][term[match]] + nth
        cell = (row[match] - start) * n_questions + query["question"][use]
        shape, cells = (stop - start, n_questions), (stop - start) * n_questions
        # sums of whole numbers far below 2**53: exact in any order
        coarse_sum = np.bincount(cell, coarse[match], cells)
        fine_sum = np.bincount(cell, fine[match], cells)
        if k is None:
            kept = np.flatnonzero(np.bincount(cell, minlength=cells))
            yield {"question_id": kept % n_questions, "row": start + kept // n_questions, "coarse": coarse_sum[kept], "fine": fine_sum[kept]}
            continue
        score = ((coarse_sum + fine_sum / _UNIT) / _UNIT).reshape(shape)
        if k < shape[0]:
            limit = np.partition(score, shape[0] - k, axis=0)[shape[0] - k]
        else:
            limit = np.zeros(n_questions)
        doc, question = np.nonzero((score > 0) & (score >= limit))
        kept = doc * n_questions + question
        found = {"question_id": question, "doc_no": numbers[start + doc], "coarse": coarse_sum[kept], "fine": fine_sum[kept]}
        place = np.full(cells, -1)
        place[kept] = np.arange(len(kept))
        at = place[cell]
        mine, use = at[at >= 0], use[at >= 0]
        for i in range(n_masks):
            bits = np.zeros(len(kept), dtype=np.int64)
            ours = query["word"][use] == i
            np.bitwise_or.at(bits, mine[ours], query["bit"][use[ours]])
            found[f"mask_{i}"] = bits
        yield _keep_best(found, k)


def _keep_best(found: dict, k: int) -> dict:
    score = (found["coarse"] + found["fine"] / _UNIT) / _UNIT
    order = np.lexsort((found["doc_no"], -score, found["question_id"]))
    question = found["question_id"][order]
    nth = np.arange(len(order)) - np.searchsorted(question, question, side="left")
    order = order[nth < k]
    return {name: values[order] for name, values in found.items()}
