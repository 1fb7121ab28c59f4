"""Exact nearest-neighbour search of many questions over many vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusqa.functions.text import similarity_from_distance
from corpusqa.operators.ranking import top_k
from corpusqa.schema import CHUNK_KEY

MIN_SIMILARITY = 0.35
# bytes of question vectors that are sent to a pass over the stored vectors; more are worked off in several passes
BLOCK_BYTES = 64 * 1024 * 1024
# hits that the questions of a block may have: each task of a pass holds as many, and as many new ones again
BLOCK_HITS = 1 << 18
LEAST_TASKS = 4  # of a pass, if there are several
_PAIRS_AT_ONCE = 1 << 20
_NUMBERS_AT_ONCE = 1 << 23


def vector_dimension(vectors: DataFrame) -> DataFrame:
    """One row: smallest and largest dimension found, and the number of vectors."""
    size = F.size("vector")
    return vectors.where(F.col("vector").isNotNull()).agg(
        F.min(size).alias("min_dim"), F.max(size).alias("max_dim"), F.count("*").alias("n_vectors")
    )


def check_dimension(vectors: DataFrame, expected: int | None = None) -> tuple[int | None, int]:
    """(dimension, number of vectors); raises when there are several dimensions or another is expected."""
    found = vector_dimension(vectors).first()
    if found["min_dim"] != found["max_dim"]:
        raise ValueError(f"vectors of {found['min_dim']} to {found['max_dim']} dimensions in one table")
    if found["n_vectors"] and expected is not None and found["max_dim"] != expected:
        raise ValueError(
            f"the knowledge base holds {found['max_dim']}-dimensional vectors, the embedding model returns "
            f"{expected}; re-embed the stored chunks or clear them first"
        )
    return found["max_dim"], found["n_vectors"]


class _Stored:
    """The rows of a batch in the order of their keys, ready to be met by questions whose largest squared length is ``longest``."""

    def __init__(self, batch: pd.DataFrame, key: list[str], longest: float):
        batch = batch.sort_values(key, kind="stable", ignore_index=True)
        self.keys, self.vectors = batch[key], np.stack(batch["vector"].to_numpy()).astype(np.float64)
        self.norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.most = self.norms.max()
        top = max(self.most, longest)
        # single precision, in units of the longest vector; what has no finite length is measured in double precision
        self.scale = 1 / top if 1e-300 < top < np.inf else None
        if self.scale:
            self.wide = np.vstack([self.vectors.T * np.sqrt(self.scale), self.norms * self.scale]).astype(np.float32)

    def close_to(self, part: np.ndarray, norms: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``part``, row of the batch): all pairs no farther than ``limit`` that may be among the ``k`` nearest, and few others.

        The product form is off by rounding, in single precision by less than 2 (d + 8) 2^-24 of both squared lengths: what lies twice as near to a limit is kept.
        """
        n = len(self.vectors)
        with np.errstate(all="ignore"):
            if self.scale:
                asked = np.hstack([part * (-2 * np.sqrt(self.scale)), np.ones((len(part), 1))]).astype(np.float32)
                rough = asked @ self.wide
                slack = (4 * (part.shape[1] + 8) * 2.0**-24 * self.scale * (norms + self.most) + 1e-37).astype(np.float32)
                within = ((limit - norms) * self.scale + slack).astype(np.float32)
            else:
                rough = norms[:, None] + self.norms[None, :] - 2.0 * (part @ self.vectors.T)
                slack = 1e-9 * (norms + self.most)
                within = limit + slack
            close = np.flatnonzero(rough <= within[:, None])
            if k < n and len(close) > 2 * k * len(part):
                close = np.flatnonzero(rough <= np.minimum(within, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)[:, None])
        return np.divmod(close, n)


def _nearest(ids: np.ndarray, queries: np.ndarray, norms: np.ndarray, stored: _Stored, k: int, most: np.ndarray) -> pd.DataFrame:
    """The k nearest rows of ``stored`` for each query, none farther than its ``most``: squared Euclidean distance, ties by key."""
    found = []
    step = max(1, _PAIRS_AT_ONCE // len(stored.vectors))
    per_slice = max(1, _NUMBERS_AT_ONCE // stored.vectors.shape[1])
    for start in range(0, len(queries), step):
        part, limit = queries[start : start + step], most[start : start + step]
        rows, columns = stored.close_to(part, norms[start : start + step], limit, k)
        if not len(rows) and found:
            continue
        slices = range(0, max(1, len(rows)), per_slice)
        exact = np.concatenate(
            [((stored.vectors[columns[i : i + per_slice]] - part[rows[i : i + per_slice]]) ** 2).sum(axis=1) for i in slices]
        )
        order = np.lexsort((columns, exact, rows))
        rows, columns, exact = rows[order], columns[order], exact[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = (nth < k) & (exact <= limit[rows])
        near = stored.keys.iloc[columns[keep]].reset_index(drop=True)
        near.insert(0, "question_id", ids[start + rows[keep]])
        near["distance"] = exact[keep]
        found.append(near)
    return pd.concat(found, ignore_index=True)


class Best:
    """The ``k`` nearest rows of each question that a task has met.

    New rows are put to the kept ones when they are as many, and only those no farther than the ``k``-th kept one are looked at: the work
    is that of the distances, and no more than two rows for each that is returned are held, besides those of a batch.
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, key: list[str], k: int):
        self.ids, self.matrix, self.key, self.k = ids, matrix, key, k
        self.norms = np.einsum("ij,ij->i", matrix, matrix)
        self.longest = self.norms.max(initial=0.0)
        self.most = np.full(len(ids), np.inf)
        self.frames: list[pd.DataFrame] = []
        self.new = 0

    def add(self, batch: pd.DataFrame, mine: np.ndarray | None = None) -> None:
        """Meet the rows of ``batch``, with the questions at ``mine`` (all of them)."""
        mine = np.arange(len(self.ids)) if mine is None else mine
        if not len(batch) or not len(mine):
            return
        stored = _Stored(batch, self.key, self.longest)
        room = max(1, len(self.ids) // 4)  # questions at a time
        for at in range(0, len(mine), room):
            some = mine[at : at + room]
            near = _nearest(some, self.matrix[some], self.norms[some], stored, self.k, self.most[some])
            if len(near):
                self.frames.append(near)
                self.new += len(near)
            if self.new >= self.k * len(self.ids):
                self._merge()

    def _merge(self) -> None:
        merged = pd.concat(self.frames, ignore_index=True).sort_values(["question_id", "distance", *self.key], kind="stable")
        merged = merged.groupby("question_id", sort=False).head(self.k)
        self.frames, self.new = [merged], 0
        met = np.bincount(merged["question_id"], minlength=len(self.ids))
        full = met == self.k
        self.most[full] = merged["distance"].to_numpy()[np.cumsum(met)[full] - 1]

    def rows(self) -> Iterator[pd.DataFrame]:
        if self.frames:
            self._merge()
            yield self.frames[0].assign(question_id=self.ids[self.frames[0]["question_id"]])


def n_blocks(n_questions: int, dimension: int, k: int, block_bytes: int) -> int:
    """Passes that the questions are worked off in."""
    return max(1, -(-n_questions * (dimension * 8 + 64) // block_bytes), -(-n_questions * k // BLOCK_HITS))


def tasks_of_pass(vectors: DataFrame, blocks: int) -> DataFrame:
    """The stored vectors in as few tasks as keep all cores at work on ``blocks`` passes: each task returns ``k`` hits for every question of its pass."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return vectors.coalesce(max(LEAST_TASKS, -(-3 * cores // blocks))) if blocks > 1 else vectors


def nearest(
    questions: DataFrame,
    vectors: DataFrame,
    k: int,
    key: Sequence[str] = CHUNK_KEY,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(question_id, key…, rank, distance): the ``k`` nearest stored vectors of every question.

    ``questions(question_id, vector)``. No index is assumed, as in a flat scan, but no pair leaves
    a task: each task keeps ``k`` rows per question and Spark merges those. The question vectors are sent to the scan, in
    blocks of about ``block_bytes`` and ``BLOCK_HITS`` hits at most, each a pass of its own; the stored vectors are never shuffled.
    """
    key = list(key)
    questions = questions.where(F.col("vector").isNotNull()).select("question_id", "vector")
    vectors = vectors.where(F.col("vector").isNotNull()).select(*key, "vector")
    asked = vector_dimension(questions).first()
    if asked["n_vectors"] and asked["min_dim"] != asked["max_dim"]:
        raise ValueError("question vectors differ in dimension")
    schema = T.StructType(
        [questions.schema["question_id"], *[vectors.schema[c] for c in key], T.StructField("distance", T.DoubleType())]
    )
    blocks = n_blocks(asked["n_vectors"], asked["max_dim"] or 0, k, block_bytes)
    block = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    parts = [_scan(questions.where(block == n), tasks_of_pass(vectors, blocks), key, k, schema) for n in range(blocks)]
    local = reduce(DataFrame.unionByName, parts)
    return top_k(local, ["question_id"], [F.asc("distance"), *[F.asc(c) for c in key]], k)


def _scan(questions: DataFrame, vectors: DataFrame, key: list[str], k: int, schema: T.StructType) -> DataFrame:
    asked = questions.toPandas()  # a block, of bounded size
    ids = asked["question_id"].to_numpy()
    matrix = np.stack(asked["vector"].to_numpy()).astype(np.float64) if len(asked) else np.empty((0, 0))
    shared = questions.sparkSession.sparkContext.broadcast((ids, matrix))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(*shared.value, key, k)
        for batch in batches:
            best.add(batch)
        yield from best.rows()

    return vectors.mapInPandas(search, schema)


def similarity_filter(hits: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Keep hits that are similar enough."""
    similarity = similarity_from_distance(F.col("distance"))
    return hits.withColumn("similarity", similarity).where(F.col("similarity") >= min_similarity)


def vector_search(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    min_similarity: float = MIN_SIMILARITY,
    key: Sequence[str] = CHUNK_KEY,
    **options,
) -> DataFrame:
    """The nearest ``2k``, then the similarity threshold, then the first ``k``."""
    wide = nearest(questions, vectors, 2 * k, key, **options)
    return similarity_filter(wide, min_similarity).where(F.col("rank") < k)
