"""Approximate nearest-neighbour search: vectors in inverted lists around centroids, of which a question reads a few.

The lists are partitions of a Parquet table, so lists that no question probes are never opened. Distances inside the lists that are read are exact:
with all lists probed the result is that of the flat scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusqa.operators.ranking import top_k
from corpusqa.operators.vectors import BLOCK_BYTES, MIN_SIMILARITY, Best, n_blocks, similarity_filter, tasks_of_pass, vector_dimension
from corpusqa.schema import CHUNK_KEY
from corpusqa.session import scratch_path

SAMPLE = 50_000  # vectors the centroids are fitted to, about; every vector is put in a list
MOST_LISTS = 1024
PROBES = 8
SEED = 7


@dataclass(frozen=True)
class VectorIndex:
    vectors: DataFrame  # key…, vector, list
    centroids: np.ndarray  # lists x dimension
    key: tuple[str, ...]


def _rank_lists(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each vector, nearest first."""
    distance = (centroids**2).sum(axis=1)[None, :] - 2.0 * (vectors @ centroids.T)
    return np.argsort(distance, axis=1, kind="stable")[:, :n]


def fit_centroids(vectors: DataFrame, n_lists: int | None = None, key: Sequence[str] = CHUNK_KEY, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of k-means over about ``sample`` vectors, those with the smallest hashes of their keys; about the root of the number of vectors many."""
    n = vectors.count()
    n_lists = min(n, n_lists or min(MOST_LISTS, int(np.sqrt(n)) + 1))
    if n_lists < 2:
        return np.zeros((n_lists, 0))
    place = F.xxhash64(*key).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    few = vectors if n <= sample else vectors.where(place < sample / n)
    model = KMeans(k=n_lists, seed=SEED, maxIter=10, featuresCol="features").fit(few.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
    return np.array(model.clusterCenters())


def build_vector_index(vectors: DataFrame, path: str | None = None, key: Sequence[str] = CHUNK_KEY, n_lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Write ``vectors(key…, vector)`` as lists under ``path``. Null vectors are left out; vectors of several dimensions are an error."""
    spark, key = vectors.sparkSession, list(key)
    path = path or scratch_path(spark, "lists")
    vectors = vectors.where(F.col("vector").isNotNull()).select(*key, "vector")
    found = vector_dimension(vectors).first()
    if found["min_dim"] != found["max_dim"]:
        raise ValueError(f"vectors of {found['min_dim']} to {found['max_dim']} dimensions in one table")
    centroids = fit_centroids(vectors, n_lists, key, sample)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                lists = _rank_lists(np.stack(batch["vector"].to_numpy()).astype(np.float64), shared.value, 1)[:, 0] if shared.value.shape[1] else 0
                yield batch.assign(list=np.int32(lists))

    schema = T.StructType([*vectors.schema.fields, T.StructField("list", T.IntegerType())])
    # ranges and not hashes of lists: a list with very many vectors is dealt over several tasks
    dealt = vectors.mapInPandas(assign, schema).repartitionByRange("list", *key).sortWithinPartitions("list", *key)
    dealt.write.partitionBy("list").parquet(f"{path}/vectors")
    rows = [(n, [float(x) for x in c]) for n, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    schema.fields[-1].nullable = True
    return VectorIndex(spark.read.schema(schema).parquet(f"{path}/vectors"), centroids, tuple(key))


def load_vector_index(spark: SparkSession, path: str, key: Sequence[str] = CHUNK_KEY) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # MOST_LISTS at most
    stored = spark.read.option("basePath", f"{path}/vectors").parquet(f"{path}/vectors")
    return VectorIndex(stored, np.array([r["centroid"] for r in rows]).reshape(len(rows), -1), tuple(key))


def nearest_approx(questions: DataFrame, index: VectorIndex, k: int, probes: int = PROBES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(question_id, key…, rank, distance): the ``k`` nearest of the vectors in the ``probes`` lists whose centroids are nearest to a question.

    Questions are sent to the scan in blocks of about ``block_bytes``; a block reads the lists that one of its questions probes, and no others.
    Equal distances go by key; null question vectors have no rows.
    """
    key = list(index.key)
    questions = questions.where(F.col("vector").isNotNull()).select("question_id", "vector")
    asked = vector_dimension(questions).first()
    dim = asked["max_dim"] or 0
    if asked["n_vectors"] and (asked["min_dim"] != dim or index.centroids.shape[1] not in (0, dim)):
        raise ValueError(f"questions of {asked['min_dim']} to {dim} dimensions, vectors of {index.centroids.shape[1]}")
    fields = [questions.schema["question_id"], *[index.vectors.schema[c] for c in key], T.StructField("distance", T.DoubleType())]
    blocks = n_blocks(asked["n_vectors"], dim, k, block_bytes)
    block = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    parts = [_scan_lists(questions.where(block == n), index, k, probes, T.StructType(fields), blocks) for n in range(blocks)]
    return top_k(reduce(DataFrame.unionByName, parts), ["question_id"], [F.asc("distance"), *[F.asc(c) for c in key]], k)


def _scan_lists(questions: DataFrame, index: VectorIndex, k: int, probes: int, schema: T.StructType, blocks: int) -> DataFrame:
    key = list(index.key)
    asked = questions.toPandas()  # a block, of bounded size
    ids = asked["question_id"].to_numpy()
    matrix = np.stack(asked["vector"].to_numpy()).astype(np.float64) if len(asked) else np.empty((0, 0))
    if len(asked) and index.centroids.shape[1]:
        ranked = _rank_lists(matrix, index.centroids, probes)
    else:
        ranked = np.zeros((len(asked), min(1, len(index.centroids))), dtype=np.int64)
    at, lists = np.repeat(np.arange(len(asked)), ranked.shape[1]), ranked.ravel()
    order = np.argsort(lists, kind="stable")
    names, first = np.unique(lists[order], return_index=True)
    probed = dict(zip(names.tolist(), np.split(at[order], first[1:])))
    shared = questions.sparkSession.sparkContext.broadcast((ids, matrix, probed))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, probed = shared.value
        best = Best(ids, matrix, key, k)
        for batch in batches:
            for number, rows in batch.groupby("list"):
                best.add(rows, probed[number])
        yield from best.rows()

    return tasks_of_pass(index.vectors.where(F.col("list").isin([int(n) for n in names])), blocks).mapInPandas(search, schema)


def vector_search_approx(
    questions: DataFrame, index: VectorIndex, k: int = 10, min_similarity: float = MIN_SIMILARITY, probes: int = PROBES, **options
) -> DataFrame:
    """``vector_search`` over the probed lists: the nearest ``2k``, then the similarity threshold, then the first ``k``."""
    wide = nearest_approx(questions, index, 2 * k, probes, **options)
    return similarity_filter(wide, min_similarity).where(F.col("rank") < k)


def recall(found: DataFrame, exact: DataFrame, key: Sequence[str] = CHUNK_KEY) -> DataFrame:
    """One row: how many hits an exact search has, and the share of them that another found."""
    hits = exact.select("question_id", *key).join(found.select("question_id", *key, F.lit(1).alias("met")), ["question_id", *key], "left")
    return hits.agg(F.count("*").alias("n_hits"), (F.count("met") / F.count("*")).alias("recall"))
