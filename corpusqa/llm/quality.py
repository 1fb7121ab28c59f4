"""Quality of texts by naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.grams import bucket, slices, style_grams
from corpusqa.llm.linear import fit_hinge, fit_sigmoid, sigmoid

BITS = 17  # n-grams are hashed into this many bits
ROWS_PER_CLASS = 3000  # the classifier is fitted to so many labelled rows of each class at most
SAMPLE_GRAMS = 1 << 27  # and to rows of so many n-grams in all: a row has 2^17 at most, so this is over a thousand rows, however long
THRESHOLD = 0.3
FOLDS = 3


def indicators(text: str | None, bits: int = BITS) -> np.ndarray:
    """The hashed n-grams that occur anywhere in the text, ascending."""
    seen = np.zeros(1 << bits, dtype=bool)
    for part in slices(text or ""):
        for grams in style_grams(part):
            seen[bucket(grams, bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class QualityModel:
    ratios: np.ndarray
    weights: np.ndarray  # with the ratios multiplied in; the last one is the bias
    slope: float
    offset: float

    def score(self, found: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(found) + self.offset))

    def margin(self, found: np.ndarray) -> float:
        length = np.sqrt((self.ratios[found] ** 2).sum())
        return float(self.weights[found].sum() / length + self.weights[-1] if length else self.weights[-1])


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray, size: int) -> np.ndarray:
    """log of how much more of the positive rows' indicators each n-gram makes up than of the negative rows', smoothed by one."""
    counts = [np.ones(size), np.ones(size)]
    for found, yes in zip(rows, positive):
        counts[int(yes)][found] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def fit_machine(rows: list[np.ndarray], positive: np.ndarray, size: int, cost: float) -> tuple[np.ndarray, np.ndarray]:
    ratios = log_count_ratios(rows, positive, size)
    scaled = []
    for found in rows:
        values = ratios[found]
        scaled.append((found, values / max(np.sqrt(values @ values), 1e-12)))
    w = fit_hinge(scaled, np.where(positive, 1.0, -1.0), size, cost=cost, epochs=15)
    return ratios, np.append(w[:-1] * ratios, w[-1])


def fit_quality(rows: list[np.ndarray], positive: np.ndarray, rate: float, size: int = 1 << BITS, cost: float = 10.0) -> QualityModel:
    """``rate``: the share of positive rows among all labelled ones, which the scores are fitted to; the margins for
    that come from rows that the machine in question has not seen."""
    if not positive.any() or positive.all():
        return QualityModel(np.zeros(size), np.zeros(size + 1), 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    fold = np.arange(len(rows)) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        inside = np.flatnonzero(fold != k)
        ratios, weights = fit_machine([rows[i] for i in inside], positive[inside], size, cost)
        model = QualityModel(ratios, weights, 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = model.margin(rows[i])
    mine = positive.mean()
    importance = np.where(positive, rate / mine, (1 - rate) / (1 - mine))
    slope, offset = fit_sigmoid(margins, positive, importance)
    return QualityModel(*fit_machine(rows, positive, size, cost), slope, offset)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _packed(found: np.ndarray) -> bytes:
    if 4 * len(found) < 1 << BITS - 3:
        return found.tobytes()
    seen = np.zeros(1 << BITS, dtype=bool)
    seen[found] = True
    return np.packbits(seen).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    if len(packed) < 1 << BITS - 3:
        return np.frombuffer(packed, dtype=np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, dtype=np.uint8))).astype(np.int32)


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, per_class: int, grams: int):
    """Indicators and labels of a bounded sample (the smallest hashes of ids), and the share of label 1 among all that may be learnt from.

    A row is sent to the driver as its n-grams' numbers or, where that is less, as one bit for each possible number: 16 kB at most, whatever its text.
    """
    given = labels.where(learn & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("place")
    )
    counts = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    chosen = [given.where(F.col("label") == k).orderBy("place").limit(per_class) for k in (0, 1)]
    # at most 2 * per_class rows are sent to the scan of the texts
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_packed(indicators(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["place", "label", "found"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(sample, "doc_id").select("place", "label", "text").mapInArrow(run, "place long, label int, found binary")
    rows = joined.orderBy("place", "found", "label").limit(2 * per_class).collect()
    rate = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    found, total = [], 0
    for row in rows:
        mine = _unpacked(row["found"])
        total += len(mine)
        if total > grams:
            break
        found.append(mine)
    return found, np.array([r["label"] == 1 for r in rows[: len(found)]], dtype=bool), rate


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None,
    per_class: int = ROWS_PER_CLASS, threshold: float = THRESHOLD, grams: int = SAMPLE_GRAMS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; the score is the likelihood of label 1.

    Learns from labels 0 and 1 of rows of ``labels`` for which ``learn`` holds (else: the CRC-32 of the id as text modulo 5 is not
    0), at most ``per_class`` rows of each and rows of ``grams`` n-grams in all (in the order of the ids' hashes); scores every row from its whole text alone. N-gram indicators are scaled by
    the class log-count ratios, rows are put at unit length, and a hinge loss is minimised by dual coordinate descent.

    Null and empty texts have no n-gram and get the score of that. With labels of one class, or none, every text has
    the same score. Rows with a null id are scored and count as not held out. Other labels than 0 and 1 and labels of unknown
    documents are not learnt from; a label given twice counts twice. Repeated rows give repeated results, no rows give none,
    further columns are not read.
    """
    learn = ~held_out(id_col) & F.col(id_col).isNotNull() if learn is None else learn
    model = fit_quality(*training_rows(docs, labels, learn, id_col, text_col, label_col, per_class, grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(indicators(t.as_py())) for t in batch.column(2)], dtype=np.float64)
            columns = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
