"""Ranked lexical search: impact vectors in buckets of like length, pruned by Cauchy-Schwarz and by bounds of their coordinates, rescored in whole numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.operators.ranking import top_k
from corpusqa.session import materialise

BEST = 50
# what is searched for in one pass; more is worked off in several passes
BLOCK_BYTES = 32 * 1024 * 1024  # of item texts
BLOCK_ITEMS = 4096
FIRST_SHARE = (1 / 64, 1 / 8)  # shares of the longest vectors that are searched before the rest, for the scores to beat
COMMON = 1 / 16  # a term in more of the documents than this is bounded, not added up, before a pair is rescored

_CELLS = 1 << 20
_DOCS = 2048
_PIECE = 1 << 22
_SLACK = 1e-9

# What stands between terms; A-Z alone change case.
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some four million bytes at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _PIECE) if at + _PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(_FOLDED).split(b" ")
        at = end


class Items:
    """A block of items with their terms, once each: rows ``item`` x columns ``term``, in the order of items and in the order of terms."""

    def __init__(self, texts: list[str | None]):
        self.n = len(texts)
        self.vocabulary: dict[bytes, int] = {}
        item, term = [], []
        for n, text in enumerate(texts):
            for found in dict.fromkeys(t for part in terms_of((text or "").encode()) for t in part if t):
                item.append(n)
                term.append(self.vocabulary.setdefault(found, len(self.vocabulary)))
        self.item, self.term = np.array(item, dtype=np.int64), np.array(term, dtype=np.int64)


def occurrences(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms array<int>, tfs array<int>): the number of terms of each whole text, and those the items have with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, lengths, terms, tfs = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                n, known = 0, []
                for part in terms_of(text.as_py() or b""):
                    n += len(part) - part.count(b"")
                    known += [k for k in map(number, part) if k is not None]
                found, times = np.unique(np.array(known, dtype=np.int64), return_counts=True)
                sizes.append(n)
                lengths.append(len(found))
                terms.append(found)
                tfs.append(times)
            offsets = pa.array(np.cumsum([0, *lengths]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *c]), pa.int32())) for c in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def impact_vectors(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, terms, impacts, square): what each term adds to a score for each unit of its weight, and the squared length of the vector."""
    m = 50 + F.expr(f"(50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    impacts = F.expr("transform(tfs, tf -> cast((1000000000L * tf) div (1000L * tf + 20L * m) as int))")
    square = F.expr("aggregate(impacts, 0L, (s, x) -> s + cast(x as bigint) * x)")
    return found.withColumn("m", m).select("doc_id", "terms", impacts.alias("impacts")).withColumn("square", square)


class Search:
    """Items with the weights of their terms, as a task uses them on buckets of vectors, the longest first."""

    def __init__(self, n: int, item: np.ndarray, term: np.ndarray, weights: np.ndarray, common: np.ndarray, beat: np.ndarray, k: int):
        self.n, self.k, self.beat, self.common = n, k, beat, common
        weight = weights[term]
        self.length = np.sqrt(np.bincount(item, weight.astype(float) ** 2, n))
        # sums below 2 ** 53 are exact in doubles; an item of very many terms is added up in whole numbers
        self.exact = bool((np.bincount(item, weight, n) * 1e6 < 2**53).all())
        rare = ~common[term]
        # of rare terms: which items have them; of common ones: a table of weights
        order = np.argsort(term[rare], kind="stable")
        self.of_item, self.of_weight = item[rare][order], weight[rare][order]
        self.first = np.searchsorted(term[rare][order], np.arange(len(weights)))
        self.uses = np.bincount(term[rare], minlength=len(weights))
        columns = np.flatnonzero(common)
        self.column = np.full(len(weights), -1)
        self.column[columns] = np.arange(len(columns))
        self.table = np.zeros((n, len(columns)), dtype=np.int64)
        self.table[item[~rare], self.column[term[~rare]]] = weight[~rare]
        self.rest = np.sqrt((self.table.astype(float) ** 2).sum(axis=1))

    def bucket(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score) of all pairs of a bucket whose score is above 0 and no less than the score to beat."""
        square = np.bincount(row, impact.astype(float) ** 2, n_rows)
        # Cauchy-Schwarz on the whole bucket, by its longest vector
        open_ = self.length * np.sqrt(square.max(initial=0.0)) * (1 + _SLACK) >= self.beat
        if not open_.any():
            return (np.empty(0, np.int64),) * 3
        of_common = self.common[term]
        r, t, x = row[~of_common], term[~of_common], impact[~of_common]
        uses = self.uses[t]
        match = np.repeat(np.arange(len(t)), uses)
        use = self.first[t[match]] + np.arange(len(match)) - np.repeat(np.cumsum(uses) - uses, uses)
        cell, added = self.of_item[use] * n_rows + r[match], self.of_weight[use] * x[match]
        if self.exact:
            score = np.bincount(cell, added, self.n * n_rows).reshape(self.n, n_rows)
        else:
            score = np.zeros(self.n * n_rows, dtype=np.int64)
            np.add.at(score, cell, added)
            score = score.reshape(self.n, n_rows)
        dense = np.zeros((n_rows, self.table.shape[1]), dtype=np.int64)
        dense[row[of_common], self.column[term[of_common]]] = impact[of_common]
        # the coordinates left over add no more than the largest of each, and no more than the product of both lengths
        most = self.table @ dense.max(axis=0, initial=0)
        left = np.sqrt((dense.astype(float) ** 2).sum(axis=1))
        slack = np.minimum(most.astype(float)[:, None], self.rest[:, None] * left[None, :] * (1 + _SLACK))
        item, at = np.nonzero(((score + slack) * (1 + _SLACK) >= np.maximum(self.beat, 1.0)[:, None]) & open_[:, None])
        exact = score[item, at].astype(np.int64)
        step = max(1, (1 << 22) // max(1, dense.shape[1]))
        for i in range(0, len(item), step):
            part = slice(i, i + step)
            exact[part] += np.einsum("ij,ij->i", self.table[item[part]], dense[at[part]])
        kept = (exact > 0) & (exact >= self.beat[item])
        return at[kept], item[kept], exact[kept]


class Best:
    """The best rows of each item so far; equal scores by ascending document, null first."""

    def __init__(self, search: Search):
        self.search, self.held, self.size = search, [], 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        self.held.append((item, score, doc, known))
        self.size += len(item)
        if self.size > 2 * self.search.k * self.search.n:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, doc, known = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((doc, known, -score, item))
        nth = np.arange(len(order)) - np.searchsorted(item[order], item[order], side="left")
        last = order[nth == self.search.k - 1]
        order = order[nth < self.search.k]
        self.search.beat[item[last]] = np.maximum(self.search.beat[item[last]], score[last])
        self.held, self.size = [(item[order], score[order], doc[order], known[order])], len(order)
        return self.held[0]


def _search(vectors: DataFrame, items: Items, weights: np.ndarray, common: np.ndarray, beat: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): the ``k`` best rows per item and task, of those that reach the score to beat."""
    shared = vectors.sparkSession.sparkContext.broadcast((items.n, items.item, items.term, weights, common, beat))
    step = max(1, min(_DOCS, _CELLS // max(1, items.n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *fixed, beat = shared.value
        search = Search(*fixed, beat.copy(), k)
        best = Best(search)
        for batch in batches:
            docs = batch.column("doc_id")
            doc, known = docs.fill_null(0).to_numpy(), docs.is_valid().to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column("terms")
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                term, impact = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "impacts"))
                place, item, score = search.bucket(row, term, impact, part.num_rows)
                if len(item):
                    best.add(item, score, doc[at + place], known[at + place])
        if best.held:
            item, score, doc, known = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=~known), pa.array(score)], names=["item", "doc_id", "score"])

    return vectors.select("doc_id", "terms", "impacts").mapInArrow(run, "item long, doc_id long, score long")


def _block(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, doc_id, score, rank) for one block of items, of bounded bytes; ``item`` is their place in ``asked``."""
    spark = docs.sparkSession
    items = Items([r["text"] for r in asked.collect()])
    found = materialise(occurrences(docs, items, id_col, text_col), "occurrences")
    totals = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 0
    # one number for each term of the block
    counted = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    weights, df = np.zeros(len(items.vocabulary), dtype=np.int64), np.zeros(len(items.vocabulary), dtype=np.int64)
    for term, times, value in counted.select("term", "df", weight).collect():
        weights[term], df[term] = value, times
    common = df > COMMON * n_docs
    vectors = impact_vectors(found.where(F.size("terms") > 0), n_docs, n_terms)
    vectors = materialise(vectors.repartitionByRange(F.desc("square"), F.asc("doc_id")).sortWithinPartitions(F.desc("square"), F.asc("doc_id")), "vectors")
    # the longest vectors, then less long ones, then the rest
    limits = vectors.agg(F.percentile_approx("square", [1 - share for share in FIRST_SHARE], 10_000)).first()[0] or []
    beat, square, best = np.zeros(items.n), F.col("square"), None
    for above, limit in zip([None, *limits], [*limits, None]):
        part = vectors if above is None else vectors.where(square < above)
        found = _search(part if limit is None else part.where(square >= limit), items, weights, common, beat, k)
        best = found if best is None else best.unionByName(found)
        best = top_k(best, ["item"], [F.desc("score"), F.asc_nulls_first("doc_id")], k)
        if limit is not None:
            best = materialise(best, "best")
            for item, score in best.where(F.col("rank") == k - 1).select("item", "score").collect():  # one number per item of the block
                beat[item] = score
            best = best.drop("rank")
    return best


def search(docs: DataFrame, items: DataFrame, k: int = BEST, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` the ``k`` documents with the highest scores above 0, all if fewer.

    Terms are runs of letters, digits and characters beyond ASCII in the whole text, with A-Z in lower case. A document's vector holds the
    impact of every term of the items it has, ``(1000000000 * tf) div (1000 * tf + 20 * m)`` with ``m = 50 + (50 * n * N) div L``; its product with the
    item's weights ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` is the score. ``rank`` counts from 1; equal scores go by ascending doc_id, null first.

    Vectors are put in the order of their lengths and searched in buckets of neighbours, the longest in a pass of their own: their scores
    are those that the rest, searched side by side, have to reach. A bucket is passed over for an item if the product of the item's length and
    the longest vector's is too small. Inside, rare terms are added up; what common terms could add is bounded by the largest coordinates of the
    bucket and by the lengths of what is left of both. Pairs that pass are rescored in whole numbers. Bounds only skip pairs that cannot be among the best.

    Null, empty and blank texts have no terms: such items have no rows, such documents are in none and do not count. Repeated items are searched for each, repeated documents are
    listed each, null ids pass through. Tables without rows give none; further columns are not read. Items are sent to the tasks in blocks
    of about ``block_bytes`` of text and ``block_items``, each a search of its own; a longer single item is a block by itself. Texts are cut into terms piece by piece.
    """
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    asked = materialise(asked.where(F.col("text").isNotNull()).withColumn("place", F.monotonically_increasing_id()), "items")
    sums = asked.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("items")).first()
    n_blocks = max(1, -(-(sums["bytes"] or 0) // block_bytes), -(-sums["items"] // block_items))
    parts = []
    for n in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("place"), F.lit(n_blocks)) == n).orderBy("place")
        found = _block(docs, block, k, id_col, text_col)
        places = [r["place"] for r in block.select("place").collect()]
        names = docs.sparkSession.createDataFrame(list(enumerate(places)), "item long, place long")
        parts.append(found.join(F.broadcast(names), "item").join(asked.drop("text"), "place"))
    best = reduce(DataFrame.unionByName, parts)
    return best.select("item_id", (F.col("rank") + 1).alias("rank"), "doc_id", "score")
