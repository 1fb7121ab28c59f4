"""Benchmark passages in documents, with DataFrame functions only: spaced seeds find places, aligned words confirm them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.session import materialise

WINDOW = 15  # words that are compared at a time; a shorter item is compared whole
SHARE = 0.8  # of a window's words must be equal, each at its place

# Fixed masks: 1 compares the word, 0 passes over it. Whichever fifth of a window's words is replaced, one mask of its set fits in
# somewhere without touching a replaced word (checked in the tests for all windows of 15, and of 1 to 14 words). Of fewer than five words
# none may differ: the mask is the item.
LONG_MASKS = ("11111", "111011")
SHORT_MASKS = ("1111", "11011", "10111", "11101")

PART = 64  # words of an item that a part of it begins its own seeds at; it has the words that their windows reach besides

SENT_SEEDS = 2_000_000  # more seeds of benchmark items than this are joined by a shuffle and not sent to every task


def masks_of(size: int) -> tuple[str, ...]:
    """The masks that look for an item of so many words."""
    return LONG_MASKS if size >= WINDOW else SHORT_MASKS if size >= 5 else ("1" * size,)


def words(text: Column) -> Column:
    """Hashes of the words of a text: runs of letters and digits, lower-cased."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(hashed: str, place: str, masks: tuple[str, ...], own: bool = False) -> Column:
    """array<struct<span, seed>>: one hash for each mask that fits between ``place`` and the end; ``own``: of those for items of that size only."""
    found = []
    for mask in masks:
        chosen = [F.get(hashed, F.col(place) + k) for k, sign in enumerate(mask) if sign == "1"]
        fits = F.col(place) + len(mask) <= F.size(hashed)
        if own:
            fits &= F.size(hashed).isin([n for n in range(1, WINDOW) if mask in masks_of(n)]) | (F.size(hashed) >= WINDOW) & F.lit(mask in LONG_MASKS)
        found.append(F.struct(F.lit(len(mask)).alias("span"), F.when(fits, F.xxhash64(F.lit(mask), *chosen)).alias("seed")))
    return F.array(*found)


def _places(hashed: str, least: int) -> Column:
    return F.explode(F.when(F.size(hashed) >= least, F.sequence(F.lit(0), F.size(hashed) - least)).otherwise(F.array().cast("array<int>")))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", sent: int = SENT_SEEDS, least_words: int = 1
) -> DataFrame:
    """(doc_id, text_hash, item_id, n_equal, n_words, doc_word, item_word): one row per document and distinct item found in it.

    An item is found where a window of ``WINDOW`` of its words (the whole item, if shorter) lies over as many words of
    the document and at least ``SHARE`` of them are equal, place by place; n_equal and n_words describe the best window, whose
    first words are number doc_word and item_word. Words are runs of letters and digits, in lower case, so punctuation and
    layout do not matter. Both sides are hashed under fixed masks; equal hashes propose an alignment, and the windows
    around it are compared word by word. The masks lose no window of the stated share.

    Items of equal words are one item, named by its smallest id. Items without a word, null and empty ones, and those of fewer than ``least_words``
    are not looked for. Null and empty documents have no words and no rows. Repeated documents give one row; rows with
    a null id are told apart by the XXH64 of the text, which is returned for that. Ties go to the earlier place in the
    document, then in the item. No documents or no items: no rows. Further columns are not read. A text of any length is looked through whole.

    Up to ``sent`` seeds of items are sent to every task. More are met by a shuffle of the documents' seeds, which takes as many rows as there
    are words, without the words: those are brought back to the alignments found, so what is shuffled grows in proportion to a text.
    """
    known = items.select(F.col(item_id).cast("long").alias("item_id"), words(F.col(item_text)).alias("item"))
    known = materialise(known.where(F.size("item") >= max(least_words, 1)).groupBy("item").agg(F.min("item_id").alias("item_id")), "items")
    sizes = known.groupBy(F.least(F.size("item"), F.lit(WINDOW)).alias("size")).agg(F.sum(F.size("item")).alias("n")).collect()  # WINDOW rows at most
    masks = tuple(dict.fromkeys(m for row in sorted(sizes) for m in masks_of(row["size"]))) or LONG_MASKS
    least = min(map(len, masks))
    every = known.select("item_id", "item", _places("item", least).alias("item_at")).select("item_id", "item_at", F.inline(seeds("item", "item_at", masks, True)))
    every = every.where(F.col("seed").isNotNull())

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), words(F.col(text_col)).alias("doc"))
    placed = base.select("doc_id", "text_hash", "doc", _places("doc", least).alias("doc_at"))
    if sum(row["n"] for row in sizes) * len(masks) <= sent:
        looked = placed.select("doc_id", "text_hash", "doc", "doc_at", F.inline(seeds("doc", "doc_at", masks)))
        # Spark holds all hits of a document until it goes on to the next: they have the words around them and not the document
        hits = looked.where(F.col("seed").isNotNull()).join(F.broadcast(every), ["seed", "span"]).withColumn("last_at", F.col("item_at"))
        hits = hits.select("doc_id", "text_hash", "item_id", "item_at", "span", "last_at", "doc_at", *_words_around(), F.expr(f"item_at div {PART}").alias("part"))
        hits = hits.join(F.broadcast(_parts(known)), ["item_id", "part"])
    else:
        looked = placed.select("doc_id", "text_hash", "doc_at", F.inline(seeds("doc", "doc_at", masks))).where(F.col("seed").isNotNull())
        diagonal = (F.col("doc_at") - F.col("item_at")).alias("diagonal")
        lines = looked.join(every, ["seed", "span"]).groupBy("doc_id", "text_hash", "item_id", diagonal)
        # the windows of a line that cover one of its seeds lie between those of its first and its last
        lines = lines.agg(F.min(F.struct(F.col("item_at") + F.col("span"), "item_at", "span")).alias("first"), F.max("item_at").alias("last_at"))
        lines = materialise(lines.select("doc_id", "text_hash", "item_id", "diagonal", "first.item_at", "first.span", "last_at"), "lines").alias("l")
        texts = base.dropDuplicates(["doc_id", "text_hash"]).alias("t")
        same = F.col("l.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("l.text_hash") == F.col("t.text_hash"))
        hits = lines.join(texts, same).select("l.*", "t.doc", (F.col("diagonal") + F.col("item_at")).alias("doc_at"))
        hits = hits.select("doc_id", "text_hash", "item_id", "item_at", "span", "last_at", "doc_at", *_words_around())
        hits = hits.join(known.select("item_id", F.size("item").alias("item_size"), F.lit(0).alias("item_from"), "item"), "item_id")
    return (
        hits.select("doc_id", "text_hash", "item_id", _best_window().alias("best"))
        .where(F.col("best").isNotNull())
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max("best").alias("best"))
        .select("doc_id", "text_hash", "item_id", "best.n_equal", "best.n_words", (-F.col("best.doc_back")).alias("doc_word"), (-F.col("best.item_back")).alias("item_word"))
    )


def _words_around() -> list[Column]:
    """doc_size, doc_from and the words (doc) from there on that windows around a hit can lie over."""
    start = F.greatest(F.lit(0), F.col("doc_at") + F.col("span") - WINDOW)
    reach = F.col("last_at") - F.col("item_at") + 2 * WINDOW
    return [F.size("doc").alias("doc_size"), start.alias("doc_from"), F.slice("doc", start + 1, reach).alias("doc")]


def _parts(known: DataFrame) -> DataFrame:
    """(item_id, part, item_size, item_from, item): an item in parts, each with the words that windows around the seeds of ``PART`` places can lie over."""
    start = F.greatest(F.lit(0), F.col("part") * PART - WINDOW).cast("int")
    listed = known.select("item_id", "item", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size(item) - 1) div {PART}"))).alias("part"))
    return listed.select("item_id", "part", F.size("item").alias("item_size"), start.alias("item_from"), F.slice("item", start + 1, PART + 2 * WINDOW).alias("item"))


def _best_window() -> Column:
    """Of the windows around a hit that have words enough in common, the best; null if there is none.

    A window lies within the item and the document, does not end before the seed does and does not begin after ``last_at``.
    ``item`` and ``doc`` hold the words from number item_from and doc_from on.
    """
    n, size = F.col("item_size"), F.col("doc_size")
    width = F.least(F.lit(WINDOW), n)
    diagonal = F.col("doc_at") - F.col("item_at")
    first = F.greatest(F.lit(0), -diagonal, F.col("item_at") + F.col("span") - width)
    last = F.least(F.col("last_at"), n - width, size - diagonal - width)

    def window(start: Column) -> Column:
        mine, theirs = F.slice("item", start - F.col("item_from") + 1, width), F.slice("doc", start + diagonal - F.col("doc_from") + 1, width)
        total = F.aggregate(F.zip_with(mine, theirs, lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
        return F.struct(total.alias("n_equal"), width.alias("n_words"), (-(start + diagonal)).alias("doc_back"), (-start).alias("item_back"))

    starts = F.when(first <= last, F.sequence(first, last))
    return F.array_max(F.filter(F.transform(starts, window), lambda w: w["n_equal"] >= SHARE * w["n_words"]))


def without_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT_SEEDS) -> DataFrame:
    """The rows of ``docs`` that ``found`` (doc_id, text_hash) does not name. Its keys are written and counted; only
    up to ``sent`` of them are sent to every task, more are met by a shuffle. Repeated rows go or stay together, null ids and null texts are values like
    any other, no rows give none; columns may have any names and all are kept."""
    keys = materialise(found.select("doc_id", "text_hash").distinct(), "found")
    if keys.count() <= sent:
        keys = F.broadcast(keys)
    same = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(F.col(f"d.`{text_col}`").cast("string")) == F.col("k.text_hash"))
    return docs.alias("d").join(keys.alias("k"), same, "left_anti")
