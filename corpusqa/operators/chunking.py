"""Heading-aware chunking of document texts.

Everything happens inside the row of a document: one narrow stage, no shuffle. Splitting and classifying paragraphs are native;
the walk that packs them and cuts long ones, and the second split of long pieces, are pandas UDFs: a native fold would copy all
chunks so far at every step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusqa.functions.text import CJK, WHITE_SPACE, WS, let, normalize_ingest_text, utrim

# Fixed values ---------------------------------------------------------------
PACK_CHARS = 800
TABLE_CHARS = 1000
SPLIT_ABOVE = 1000
SPLIT_CHARS = 2000
SPLIT_OVERLAP = 150
MIN_CHARS = 10
PARAGRAPH_CHARS = 50
SEPARATORS = ("\n\n【", "\n\n##", "\n\n#", "\n---", "\n\n", "\n", "。|！|？", ". |! |? ", ", |，")
TABLE = r"\A\|[^\n]+\|"
LIST_ITEM = rf"\A(?:[0-9]+[.、]|\*|[-•▪▸]){WS}+"
HEADING_MARK = rf"\A#{{1,6}}{WS}+"
HEADING_CJK = rf"\A[{CJK}]+[章节条点]"
HEADING_NUMBER = rf"\A[0-9]+[.、][{CJK}a-zA-Z0-9][^\n]*"
SENTENCE_END = "。！？.!?"
HEADING_JOIN = " › "
BYTES_AT_ONCE = 4 * 1024 * 1024  # of segments that are Python objects at the same time
_SEGMENT_BYTES = 512  # of a segment besides its text
# -----------------------------------------------------------------------------


def split_paragraphs(text: Column) -> Column:
    """Groups of lines between blank lines, each trimmed."""
    groups = F.split(text, rf"\n{WS}*\n")
    return F.filter(F.transform(groups, lambda p: utrim(p)), lambda p: p != "")


def classify_segment(text: Column) -> Column:
    """paragraph, table, list, heading or other; the first rule that holds decides."""
    text = utrim(text)
    heading = (
        text.rlike(rf"{HEADING_MARK}(?s:.)") | text.rlike(rf"{HEADING_CJK}(?s:.)") | text.rlike(rf"{HEADING_NUMBER}\z")
    )
    return (
        F.when(text == "", "other")
        .when(text.rlike(TABLE), "table")
        .when(text.rlike(LIST_ITEM), "list")
        .when(heading, "heading")
        .when((F.length(text) > PARAGRAPH_CHARS) | F.contains(text, F.lit("\n")), "paragraph")
        .otherwise("other")
    )


def parse_heading(text: Column) -> Column:
    """The title a heading passes on to the chunks below it; null when there is none."""
    text = utrim(text)
    line = "[^\n\r\u2028\u2029]"

    def found(pattern: str, group: int) -> Column:
        return F.when(text.rlike(pattern), utrim(F.regexp_extract(text, pattern, group)))

    return F.coalesce(
        found(rf"{HEADING_MARK}({line}+)", 1),
        found(rf"{HEADING_CJK}(?s:.)+", 0),
        found(HEADING_NUMBER, 0),
        found(rf"\A【({line}+?)】", 1),
    )


_AFTER_SENTENCE = re.compile(rf"(?<=[{SENTENCE_END}]){WS}*")


def cut_sentences(text: str, most: int = PACK_CHARS) -> list[str]:
    """Cut after sentence ends, drop the white space there, re-join up to ``most`` characters; in time proportional to the text."""
    out, current, size = [], [], 0
    for sentence in _AFTER_SENTENCE.split(text):
        if not sentence.strip(WHITE_SPACE):
            continue
        if current and size + len(sentence) > most:
            out.append("".join(current))
            current, size = [], 0
        current.append(sentence)
        size += len(sentence)
    out.append("".join(current))
    return [t for t in (piece.strip(WHITE_SPACE) for piece in out) if t] or [text]


def cut_table(text: str, most: int = TABLE_CHARS) -> list[str]:
    """Rows in groups of at most ``most`` characters, each group under the first line again; in time proportional to its output."""
    header, *rows = text.split("\n")
    out, current, size = [], [], len(header)
    for row in rows:
        if current and size + len(row) > most:
            out.append("\n".join([header, *current]).strip(WHITE_SPACE))
            current, size = [], len(header)
        current.append(row)
        size += len(row)
    last = "\n".join([header, *current]).strip(WHITE_SPACE)
    if last != header.strip(WHITE_SPACE):
        out.append(last)
    return out or [text]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut_sentences(texts: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([[t] if t is None else cut_sentences(t, int(m)) for t, m in zip(texts, most)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut_table(texts: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([[t] if t is None else cut_table(t, int(m)) for t, m in zip(texts, most)], dtype=object)


def split_sentences(text: Column, most: int = PACK_CHARS) -> Column:
    """Sentences re-joined up to ``most`` characters; a single longer sentence stays whole."""
    return _cut_sentences(text, F.lit(most))


def split_table(text: Column, most: int = TABLE_CHARS) -> Column:
    """Rows in groups of at most ``most`` characters, each group under the first line again."""
    return _cut_table(text, F.lit(most))


def _segment(paragraph: Column) -> Column:
    def describe(kind: Column) -> Column:
        title = F.when(kind == "heading", parse_heading(paragraph))
        return F.struct(paragraph.alias("content"), kind.alias("seg_type"), title.alias("heading"))

    return let(classify_segment(paragraph), describe)


def pack_paragraphs(documents: DataFrame, text: Column, out: str = "packed", most: int = PACK_CHARS, split_long: bool = False) -> DataFrame:
    """documents + ``out``, the chunks of a text: ``array<struct<headings, content, seg_type>>``, before the second split or (``split_long``) after it.

    Short paragraphs are joined up to ``most`` characters; headings, tables, lists and over-long
    paragraphs end the block before them. Every heading is a chunk of its own under the headings
    before it, and stays in the chain of all later chunks.
    """
    # a column of its own, read twice: inlined into the UDF's arguments, Spark would not take the UDF out of the expression
    listed = documents.withColumn("_segments", F.transform(split_paragraphs(text), _segment))
    packed = F.when(F.size("_segments") >= 0, _pack(F.col("_segments"), F.lit(most), F.lit(split_long)))
    return listed.withColumn(out, packed).drop("_segments")


_PACKED = T.ArrayType(
    T.StructType([T.StructField("headings", T.ArrayType(T.StringType())), T.StructField("content", T.StringType()), T.StructField("seg_type", T.StringType())])
)


@F.arrow_udf(_PACKED)
def _pack(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The walk over the segments of each document, in time proportional to what it returns; of a batch, a few documents are unpacked at a time."""
    kind = to_arrow_type(_PACKED)
    for segments, most, split_long in batches:
        for start, n in _portions(segments):
            columns = [c.slice(start, n).to_pylist() for c in (segments, most, split_long)]
            yield pa.array([None if s is None else _packed(s, m, l) for s, m, l in zip(*columns)], kind)


def _portions(segments: pa.Array, most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """(start, number) of rows that take about ``most`` bytes when unpacked, one row at least."""
    sizes = pc.fill_null(pc.list_value_length(segments), 0).to_numpy(zero_copy_only=False)
    each = pc.fill_null(pc.binary_length(segments.flatten().field("content")), 0).to_numpy(zero_copy_only=False)
    taken = np.concatenate([[0], np.cumsum(each.astype(np.int64) + _SEGMENT_BYTES)])[np.cumsum(sizes)]
    start = 0
    while start < len(sizes):
        done = taken[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(taken, done + most, side="right")))
        yield start, stop - start
        start = stop


def _packed(segments, most: int, split_long: bool) -> list[dict]:
    chain: tuple[str, ...] = ()
    out: list[dict] = []
    current, size = [], 0

    def add(content: str, kind: str) -> None:
        if len(content.strip(WHITE_SPACE)) <= MIN_CHARS:
            return
        parts = [content]
        if split_long and len(content) > SPLIT_ABOVE:
            parts = [t for t in (p.strip(WHITE_SPACE) for p in split_recursively(content)) if len(t) > MIN_CHARS]
        out.extend({"headings": chain, "content": part, "seg_type": kind} for part in parts)

    def flush() -> None:
        if size > MIN_CHARS:
            add("\n\n".join(current), "paragraph")

    for segment in segments:
        content, kind = segment["content"], segment["seg_type"]
        if kind in ("heading", "table", "list") or len(content) > most:
            pieces = [content] if kind == "heading" else cut_sentences(content, most) if kind not in ("table", "list") else cut_table(content)
            flush()
            current, size = [], 0
            for piece in pieces:
                add(piece.strip(WHITE_SPACE), kind if kind in ("heading", "table", "list") else "paragraph")
            if segment["heading"] is not None:
                chain = (*chain, segment["heading"])
            continue
        joined = size + 2 + len(content) if current else len(content)
        if joined <= most:
            current.append(content)
            size = joined
        else:
            flush()
            current, size = [content], len(content)
    flush()
    return out


def min_chunk_length(chunks: Column) -> Column:
    """Drop chunks of ten characters or fewer."""
    return F.filter(chunks, lambda c: F.length(utrim(c["content"])) > MIN_CHARS)


def _pieces_between(text: str, separator: str) -> list[str]:
    """Cut before every occurrence of ``separator``; it stays at the head of its piece."""
    cuts, at = [0], text.find(separator)
    while at >= 0:
        cuts.append(at)
        at = text.find(separator, at + 1)
    return [text[a:b] for a, b in zip(cuts, cuts[1:] + [len(text)]) if a < b]


def _merged(pieces: list[str]) -> list[str]:
    """Join neighbours up to the limit; a new chunk starts with the last pieces of the one before."""
    out, window, size = [], [], 0
    for piece in pieces:
        if window and size + len(piece) > SPLIT_CHARS:
            out.append("".join(window))
            room = min(SPLIT_OVERLAP, SPLIT_CHARS - len(piece))
            while size > room:
                size -= len(window.pop(0))
        window.append(piece)
        size += len(piece)
    out.append("".join(window))
    return [t for t in (chunk.strip(WHITE_SPACE) for chunk in out) if t]


def split_recursively(text: str, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the coarsest separator present, finer ones for what is still too long."""
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        # an exhausted list means cutting anywhere; otherwise the text cannot be cut and stays whole
        return _merged(list(text)) if not separators else (_merged([text]) if len(text) < SPLIT_CHARS else [text])
    out, short = [], []
    for piece in _pieces_between(text, separators[at]):
        if len(piece) < SPLIT_CHARS:
            short.append(piece)
            continue
        out += _merged(short) if short else []
        short = []
        out += split_recursively(piece, separators[at + 1 :])
    return out + (_merged(short) if short else [])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _recursive_split(contents: pd.Series) -> pd.Series:
    def row(texts):
        return None if texts is None else [None if t is None else split_recursively(t) for t in texts]

    return contents.map(row)


def recursive_split(chunks: Column) -> Column:
    """Second split, for chunks over 1000 characters only; the others never leave the JVM."""
    too_long = lambda c: F.length(c["content"]) > SPLIT_ABOVE
    contents = F.when(
        F.exists(chunks, too_long), F.transform(chunks, lambda c: F.when(too_long(c), c["content"]))
    )
    return _recursive_split(contents)


def _listed(documents: DataFrame, text: str) -> tuple[list[str], DataFrame]:
    carried = [c for c in documents.columns if c != text]
    described = F.transform(split_paragraphs(normalize_ingest_text(F.col(text))), _segment)
    return carried, documents.select(*carried, described.alias("_segments"))


def segments(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per paragraph: para_pos, content, seg_type and, for headings, the title (heading)."""
    carried, listed = _listed(documents, text)
    # outer: no "not empty" filter is derived, which would split and classify every text twice
    rows = listed.select(*carried, F.posexplode_outer("_segments").alias("para_pos", "s"))
    return rows.where(F.col("para_pos").isNotNull()).select(*carried, "para_pos", "s.*")


@F.pandas_udf(T.StructType([T.StructField("spelled", T.StringType()), T.StructField("ends", T.ArrayType(T.IntegerType()))]))
def _chain(titles: pd.Series) -> pd.DataFrame:
    """All titles of a document as one string, and for each paragraph how much of it is the chain of those above."""
    spelled, ends = [], []
    for row in titles:
        end, found, mine = 0, [], []
        for title in () if row is None else row:
            mine.append(end)
            if title is not None:
                end += len(title) + (len(HEADING_JOIN) if found else 0)
                found.append(title)
        spelled.append(HEADING_JOIN.join(found))
        ends.append(mine)
    return pd.DataFrame({"spelled": spelled, "ends": ends})


def heading_chain(documents: DataFrame, text: str = "text") -> DataFrame:
    """``segments`` with chain, the headings above each paragraph, joined (empty: none).

    A document's titles are written down once, as one string; a paragraph holds the number of its characters that are above it,
    and the chain is cut from there when it is read.
    """
    carried, listed = _listed(documents, text)
    titles = F.transform(F.col("_segments"), lambda s: s["heading"])
    # a column of its own, as for the walk
    chained = listed.withColumn("_titles", titles).withColumn("_chain", _chain(F.col("_titles")))
    placed = F.arrays_zip("_segments", F.col("_chain.ends").alias("ends"))
    rows = chained.select(*carried, F.col("_chain.spelled").alias("_spelled"), F.posexplode_outer(placed).alias("para_pos", "s"))
    rows = rows.where(F.col("para_pos").isNotNull())
    return rows.select(*carried, "para_pos", "s._segments.*", F.substring("_spelled", F.lit(1), F.col("s.ends")).alias("chain"))


def under_chain(chain: Column, content: Column) -> Column:
    """The spelled chain of headings in front of the content."""
    return F.when(chain == "", content).otherwise(F.concat(F.lit("["), chain, F.lit("]\n"), content))


def chunk_text_with_headings(headings: Column, content: Column) -> Column:
    """The chain of headings in front of the content, so that a chunk can be read on its own."""
    return under_chain(F.array_join(headings, HEADING_JOIN), content)


def semantic_chunk(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents(filename, source, text) -> text chunks numbered from 0 within each document."""
    carried = [c for c in documents.columns if c != text]
    packed = pack_paragraphs(documents, normalize_ingest_text(F.col(text)), "_packed", split_long=True)
    # outer: no "not empty" filter is derived, which would call for the chunks a second time
    chunks = packed.select(*carried, F.posexplode_outer("_packed").alias("chunk_index", "c")).where(F.col("chunk_index").isNotNull())
    return chunks.select(
        *carried,
        "chunk_index",
        F.lit("text").alias("type"),
        chunk_text_with_headings(F.col("c.headings"), F.col("c.content")).alias("text"),
        F.col("c.headings").alias("headings"),
        F.col("c.seg_type").alias("seg_type"),
        F.col("c.content").alias("content"),
    )


def number_chunks(text_chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Give page chunks the numbers after the text chunks of their file, in page order.

    A group is the pages of one file, as in ``assemble_pages``; pages are dealt out once, with their texts, and pages without a filename have no number.
    """
    counts = text_chunks.groupBy("filename").agg(F.count("*").cast("int").alias("n_text"))
    numbered = pages.where(F.col("filename").isNotNull()).withColumn("page_at", F.row_number().over(W.partitionBy("filename").orderBy("page_number")) - 1)
    return numbered.join(counts, "filename", "left").withColumn(
        "chunk_index", (F.coalesce("n_text", F.lit(0)) + F.col("page_at")).cast("int")
    ).drop("n_text", "page_at")


def emit_page_chunks(text_chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Text chunks plus one whole-page chunk per page(filename, source, page_number, text[, image])."""
    page_chunks = number_chunks(text_chunks, pages).select(
        "filename",
        "chunk_index",
        "source",
        F.lit("page").alias("type"),
        "text",
        (F.col("image") if "image" in pages.columns else F.lit(None).cast("string")).alias("image"),
    )
    return text_chunks.select(
        "filename", "chunk_index", "source", "type", "text", F.lit(None).cast("string").alias("image")
    ).unionByName(page_chunks)
