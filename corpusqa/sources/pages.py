"""Documents out of pages, pages out of texts, documents out of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.functions.text import let, utrim
from corpusqa.operators.context import BLOCK_JOIN
from corpusqa.operators.ranking import number_rows

# Fixed values
LINE_CHARS = 42
PAGE_LINES = 42
EMPTY_DOCUMENT = "空文档"
PAGE_HEAD = ("第 ", " 页\n")
TABLE_HEAD = ("\n--- 表格: ", " ---\n")
ROWS_PER_DOCUMENT = 1000


def page_block(page_number: Column, text: Column) -> Column:
    """How a page's own text is introduced when no model has read the page."""
    return F.concat(F.lit(PAGE_HEAD[0]), page_number.cast("string"), F.lit(PAGE_HEAD[1]), F.coalesce(text, F.lit("")))


def assemble_pages(pages: DataFrame, text: str = "text", separator: str = BLOCK_JOIN, introduce: bool = False) -> DataFrame:
    """pages -> documents(filename, text, n_pages): page texts in page order.

    Interpreted pages are joined by a rule; with ``introduce`` each page's plain text follows a line
    with its number. A group is the pages of one file, which upload limits to 50 MB.
    """
    value = page_block(F.col("page_number"), F.col(text)) if introduce else F.col(text)
    carried = ["filename", *(["source"] if "source" in pages.columns else [])]
    ordered = F.sort_array(F.collect_list(F.struct("page_number", value.alias("v"))))
    return pages.groupBy(*carried).agg(
        F.array_join(F.transform(ordered, lambda s: s["v"]), separator).alias("text"), F.count("*").alias("n_pages")
    )


def paginate_text(documents: DataFrame, chars: int = LINE_CHARS, lines: int = PAGE_LINES) -> DataFrame:
    """documents -> pages(filename, …, page_number, text_hint): wrapped lines, so many to a page.

    Blank lines stay; an empty text becomes one page saying so. Done inside the row of the document.
    """
    text = F.coalesce(F.nullif(utrim(F.coalesce("text", F.lit(""))), F.lit("")), F.lit(EMPTY_DOCUMENT))
    # cutting with a pattern reads a line once, however long it is
    pieces = rf"(?s).{{1,{chars}}}"

    def wrap(line: Column) -> Column:
        return let(
            utrim(line),
            lambda t: F.when(t == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(t, F.lit(pieces), F.lit(0))),
        )

    wrapped = F.flatten(F.transform(F.split(text, "\r?\n"), wrap))
    carried = [c for c in documents.columns if c != "text"]
    rows = documents.select(*carried, wrapped.alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(lines))
    pages = F.transform(starts, lambda s: F.array_join(F.slice("lines", s, lines), "\n"))
    return rows.select(*carried, F.posexplode(pages).alias("p", "text_hint")).select(
        *carried, (F.col("p") + 1).alias("page_number"), "text_hint"
    )


def renumber_pages(text_pages: DataFrame, image_pages: DataFrame) -> DataFrame:
    """Text pages, then the embedded images of the same file with the page numbers that follow."""
    last = text_pages.groupBy("filename").agg(F.max("page_number").alias("n_text"))
    moved = (
        number_rows(image_pages, ["page_number"], ["filename"], "at")
        .join(last, "filename", "left")
        .withColumn("page_number", (F.coalesce("n_text", F.lit(0)) + F.col("at") + 1).cast("int"))
        .drop("n_text", "at")
    )
    return text_pages.unionByName(moved, allowMissingColumns=True)


def csv_field(value: Column) -> Column:
    """A field as CSV spells it: quoted when it holds a comma, a quote or a line break."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\n\r]'), quoted).otherwise(value)


def table_to_documents(
    table: DataFrame,
    group: str,
    order: Sequence[str],
    columns: Sequence[str],
    rows_per_document: int = ROWS_PER_DOCUMENT,
) -> DataFrame:
    """Rows of any table as searchable text: documents(filename, part, text, n_rows).

    A group's rows become CSV lines under the header line. A large group yields several documents of
    ``rows_per_document`` rows, each under the header, so no group is ever brought together whole.
    """
    numbered = number_rows(table, list(order), [group], "at")
    line = F.concat_ws(",", *[csv_field(F.col(c)) for c in columns])
    parts = numbered.select(
        F.col(group).cast("string").alias("filename"),
        F.floor(F.col("at") / rows_per_document).cast("int").alias("part"),
        "at",
        line.alias("line"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("at", "line")))
    body = F.array_join(F.transform(ordered, lambda s: s["line"]), "\n")
    header = F.concat(F.lit(TABLE_HEAD[0]), F.col("filename"), F.lit(TABLE_HEAD[1] + ",".join(columns) + "\n"))
    documents = parts.groupBy("filename", "part").agg(body.alias("body"), F.count("*").alias("n_rows"))
    return documents.select("filename", "part", F.concat(header, "body", F.lit("\n")).alias("text"), "n_rows")
