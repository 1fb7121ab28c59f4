"""The test tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.functions.text import parse_keyword_list
from corpusqa.models import embed_chunks
from corpusqa.operators.inverted_lists import VectorIndex, build_vector_index
from corpusqa.operators.lexical_index import LexicalIndex, build_index
from corpusqa.plans.ingest import chunk_documents
from corpusqa.session import materialise, spread
from corpusqa.sources.pages import paginate_text

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_documents(rows: DataFrame) -> DataFrame:
    """documents(doc_id, filename, chunk_index, source, lang, text): each text a chunk of its own file."""
    return rows.select(
        "doc_id",
        F.concat_ws("/", "source", "doc_id").alias("filename"),
        F.lit(0).alias("chunk_index"),
        "source",
        "lang",
        "text",
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return as_documents(table(spark, folder, "documents"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The same for heavy work on each text: spread over the cores if it comes in few files."""
    return as_documents(spread(table(spark, folder, "documents"), "doc_id"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"), parse_keyword_list(F.col("text")).alias("keywords")
    )


def plain_questions(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).drop("keywords")


def index(spark: SparkSession, folder: str) -> LexicalIndex:
    """Built once per application, as an index is."""
    return _once(spark, folder, "index", lambda: build_index(documents(spark, folder)))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("filename"),
        F.lit(0).alias("chunk_index"),
        F.col("embedding").alias("vector"),
        "vec_id",
        "label",
    )


def vector_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored vector asks for its neighbours."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))


def vector_lists(spark: SparkSession, folder: str) -> VectorIndex:
    return _once(spark, folder, "vector_lists", lambda: build_vector_index(vectors(spark, folder)))


def document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vector with a document's number is taken for the document's."""
    given = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return documents(spark, folder).drop("text", "lang").join(given, "doc_id")


def questions_with_vectors(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return plain_questions(spark, folder).join(given, "question_id")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    return as_markdown(texts(spark, folder))


def as_markdown(d: DataFrame) -> DataFrame:
    """A Markdown document around every text: headings, paragraphs, a table, a list."""
    number, facts = F.col("doc_id").cast("string"), F.length("text").cast("string")
    text = F.concat(
        F.lit("# "), F.col("source"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n \t\n")),
        F.lit("\n\n## Facts of "), number, F.lit("\n\n| name | value |\n|---|---|\n| number | "), number,
        F.lit(" |\n| language | "), F.col("lang"), F.lit(" |\n| length | "), facts, F.lit(" |\n\n- from "), F.col("source"),
        F.lit("\n- in "), F.col("lang"), F.lit("\n\n1.1 Notes on "), number, F.lit("\n\nShort note.\n\n第一章 概述\n\n【摘要】 "),
        F.col("filename"), F.lit("\n继续\n\n1. one\n\n\n# End\n\nThat was document "), number, F.lit(".\n"),
    )
    return d.select("doc_id", "filename", "source", text.alias("text"))


def sentence_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as a Markdown table with one sentence per row."""
    body = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(". "), F.lit(". |\n| "))
    return texts(spark, folder).select("doc_id", F.concat(F.lit("| sentence |\n| "), body, F.lit(" |")).alias("text"))


def sentence_pages(spark: SparkSession, folder: str) -> DataFrame:
    return paginate_text(texts(spark, folder).select("filename", "source", "text"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Answer events told word by word: one request per conversation turn."""
    c = table(spark, folder, "conversations")
    no_list = F.array().cast("array<string>")
    words = F.split("text", " ")
    request = F.concat_ws("-", "conv_id", "turn").alias("request_id")

    def event(kind, content=None, sources=None, images=None):
        return F.struct(
            F.lit(kind).alias("type"),
            (F.lit(None).cast("string") if content is None else content).alias("content"),
            (no_list if sources is None else sources).alias("sources"),
            (no_list if images is None else images).alias("images"),
        )

    told = F.concat(
        F.array(event("sources", sources=F.array(F.lit("early.md")))),
        F.array(event("sources", sources=F.array(F.concat(F.col("role"), F.lit(".md")), F.lit("b.md")))),
        F.array(event("images", images=F.array(F.concat(F.lit("img"), F.col("turn").cast("string"))))),
        F.transform(words, lambda w: event("content", content=F.concat(w, F.lit(" ")))),
        F.array(
            F.when(F.col("role") == "system", event("error", content=F.lit("timeout"))).otherwise(event("done")),
            event("content", content=F.lit("too late")),
            event("sources", sources=F.array(F.lit("late.md"))),
        ),
    )
    return c.select(request, F.posexplode(told).alias("seq", "e")).select("request_id", "seq", "e.*")


_cached: dict[tuple, object] = {}


def _once(spark: SparkSession, folder: str, what: str, make):
    key = (spark.sparkContext.applicationId, folder, what)
    if key not in _cached:
        _cached[key] = make()
    return _cached[key]


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all documents, written once per application."""
    made = lambda: materialise(
        chunk_documents(texts(spark, folder).select("filename", "source", "text"))
        .select("filename", "chunk_index", "source", "type", "text", F.lit(None).cast("string").alias("image")),
        "chunks",
    )
    return _once(spark, folder, "chunks", made)


def chunk_index(spark: SparkSession, folder: str) -> LexicalIndex:
    return _once(spark, folder, "chunk_index", lambda: build_index(chunks(spark, folder)))


def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    made = lambda: materialise(embed_chunks(chunks(spark, folder)).select("filename", "chunk_index", "vector"), "vectors")
    return _once(spark, folder, "chunk_vectors", made)
