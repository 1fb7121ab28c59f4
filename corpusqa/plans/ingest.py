"""Documents or pages to chunks, and chunks into the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.models import interpret_pages
from corpusqa.operators.chunking import emit_page_chunks, semantic_chunk
from corpusqa.session import materialise
from corpusqa.sources.knowledge_base import KnowledgeBase
from corpusqa.sources.pages import assemble_pages


def chunk_documents(documents: DataFrame) -> DataFrame:
    """documents(filename, source, text) -> chunks. Text files are chunked as they are."""
    return semantic_chunk(documents)


def chunk_pages(pages: DataFrame, interpreter=None, include_pages: bool = True) -> DataFrame:
    """pages(filename, source, page_number, text_hint[, image]) -> text chunks and whole-page chunks.

    Every page is stored twice: its text takes part in the chunking of the file, and the page itself
    becomes a chunk. Pictures stay with their page rows and take no part in grouping the texts.
    """
    seen = interpret_pages(pages, interpreter).drop("text_hint")  # the text holds it
    if include_pages or interpreter is not None:
        seen = materialise(seen, "interpreted", "zstd")  # used twice: the model is not asked twice
    text_chunks = semantic_chunk(assemble_pages(seen.drop("image")).drop("n_pages"))
    if not include_pages:
        return text_chunks
    return emit_page_chunks(materialise(text_chunks.select("filename", "chunk_index", "source", "type", "text"), "text_chunks", "zstd"), seen)


def ingest_documents(base: KnowledgeBase, documents: DataFrame, replace: bool = False, txn: str | None = None) -> int:
    """Chunk, embed and store; returns the number of chunks stored."""
    return base.append(chunk_documents(documents), replace, txn)


def ingest_pages(base: KnowledgeBase, pages: DataFrame, interpreter=None, replace: bool = False) -> int:
    chunks = chunk_pages(pages, interpreter)
    return base.append(chunks.where(F.col("text").isNotNull()), replace)
