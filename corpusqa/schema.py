"""Column names and types of the tables passed between operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_DEFAULT = ""
CHUNK_TYPES = ("text", "image", "page")

DOCUMENTS = "filename string, source string, text string"
PAGES = "filename string, source string, page_number int, text_hint string"
CHUNKS = (
    "filename string, chunk_index int, source string, type string, text string, image string, "
    "headings array<string>, seg_type string"
)
VECTORS = CHUNKS + ", vector array<float>"
QUESTIONS = "question_id bigint, question string, rewritten string, keywords array<string>"

CHUNK_KEY = ("filename", "chunk_index")


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Select the columns of ``ddl`` from ``df``; absent ones become null of the right type."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in struct_of(ddl).fields
        ]
    )


def prepare_questions(df: DataFrame) -> DataFrame:
    """Fill the parts of a question that are missing: it is its own rewrite, it has no keywords.

    These are the values the reference behaviour falls back to when its models fail.
    """
    out = df
    if "rewritten" not in df.columns:
        out = out.withColumn("rewritten", F.col("question"))
    if "keywords" not in df.columns:
        out = out.withColumn("keywords", F.array().cast("array<string>"))
    return out.withColumn("rewritten", F.coalesce("rewritten", "question"))
