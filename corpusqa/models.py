"""Call points for models: batch functions supplied by the user, with offline defaults.

A batch function takes pandas Series and returns a Series; a null stands for a failed call. It runs
in Arrow batches inside the tasks, so the number of partitions of its input bounds how many calls are
in flight. Spark may run a task again: calls happen at least once.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusqa.functions.text import page_heading_text, parse_keyword_list, parse_score, tokenize, truncate_text
from corpusqa.session import materialise

# Fixed values ---------------------------------------------------------------
EMPTY_CHUNK = "[空块]"
IMAGE_CHUNK = "[图片块]"
RATE_LIMIT_MARKS = ("429", "Too Many Requests", "Throttling")
RETRIES = 5
PAGE_RETRIES = 3
PAGE_WAIT_LIMITED = 3.0
PAGE_WAIT = 1.0
PAGE_RATE_LIMIT_MARKS = ("429", "Too Many Requests", "速率限制", "1302")
APOLOGY = "抱歉，处理您的问题时出现错误: "
UNKNOWN_ERROR = "未知错误"
# -----------------------------------------------------------------------------

SENT_FILES = 1_000_000  # page counts of more files than this are joined by a shuffle and not sent to every task

Embedder = Callable[[DataFrame, str, str], DataFrame]


def with_retry(call: Callable, retries: int = RETRIES, base_seconds: float = 1.0, any_error: bool = False, waits: Callable[[Exception], float] | None = None) -> Callable:
    """Repeat a call that was turned away for its rate (``any_error``: for whatever reason), waiting twice as long each time.

    ``waits`` gives the first waiting time by the error; else it is ``base_seconds``.
    """

    def attempt(*args):
        for n in range(retries + 1):
            try:
                return call(*args)
            except Exception as error:
                if n == retries or not (any_error or any(mark in str(error) for mark in RATE_LIMIT_MARKS)):
                    raise
                first = base_seconds if waits is None else waits(error)
                time.sleep(first * 2**n + random.random() * first / 2)

    return attempt


def _page_wait(scale: float) -> Callable[[Exception], float]:
    return lambda error: scale * (PAGE_WAIT_LIMITED if any(m in str(error) for m in PAGE_RATE_LIMIT_MARKS) else PAGE_WAIT)


def _by_halves(call: Callable, columns: list[pd.Series], rows_per_call: int | None) -> tuple[list, list]:
    """(replies, errors), one of each per row: a call that fails is made again on both halves of its rows, down to one row."""
    n = len(columns[0])
    replies, errors = [None] * n, [None] * n
    todo = [(at, min(at + (rows_per_call or n), n)) for at in range(0, n, rows_per_call or max(n, 1))]
    while todo:
        low, high = todo.pop()
        try:
            made = list(call(*[c.iloc[low:high].reset_index(drop=True) for c in columns]))
            if len(made) != high - low:
                raise ValueError(f"{len(made)} replies to {high - low} rows")
            replies[low:high] = made
        except Exception as error:
            if high - low == 1:
                errors[low] = str(error)
            else:
                todo += [(low, (low + high) // 2), ((low + high) // 2, high)]
    return replies, errors


def batch_udf(
    call: Callable[..., pd.Series], returns: T.DataType, retries: int = RETRIES, base_seconds: float = 1.0, rows_per_call: int | None = None,
    with_error: bool = False, **retry,
):
    """A column function around ``call``; rows whose call fails for good yield nulls, not a failed job, and no other row does.

    ``rows_per_call`` bounds the rows of a call (else: an Arrow batch). ``with_error``: the column is struct<reply, error>.
    """
    safe = with_retry(call, retries, base_seconds, **retry)

    def run(*columns: pd.Series):
        replies, errors = _by_halves(safe, list(columns), rows_per_call)
        if with_error:
            return pd.DataFrame({"reply": pd.Series(replies, dtype=object), "error": pd.Series(errors, dtype=object)})
        return pd.Series(replies, dtype=object)

    kind = T.StructType([T.StructField("reply", returns), T.StructField("error", T.StringType())]) if with_error else returns

    def typed(n: int):
        # pandas UDFs are told apart by their signature
        shapes = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c), 5: lambda a, b, c, d, e: run(a, b, c, d, e)}
        function = shapes[n]
        function.__annotations__ = {**{name: pd.Series for name in "abcde"[:n]}, "return": pd.DataFrame if with_error else pd.Series}
        # not deterministic, so that a filter on the result is not pushed below the call, which would then be made twice
        return F.pandas_udf(function, kind).asNondeterministic()

    return lambda *columns: typed(len(columns))(*columns)


def hashing_embedder(dim: int = 256) -> Embedder:
    """Offline default: hashed token counts scaled to unit length, computed in the JVM."""

    def embed(df: DataFrame, text: str, out: str) -> DataFrame:
        tokens = df.withColumn("_tokens", tokenize(F.col(text)))
        hashed = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dim).transform(tokens)
        unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(hashed)
        return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_counts", "_unit")

    return embed


def batch_embedder(call: Callable[[pd.Series], pd.Series], **retry) -> Embedder:
    """Embed with a user-supplied function: Series of texts -> Series of float lists."""
    udf = batch_udf(call, T.ArrayType(T.FloatType()), **retry)
    return lambda df, text, out: df.withColumn(out, udf(F.col(text)))


def embed_chunks(chunks: DataFrame, embedder: Embedder | None = None, keep_failed: bool = False) -> DataFrame:
    """chunks + vector. A chunk whose call failed is left out (or kept with a null vector)."""
    ready = chunks.withColumn("_input", F.coalesce(F.nullif("text", F.lit("")), F.lit(EMPTY_CHUNK)))
    embedded = (embedder or hashing_embedder())(ready, "_input", "vector").drop("_input")
    embedded = embedded.withColumn("text", F.coalesce(F.nullif("text", F.lit("")), F.lit(IMAGE_CHUNK)))
    return embedded if keep_failed else embedded.where(F.col("vector").isNotNull())


def count_skipped(embedded: DataFrame) -> DataFrame:
    """One row: chunks embedded and chunks skipped because their call failed."""
    return embedded.agg(
        F.count_if(F.col("vector").isNotNull()).alias("embedded"), F.count_if(F.col("vector").isNull()).alias("skipped")
    )


def embed_questions(questions: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """questions + vector of the rewritten question."""
    return (embedder or hashing_embedder())(questions, "rewritten", "vector")


def extract_keywords(questions: DataFrame, call: Callable[[pd.Series], pd.Series] | None = None, **retry) -> DataFrame:
    """questions + keywords from a model's comma list; none without a model or when it fails."""
    none = F.array().cast("array<string>")
    if call is None:
        return questions.withColumn("keywords", none)
    reply = batch_udf(call, T.StringType(), **retry)(F.col("question"))
    return questions.withColumn("keywords", F.coalesce(parse_keyword_list(reply), none))


def rewrite_queries(questions: DataFrame, call: Callable[[pd.Series], pd.Series] | None = None, **retry) -> DataFrame:
    """questions + rewritten; the question itself without a model or when it fails."""
    if call is None:
        return questions.withColumn("rewritten", F.col("question"))
    reply = batch_udf(call, T.StringType(), **retry)(F.col("question"))
    return questions.withColumn("rewritten", F.coalesce(reply, F.col("question")))


def batch_scorer(call: Callable[[pd.Series, pd.Series], pd.Series], chat: bool = False, excerpt: int | None = None, **retry):
    """Scorer for ``rerank`` around a model of (question, text) pairs.

    ``chat=True``: the model answers in words and the leading number counts, 0 to 10. ``excerpt``: the model is given so many
    characters of a text and not the whole.
    """
    udf = batch_udf(call, T.StringType() if chat else T.DoubleType(), **retry)

    def score(question: Column, text: Column) -> Column:
        reply = udf(question, text if excerpt is None else truncate_text(text, excerpt))
        return parse_score(reply) if chat else reply

    return score


def interpret_pages(pages: DataFrame, call: Callable[..., pd.Series] | None = None, hint_chars: int | None = None, wait_scale: float = 1.0, **retry) -> DataFrame:
    """pages + text: heading and interpretation of each page.

    ``call(image, hint, filename, page_number, n_pages)`` sees the picture (null where there is none) and, as an aid, the page's
    text (``hint_chars``: its beginning); n_pages is the number of pages of the file. Any error is retried three times,
    after 1 s at first or 3 s if it was for the rate (times ``wait_scale``). Without a model the text hint is the
    interpretation; a failed call falls back to a fixed layout around the hint.
    """
    hint = F.coalesce("text_hint", F.lit(""))
    heading = lambda seen: page_heading_text(F.col("filename"), F.col("page_number"), seen, F.col("text_hint"))
    if call is None:
        return pages.withColumn("text", heading(hint))
    rule = {"retries": PAGE_RETRIES, "any_error": True, "waits": _page_wait(wait_scale), "rows_per_call": 1} | retry
    image = F.col("image") if "image" in pages.columns else F.lit(None).cast("string")
    # a row per file, written and counted: as long as it can be sent to the tasks, pictures stay where they are
    counts = materialise(pages.groupBy("filename").agg(F.count("*").cast("int").alias("_n_pages")), "pages-per-file")
    counts = F.broadcast(counts) if counts.count() <= SENT_FILES else counts
    counted = pages.join(counts, "filename", "left")
    shown = hint if hint_chars is None else truncate_text(hint, hint_chars)
    seen = batch_udf(call, T.StringType(), **rule)(image, shown, F.col("filename"), F.col("page_number"), F.col("_n_pages"))
    return counted.withColumn("text", heading(seen)).select(*pages.columns, "text")


def generate_answers(prompts: DataFrame, call: Callable[[pd.Series, pd.Series, pd.Series], pd.Series] | None = None, **retry):
    """prompts(prompt, question, context[, images]) + answer; offline the context itself is the answer.

    ``call(prompt, question, images)`` gets the pictures of the hits as well. A failed call puts an apology with the error's
    text into its own row and leaves the other questions alone.
    """
    if call is None:
        return prompts.withColumn("answer", F.col("context"))
    images = F.col("images") if "images" in prompts.columns else F.array().cast("array<string>")
    made = batch_udf(call, T.StringType(), with_error=True, **retry)(F.col("prompt"), F.col("question"), images)
    error = F.coalesce(F.nullif(F.col("_made.error"), F.lit("")), F.lit(UNKNOWN_ERROR))
    answer = F.coalesce("_made.reply", F.concat(F.lit(APOLOGY), error))
    return prompts.withColumn("_made", made).withColumn("answer", answer).drop("_made")
