"""From ranked chunks to context, sources, images and prompt, per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
BLOCK_JOIN = "\n\n---\n\n"
NO_CONTEXT = "暂无相关文档"
NO_HISTORY = "无"
EMPTY_CORPUS = "当前知识库为空，请先上传文档后再提问。"
ERROR_PREFIX = "抱歉，出现错误: "
UNKNOWN_ERROR = "未知错误"
PICTURE_HEAD = ("[页面图", ": ", "]\n页面多模态解读: ")
DOCUMENT_HEAD = ("[文档", ": ", "]\n")
# -----------------------------------------------------------------------------

PROMPT_TEMPLATE = (
    "请只根据下面的文档内容作答；文档里没有的内容请直说没有，数值和名称保持原样。\n\n"
    "文档：\n{context}\n\n对话：\n{history}\n"
)


def _ordered(rank: str, value: Column) -> Column:
    """Values of a group in rank order; groups here are the final hits of one question (six rows)."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank), value.alias("v")))), lambda s: s["v"])


def context_blocks(hits: DataFrame, rank: str = "final_rank") -> DataFrame:
    """Add ``block`` and, for page and image chunks that carry one, the running ``image_no``."""
    pictured = F.col("type").isin("image", "page") & (F.coalesce("image", F.lit("")) != "")
    so_far = W.partitionBy("question_id").orderBy(rank).rowsBetween(W.unboundedPreceding, 0)
    numbered = hits.withColumn("_pictured", pictured).withColumn(
        "image_no", F.sum(F.col("_pictured").cast("int")).over(so_far)
    )
    picture = F.concat(
        F.lit(PICTURE_HEAD[0]), F.col("image_no").cast("string"), F.lit(PICTURE_HEAD[1]), "filename", F.lit(PICTURE_HEAD[2]), "text"
    )
    place = (F.col(rank) + 1).cast("string")
    plain = F.concat(F.lit(DOCUMENT_HEAD[0]), place, F.lit(DOCUMENT_HEAD[1]), "filename", F.lit(DOCUMENT_HEAD[2]), "text")
    return (
        numbered.withColumn("block", F.when(F.col("_pictured"), picture).otherwise(plain))
        .withColumn("image_no", F.when(F.col("_pictured"), F.col("image_no")))
        .drop("_pictured")
    )


def build_context(hits: DataFrame, questions: DataFrame | None = None, rank: str = "final_rank") -> DataFrame:
    """(question_id, context); with ``questions`` given, those without hits get a fixed notice."""
    built = (
        context_blocks(hits, rank)
        .groupBy("question_id")
        .agg(F.array_join(_ordered(rank, F.col("block")), BLOCK_JOIN).alias("context"))
    )
    if questions is None:
        return built
    return (
        questions.select("question_id")
        .join(built, "question_id", "left")
        .withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))
    )


def answer_sources(hits: DataFrame, rank: str = "final_rank") -> DataFrame:
    """(question_id, sources): distinct file names in order of first appearance."""
    return hits.groupBy("question_id").agg(F.array_distinct(_ordered(rank, F.col("filename"))).alias("sources"))


def collect_images(hits: DataFrame, rank: str = "final_rank") -> DataFrame:
    """(question_id, images): pictures of the hits in rank order."""
    pictured = hits.where(F.col("type").isin("image", "page") & (F.coalesce("image", F.lit("")) != ""))
    return pictured.groupBy("question_id").agg(_ordered(rank, F.col("image")).alias("images"))


def build_prompt(context: Column, history: Column, template: str = PROMPT_TEMPLATE) -> Column:
    """Fill ``{context}`` and ``{history}`` of a template."""
    head, rest = template.split("{context}")
    middle, tail = rest.split("{history}")
    return F.concat(F.lit(head), context, F.lit(middle), F.coalesce(history, F.lit(NO_HISTORY)), F.lit(tail))


def empty_corpus_reply(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """A fixed reply, without sources, for every question when the corpus holds no chunk."""
    return questions.select("question_id").where(~corpus.exists()).withColumn("answer", F.lit(EMPTY_CORPUS))


def answer_events(answers: DataFrame) -> DataFrame:
    """answers(question_id, answer, sources, images) -> the event list a client would receive."""
    no_list = F.array().cast("array<string>")

    def event(kind: str, content=None, sources=None, images=None) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            (F.lit(None).cast("string") if content is None else content).alias("content"),
            (no_list if sources is None else sources).alias("sources"),
            (no_list if images is None else images).alias("images"),
        )

    sources, images = F.coalesce("sources", no_list), F.coalesce("images", no_list)
    events = F.filter(
        F.array(
            F.when(F.size(sources) > 0, event("sources", sources=sources)),
            F.when(F.size(images) > 0, event("images", images=images)),
            event("content", content=F.col("answer")),
            event("done"),
        ),
        lambda e: e.isNotNull(),
    )
    return answers.select(F.col("question_id").alias("request_id"), F.posexplode(events).alias("seq", "e")).select(
        "request_id", "seq", "e.*"
    )


def _told(kind: str, value: Column) -> Column:
    """Events of one kind in order, as (seq, v)."""
    return F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.struct("seq", value.alias("v")))))


def fold_events(grouped, *keys: str) -> DataFrame:
    """Fold grouped answer events, batch or streaming, into one message per group; see below."""
    end = F.when(F.col("type").isin("done", "error"), F.col("seq"))
    parts = grouped.agg(
        F.min(end).alias("end_seq"),
        F.min_by("type", end).alias("end_type"),
        F.min_by("content", end).alias("end_content"),
        _told("content", F.coalesce("content", F.lit(""))).alias("contents"),
        _told("sources", F.col("sources")).alias("sources"),
        _told("images", F.col("images")).alias("images"),
    )

    def before_end(values: str) -> Column:
        kept = F.filter(values, lambda s: F.col("end_seq").isNull() | (s["seq"] < F.col("end_seq")))
        return F.transform(kept, lambda s: s["v"])

    def last(values: str) -> Column:
        return F.coalesce(F.try_element_at(before_end(values), F.lit(-1)), F.array().cast("array<string>"))

    failure = F.concat(F.lit(ERROR_PREFIX), F.coalesce("end_content", F.lit(UNKNOWN_ERROR)))
    return parts.select(
        *keys,
        F.when(F.col("end_type") == "error", failure).otherwise(F.array_join(before_end("contents"), "")).alias("content"),
        last("sources").alias("sources"),
        last("images").alias("images"),
        "end_type",
    )


def fold_answer_events(events: DataFrame) -> DataFrame:
    """events(request_id, seq, type, content, sources, images) -> one message per request.

    Contents are joined up to the first ``done`` or ``error``; an error replaces the content; the last
    sources and images told before the end stay. A group is one answer.
    """
    folded = fold_events(events.groupBy("request_id"), "request_id")
    return folded.withColumn("done", F.coalesce(F.col("end_type") == "done", F.lit(False))).drop("end_type")
