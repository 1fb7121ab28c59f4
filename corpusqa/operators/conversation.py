"""Conversation history: what is sent along with a question, shown, kept and deleted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusqa.functions.text import strip_images_data, title_from_text, truncate_with_notice
from corpusqa.operators.context import NO_HISTORY
from corpusqa.operators.ranking import top_k

# Speakers of a history
SPEAKERS = ("用户", "助手")
# Fixed values: (conversations, messages per conversation, characters per message), tried in turn
COMPACTION_TIERS = ((20, 40, 12000), (12, 24, 8000), (8, 16, 4000), (4, 12, 2500), (1, 10, 1500))
HISTORY_MESSAGES = 12
HISTORY_CHARS = 24000
STORED_SOURCES = 12


def non_blank_messages(messages: DataFrame) -> DataFrame:
    """Image blocks stripped; messages with nothing left dropped."""
    stripped = messages.withColumn("text", strip_images_data(F.coalesce("text", F.lit(""))))
    return stripped.where(F.col("text") != "")


def history_window(messages: DataFrame, most: int = HISTORY_MESSAGES, chars: int = HISTORY_CHARS) -> DataFrame:
    """The newest messages of each conversation that fit both limits.

    Walking back stops at the first message that would pass the character limit. Lengths are
    positive, so that is where the running sum passes it; only ``most`` rows per conversation reach
    the running sum.
    """
    newest = top_k(non_blank_messages(messages), ["conv_id"], [F.desc("turn")], most, "back")
    so_far = W.partitionBy("conv_id").orderBy("back").rowsBetween(W.unboundedPreceding, 0)
    return newest.withColumn("run", F.sum(F.length("text")).over(so_far)).where(F.col("run") <= chars).drop("run", "back")


def history_line(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "user", SPEAKERS[0]).otherwise(SPEAKERS[1]), F.lit(": "), text)


def format_history(window: DataFrame) -> DataFrame:
    """(conv_id, history) of a history window (at most twelve messages per conversation)."""
    lines = F.sort_array(F.collect_list(F.struct("turn", history_line(F.col("role"), F.col("text")).alias("line"))))
    return window.groupBy("conv_id").agg(
        F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("history")
    )


def with_history(questions: DataFrame, history: DataFrame) -> DataFrame:
    """Join histories to questions(conv_id, …); none is spelled out."""
    return questions.join(history, "conv_id", "left").withColumn("history", F.coalesce("history", F.lit(NO_HISTORY)))


def conversation_title(messages: DataFrame) -> DataFrame:
    """(conv_id, title) from the first user message."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(title_from_text(first).alias("title"))


def list_conversations(messages: DataFrame, recency: str = "turn") -> DataFrame:
    """(conv_id, title, n_messages, updated), newest first by ``recency``."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    listed = messages.groupBy("conv_id").agg(
        title_from_text(first).alias("title"), F.count("*").alias("n_messages"), F.max(recency).alias("updated")
    )
    return listed.orderBy(F.desc("updated"), F.desc("conv_id"))


def compact_conversations(
    messages: DataFrame,
    max_chars: int,
    tiers: Sequence[tuple[int, int, int]] = COMPACTION_TIERS,
    recency: str = "conv_id",
    owner: Sequence[str] = (),
) -> DataFrame:
    """The conversations each owner keeps under a quota: newest conversations, their last messages, cut texts.

    The tiers are tried in turn and the first whose texts fit ``max_chars`` is used; nothing is kept
    when none fits. ``recency`` orders the conversations, newest largest. ``owner`` names the columns that tell owners
    apart (none: all messages are one owner's); each has quota and tier of its own. Only what the widest tier
    could keep is ever brought together.
    """
    owned = [*owner] or ["_owner"]
    messages = messages if owner else messages.withColumn("_owner", F.lit(0))
    widest = [max(t[i] for t in tiers) for i in range(3)]
    stamps = messages.groupBy(*owned, "conv_id").agg(F.max(recency).alias("_stamp")) if recency != "conv_id" else (
        messages.select(*owned, "conv_id").distinct().withColumn("_stamp", F.col("conv_id"))
    )
    ranked = top_k(stamps, owned, [F.desc("_stamp"), F.desc("conv_id")], widest[0], "conv_rank")
    ranked = ranked.withColumn("conv_rank", F.col("conv_rank") + 1).drop("_stamp")
    recent = top_k(messages.join(ranked, [*owned, "conv_id"]), [*owned, "conv_id"], [F.desc("turn")], widest[1], "back")
    text = strip_images_data(F.coalesce("text", F.lit("")))
    options = F.array(
        *[
            F.struct(F.lit(i).alias("tier"), F.lit(c).alias("convs"), F.lit(m).alias("msgs"), truncate_with_notice(text, n).alias("text"))
            for i, (c, m, n) in enumerate(tiers)
        ]
    )
    sources = F.slice("sources", 1, STORED_SOURCES) if "sources" in messages.columns else F.lit(None).cast("array<string>")
    images = F.col("images") if "images" in messages.columns else F.lit(None).cast("array<string>")
    tried = (
        recent.select(
            *owned, "conv_id", "turn", "role", "conv_rank", "back", sources.alias("sources"), images.alias("images"), F.explode(options).alias("o")
        )
        .select(*owned, "conv_id", "turn", "role", "sources", "images", "conv_rank", "back", "o.*")
        .where((F.col("conv_rank") <= F.col("convs")) & (F.col("back") < F.col("msgs")))
    )
    fitting = tried.groupBy(*owned, "tier").agg(F.sum(F.length("text")).alias("size")).where(F.col("size") <= max_chars)
    chosen = fitting.groupBy(*owned).agg(F.min("tier").alias("tier"))
    return tried.join(chosen, [*owned, "tier"]).select(*owner, "conv_id", "turn", "role", "text", "sources", "images", "tier")


def delete_messages(messages: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Drop single messages (conv_id, turn) or whole conversations (conv_id)."""
    keys = ["conv_id", "turn"] if "turn" in unwanted.columns else ["conv_id"]
    return messages.join(unwanted.select(*keys).distinct(), keys, "left_anti")
