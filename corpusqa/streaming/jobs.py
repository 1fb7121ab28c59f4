"""The same work on streams: files as they arrive, questions as they come, answers as they are told."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusqa.models import UNKNOWN_ERROR
from corpusqa.operators.context import ERROR_PREFIX
from corpusqa.plans.ingest import ingest_documents
from corpusqa.session import scratch_scope
from corpusqa.sources.files import text_reader
from corpusqa.sources.knowledge_base import KnowledgeBase


def stream_documents(spark: SparkSession, folder: str, files_per_batch: int | None = None, archive: str | None = None) -> DataFrame:
    """Stream of documents from a folder; with ``archive`` files are moved there once done."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return text_reader(reader, folder)


def stream_ingest(base: KnowledgeBase, documents: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Every file is chunked, embedded and stored once; a batch run again is recognised and skipped."""

    def store(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(base.spark):
            ingest_documents(base, batch, txn=f"{checkpoint}#{batch_id}")

    return (
        documents.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_answers(
    questions: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Answer each micro-batch of questions against static tables.

    A batch has its own folder in ``sink``, so running it again replaces its answers. What ``answer`` writes to the
    scratch folder is removed when the batch is done, or has failed.
    """

    def respond(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            answer(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (
        questions.writeStream.foreachBatch(respond)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


_MESSAGE = "request_id string, content string, sources array<string>, images array<string>"


def stream_fold_events(events: DataFrame, watermark: str = "10 minutes", time: str = "event_time") -> DataFrame:
    """One finished message per request of a stream of answer events, however its events are spread over micro-batches.

    A request is emitted once all its events up to the first ``done`` or ``error`` are there (``seq`` counts from 0), or, if
    some stay away, when ``watermark`` has passed since its last event. Events after the end and events told twice change
    nothing; a request without an end is dropped at that time. State holds what was told so far, for open requests, and
    a mark for finished ones until then. Append mode.
    """
    # one string per event: a group's columns are unpacked one by one, which took most of the time with lists among them
    told = F.to_json(F.struct("seq", "type", "content", "sources", "images", F.unix_millis(time).alias("ms")))
    kept = events.withWatermark(time, watermark).select(F.col("request_id").cast("string").alias("request_id"), told.alias("told"), time)
    return kept.groupBy("request_id").applyInPandasWithState(_fold_request(watermark), _MESSAGE, "closed boolean, told string, last long", "append", "EventTimeTimeout")


def _fold_request(watermark: str):
    patience = int(pd.Timedelta(watermark).total_seconds() * 1000)

    def fold(key, frames, state):
        closed, told, last = state.get if state.exists else (False, "[]", 0)
        lines = [told[1:-1]] if told != "[]" else []
        for frame in frames:
            lines += frame["told"].tolist()
        events, known = json.loads(f"[{','.join(lines)}]"), {}
        for e in events:
            last = max(last, e.get("ms", last))
            known.setdefault(e["seq"], e)
        ends = [s for s, e in known.items() if e.get("type") in ("done", "error")]
        end = min(ends, default=None)
        whole = end is not None and all(s in known for s in range(end))
        if not closed and end is not None and (whole or state.hasTimedOut):
            closed = True
            yield pd.DataFrame([message(key[0], [known[s] for s in sorted(known) if s < end], known[end])])
        if state.hasTimedOut:
            state.remove()
            return
        kept = f"[{','.join(lines)}]" if len(known) == len(events) else json.dumps(list(known.values()))
        state.update((closed, "[]" if closed else kept, last))
        state.setTimeoutTimestamp(max(last + patience, state.getCurrentWatermarkMs() + 1))

    def message(request: str, told: list[dict], end: dict) -> dict:
        # a field that is null is left out
        one = lambda kind: next((e.get(kind) for e in reversed(told) if e.get("type") == kind), None) or []
        text = "".join(e.get("content") or "" for e in told if e.get("type") == "content")
        failure = ERROR_PREFIX + (UNKNOWN_ERROR if end.get("content") is None else end["content"])
        return {"request_id": request, "content": failure if end["type"] == "error" else text, "sources": one("sources"), "images": one("images")}

    return fold
