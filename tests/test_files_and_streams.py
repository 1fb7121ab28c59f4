import base64
import glob

import pytest
from pyspark.sql import functions as F

from corpusqa.models import hashing_embedder
from corpusqa.operators.context import fold_answer_events
from corpusqa.plans.ingest import chunk_documents
from corpusqa.sources import files, pages
from corpusqa.sources.knowledge_base import KnowledgeBase, list_documents
from corpusqa.streaming import jobs

NOTE = "Paragraph one of this file.\n\nParagraph two of this file.\n"


def folder(tmp_path):
    root = tmp_path / "up"
    (root / "sub").mkdir(parents=True)
    (root / "a b.TXT").write_text(NOTE)
    (root / "sub" / "说明+1.md").write_text("# Title\n\nSome words below the title.")
    (root / "t.csv").write_bytes(b"k,v\r\n1,\"a, b\"\r\n")
    (root / "empty.csv").write_text(" \n")
    (root / "tool.exe").write_text("no")
    (root / "p.PNG").write_bytes(b"\x89PNG" + b"0" * 100)
    return root


def test_read_documents(spark, tmp_path):
    got = {r.filename: r.text for r in files.read_documents(spark, str(folder(tmp_path))).collect()}
    assert got == {
        "a b.TXT": NOTE,
        "说明+1.md": "# Title\n\nSome words below the title.",
        "t.csv": '\n--- 表格: Sheet1 ---\nk,v\n1,"a, b"\n\n',
        "empty.csv": "空表格",
    }
    assert files.read_csv_as_text(spark, str(tmp_path / "up")).count() == 2


def test_read_documents_as_the_stream_does(spark, tmp_path):
    """The same files and names as by Spark's reader, which a stream and places that only Hadoop knows still use; no task for each 32 small files."""
    root = tmp_path / "u p+%é"
    names = "a b.TXT|sub/说明+1.md|sub/x%20y.txt|d=1/_k=2/z.csv|d=1/_hid/z.csv|.h/z.csv|.z.txt|_z.txt|_z=1.txt|_metadata.txt|c.txt._COPYING_|e/f/g/h'(1)[2]{3}.md|q?*.txt"
    for name in [*names.split("|"), "n\u00a0b.txt", 'q"<>^`.txt', "😀.txt", "a#b;c.txt", "new\nline.txt", "no.exe", "empty.txt", "bad.TxT"]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == "empty.txt" else b"\xff\xfe x\r\n" if name == "bad.TxT" else name.encode())
    for limit in (None, 6):
        old, new = files.text_reader(spark.read, str(root), limit), files.read_documents(spark, str(root), limit)
        assert new.schema == old.schema and sorted(map(repr, new.collect())) == sorted(map(repr, old.collect()))
    assert new.count() == 13 and files.read_documents(spark, str(root / "a b.TXT")).count() == 1
    place = str(tmp_path / "many")
    files.write_texts(spark.range(3000).select(F.col("id").cast("string").alias("value")).coalesce(1), place)
    read = files.read_documents(spark, place)
    assert read.rdd.getNumPartitions() < 10 and read.count() == 3000
    assert int(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 2**40  # not sent to all tasks by a join


def test_read_images(spark, tmp_path):
    row = files.read_images(spark, str(folder(tmp_path))).first()
    assert (row.filename, row.page_number) == ("p.PNG", 1)
    assert row.image == "data:image/png;base64," + base64.b64encode(b"\x89PNG" + b"0" * 100).decode()
    assert spark.range(1).select(files.flag_oversize_images(F.lit(row.image), 10).alias("o")).first().o


def test_accept_files(spark):
    limit = 50 * 1024 * 1024
    rows = [("x.PDF", limit), ("x.pdf", limit + 1), ("x.exe", 1), ("noext", 1)]
    got = files.accept_files(spark.createDataFrame(rows, "path string, length bigint")).collect()
    assert [r.rejected_reason is None for r in got] == [True, False, False, False]


def test_paginate(spark):
    text = "x" * 100 + "\n\n" + "\n".join(str(i) for i in range(50))
    docs = spark.createDataFrame([("f", text), ("g", "  \n")], "filename string, text string")
    got = {(r.filename, r.page_number): r.text_hint for r in pages.paginate_text(docs).collect()}
    first = got["f", 1].split("\n")
    assert first[:5] == ["x" * 42, "x" * 42, "x" * 16, "", "0"] and len(first) == 42
    assert got["f", 2].split("\n")[0] == "38" and got["g", 1] == "空文档" and len(got) == 3


def test_table_documents_are_cut_under_their_header(spark):
    rows = [("hot", i, f'v"{i}') for i in range(25)] + [("cold", 0, "a,b")]
    got = pages.table_to_documents(spark.createDataFrame(rows, "g string, o int, v string"), "g", ["o"], ["o", "v"], 10)
    by = {(r.filename, r.part): r for r in got.collect()}
    assert {k: r.n_rows for k, r in by.items()} == {("hot", 0): 10, ("hot", 1): 10, ("hot", 2): 5, ("cold", 0): 1}
    assert by["cold", 0].text == '\n--- 表格: cold ---\no,v\n0,"a,b"\n'
    assert by["hot", 2].text.split("\n")[2:4] == ["o,v", '20,"v""20"']


def test_stream_ingest_equals_batch(spark, tmp_path):
    root = folder(tmp_path)
    base = KnowledgeBase(spark, str(tmp_path / "kb"), hashing_embedder(8))
    stream = lambda: jobs.stream_documents(spark, str(root), files_per_batch=1)
    jobs.stream_ingest(base, stream(), str(tmp_path / "cp")).awaitTermination()
    batch = chunk_documents(files.read_documents(spark, str(root)))
    key = lambda df: sorted((r.filename, r.chunk_index, r.text) for r in df.collect())
    assert key(base.scan()) == key(batch)
    (root / "late.txt").write_text("A file that arrives later on.")
    jobs.stream_ingest(base, stream(), str(tmp_path / "cp")).awaitTermination()
    assert key(base.scan()) == key(chunk_documents(files.read_documents(spark, str(root))))
    assert list_documents(base.scan()).count() == 4  # the blank table has nothing worth a chunk


def test_stream_answers(spark, tmp_path):
    asked = tmp_path / "asked"
    spark.createDataFrame([(1, "one"), (2, "two")], "question_id bigint, question string").coalesce(1).write.json(str(asked))
    questions = spark.readStream.schema("question_id bigint, question string").json(str(asked))
    sink = str(tmp_path / "answers")
    jobs.stream_answers(questions, lambda b: b.withColumn("answer", F.upper("question")), sink, str(tmp_path / "cp")).awaitTermination()
    assert {(r.question_id, r.answer) for r in spark.read.parquet(sink).collect()} == {(1, "ONE"), (2, "TWO")}


EVENTS = [
    ("r1", 0, "sources", None, ["a"], []),
    ("r1", 1, "content", "Hel", [], []),
    ("r1", 2, "images", None, [], ["i"]),
    ("r1", 3, "content", "lo", [], []),
    ("r1", 4, "done", None, [], []),
    ("r1", 5, "content", " late", [], []),
    ("r2", 0, "sources", None, ["a"], []),
    ("r2", 1, "sources", None, ["b"], []),
    ("r2", 2, "content", "x", [], []),
    ("r2", 3, "error", "boom", [], []),
    ("r3", 0, "content", "open", [], []),
]
EVENT = "request_id string, seq int, type string, content string, sources array<string>, images array<string>"


def test_fold_events(spark):
    got = {r.request_id: (r.content, r.sources, r.images, r.done) for r in fold_answer_events(spark.createDataFrame(EVENTS, EVENT)).collect()}
    assert got == {
        "r1": ("Hello", ["a"], ["i"], True),
        "r2": ("抱歉，出现错误: boom", ["b"], [], False),
        "r3": ("open", [], [], False),
    }


def test_stream_fold_events(spark, tmp_path):
    source = tmp_path / "events"
    rows = spark.createDataFrame(EVENTS, EVENT).withColumn("event_time", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    # told in two batches: request r1 is cut in the middle
    rows.where("seq < 3").coalesce(1).write.parquet(f"{source}/b1")
    rows.where("seq >= 3").coalesce(1).write.parquet(f"{source}/b2")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    query = (
        jobs.stream_fold_events(stream).writeStream.outputMode("append").format("memory").queryName("folded")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.request_id, r.content, tuple(r.sources), tuple(r.images)) for r in spark.table("folded").collect()}
    assert got == {("r1", "Hello", ("a",), ("i",)), ("r2", "抱歉，出现错误: boom", ("b",), ())}


def test_batches_leave_no_scratch_tables(spark, tmp_path):
    """Five micro-batches, each with scratch tables of its own; a batch that fails leaves none either; run again, one copy of its rows stays."""
    from corpusqa.session import materialise, scratch_path

    shared = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    for n in range(5):
        spark.createDataFrame([(n, f"question {n}")], "question_id bigint, question string").coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))
    stream = lambda: spark.readStream.schema("question_id bigint, question string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "asked"))
    sink, before = str(tmp_path / "sink"), set(glob.glob(f"{shared}/streamed-*"))
    answer = lambda batch: materialise(batch, "streamed").withColumn("answer", F.upper("question"))
    for checkpoint in ("cp", "again"):
        jobs.stream_answers(stream(), answer, sink, str(tmp_path / checkpoint)).awaitTermination()
        assert set(glob.glob(f"{shared}/streamed-*")) == before
        assert sorted(r.answer for r in spark.read.parquet(sink).collect()) == [f"QUESTION {n}" for n in range(5)]

    def broken(batch):
        materialise(batch, "streamed")
        raise RuntimeError("no answer")

    with pytest.raises(Exception, match="no answer"):
        jobs.stream_answers(stream(), broken, str(tmp_path / "other"), str(tmp_path / "third")).awaitTermination()
    assert set(glob.glob(f"{shared}/streamed-*")) == before


def test_large_files_are_reported_not_dropped(spark, tmp_path):
    for name, text in (("a.txt", "short"), ("b.md", "longer than that"), ("c.csv", "x,y\n1,2\n3,4")):
        (tmp_path / name).write_text(text)
    everything = {r.filename: r.text for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(everything) == {"a.txt", "b.md", "c.csv"} and all(everything.values())
    limited = {r.filename: (r.text, r.rejected_reason) for r in files.read_documents(spark, str(tmp_path), max_bytes=8).collect()}
    assert limited == {"a.txt": ("short", None), "b.md": (None, "File too large"), "c.csv": (None, "File too large")}


def test_the_events_of_the_query_are_written_by_more_than_one_task(spark):
    import glob

    from catalog.queries import QUERIES

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{shared}/*/events-*"))
    QUERIES["stream_fold_events"](spark, "/root/testdata/sf0.001")
    (told,) = set(glob.glob(f"{shared}/*/events-*")) - before
    assert len(glob.glob(f"{told}/*.parquet")) > 3


def test_every_text_in_a_file_of_its_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FOLDER_FILES", 3)
    texts = [None, "", "a\r\nb", "知识 \u0000 é", "twice", "twice", *[str(n) for n in range(20)]]
    rows = spark.createDataFrame([(t,) for t in texts], "value string").repartition(2)
    for place in (str(tmp_path / "plain"), (tmp_path / "uri").as_uri()):
        files.write_texts(rows, place)
        read = files.read_documents(spark, place).collect()
        assert sorted(r["text"] for r in read) == sorted(f"{t or ''}\n" for t in texts)
        assert {r["filename"][-4:] for r in read} == {".txt"} and len({r["source"] for r in read}) == len(texts)
    assert len(list((tmp_path / "uri").iterdir())) > 2 and not list(tmp_path.rglob("*.crc"))
    files.write_texts(rows.where("false"), str(tmp_path / "none"))
    assert files.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_folded_events_travel_as_one_string(spark, tmp_path):
    """Lists among the columns of a group made the fold slow; null fields and events told twice change nothing."""
    rows = [("r", 0, "content", None, None, [None, "x"]), ("r", 1, "sources", None, ["a", None], None), ("r", 1, "sources", "b", ["late"], None), ("r", 2, "error", None, None, None)]
    told = spark.createDataFrame(rows, EVENT).withColumn("event_time", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    told.coalesce(1).write.parquet(str(tmp_path / "told"))
    folded = jobs.stream_fold_events(spark.readStream.schema(told.schema).parquet(str(tmp_path / "told")))
    query = folded.writeStream.outputMode("append").format("memory").queryName("one_string").option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination()
    ((content, sources, images),) = {(r.content, tuple(r.sources), tuple(r.images)) for r in spark.table("one_string").collect()}
    assert (content, sources, images) == ("抱歉，出现错误: 未知错误", ("a", None), ())
    given = folded._jdf.queryExecution().analyzed().children().apply(0).output().mkString(",")
    assert "told" in given and "sources" not in given
