import random
import string
import time
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from corpusqa import session
from corpusqa.operators import chunking as C
from corpusqa.plans.ingest import chunk_pages
from corpusqa.sources.pages import paginate_text

GUIDE = (
    "# Guide\n\nIntro paragraph one.\n\nShort.\n\n| name | qty |\n|---|---|\n| bolt | 4 |\n\n- first item\n- second item\n\n"
    "1.1 Setup\n\nInstall it. Then run.\n\n# Appendix B1\n\nTail text is here."
)


def chunks(spark, text):
    docs = spark.createDataFrame([("f", "s", text)], "filename string, source string, text string")
    return C.semantic_chunk(docs).orderBy("chunk_index").collect()


def test_classify_and_heading(spark):
    cases = [
        ("# Guide", "heading", "Guide"),
        ("## A\nbody text", "heading", "A"),
        ("第一章 概述", "heading", "第一章 概述"),
        ("服务节点配置完成。", "heading", "服务节点配置完成。"),
        ("1. foo", "list", None),
        ("1.1 foo", "heading", "1.1 foo"),
        ("1.foo", "heading", "1.foo"),
        ("- x", "list", None),
        ("-x", "other", None),
        ("---", "other", None),
        ("short", "other", None),
        ("| a | b |", "table", None),
        ("【关键数据】\n无", "paragraph", "关键数据"),
        ("x" * 51, "paragraph", None),
        ("####### x", "other", None),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = rows.select("t", C.classify_segment(F.col("t")), C.parse_heading(F.col("t")), "i").orderBy("i").collect()
    assert [tuple(r)[:3] for r in got] == cases


def test_composite(spark):
    got = chunks(spark, GUIDE)
    assert [(r.seg_type, r.headings) for r in got] == [
        ("paragraph", ["Guide"]),
        ("table", ["Guide"]),
        ("list", ["Guide"]),
        ("paragraph", ["Guide", "1.1 Setup"]),
        ("heading", ["Guide", "1.1 Setup"]),
        ("paragraph", ["Guide", "1.1 Setup", "Appendix B1"]),
    ]
    assert got[0].text == "[Guide]\nIntro paragraph one.\n\nShort."
    assert got[5].text == "[Guide › 1.1 Setup › Appendix B1]\nTail text is here."
    assert [r.chunk_index for r in got] == list(range(6))


def test_sentences(spark):
    got = chunks(spark, "A" * 399 + ". " + "B" * 399 + ". " + "C" * 10 + ".")
    assert [len(r.text) for r in got] == [800, 11]


def test_table(spark):
    text = "| k | v |\n" + "\n".join(f"| {i:03d} | " + "x" * 90 + " |" for i in range(20))
    got = chunks(spark, text)
    assert [len(r.text) for r in got] == [918, 918, 211]
    assert [r.text.split("\n")[1][2:5] for r in got] == ["000", "009", "018"]
    assert all(r.text.startswith("| k | v |\n") for r in got)


def test_second_split(spark):
    # one block without blank lines: cut at line breaks, each piece keeps its break until trimmed
    got = chunks(spark, "# T\n" + ("y" * 300 + "\n") * 12)
    assert [len(r.content) for r in got] == [1809, 1805]
    assert all(r.headings == [] for r in got)
    # no separator at all: stays whole
    assert [len(r.content) for r in chunks(spark, "z" * 4500)] == [4500]


def test_split_recursively_overlaps():
    text = "\n".join(f"{i:03d}" + "w" * 60 for i in range(80))
    pieces = C.split_recursively(text)
    assert all(len(p) <= 2000 for p in pieces)
    assert pieces[1].split("\n")[0] in pieces[0].split("\n")  # up to 150 characters come again
    assert "".join(dict.fromkeys("\n".join(pieces).split("\n"))) == text.replace("\n", "")
    assert C.split_recursively("short, |，text") == ["short, |，text"]
    cut = C.split_recursively("x" * 4500, ())
    assert [len(p) for p in cut] == [2000, 2000, 800]


def _plain_packing(text):
    """Sentence packing spelled out for texts that are one paragraph."""
    import re

    out, cur = [], ""
    for s in re.split(r"(?<=[。！？.!?])\s*", text.strip()):
        if not s.strip():
            continue
        if len(cur + s) <= 800:
            cur += s
        else:
            if cur.strip():
                out.append(cur.strip())
            cur = s
    return out + ([cur.strip()] if cur.strip() else [])


def test_sentence_packing_on_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    frame = spark.createDataFrame(docs).select("doc_id", C.split_sentences(F.trim("text")).alias("p"))
    for row, doc in zip(frame.orderBy("doc_id").collect(), sorted(docs, key=lambda d: d.doc_id)):
        assert row.p == _plain_packing(doc.text)


def test_pages_are_stored_twice(spark):
    pages = spark.createDataFrame(
        [("f.pdf", "s", 2, "Second page has text.", None), ("f.pdf", "s", 1, "First page has text.", "data:x")],
        "filename string, source string, page_number int, text_hint string, image string",
    )
    got = chunk_pages(pages).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.type) for r in got] == [(0, "text"), (1, "text"), (2, "text"), (3, "text"), (4, "page"), (5, "page")]
    assert got[4].text.startswith("# f.pdf - 第 1 页") and got[4].image == "data:x"
    # the chain keeps growing from page to page
    assert got[3].text == (
        "[f.pdf - 第 1 页多模态解读 › f.pdf - 第 2 页多模态解读]\nSecond page has text."
    )


def test_properties_on_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("filename"), "source", "text")
    got = C.semantic_chunk(docs)
    # only a single sentence may be longer
    long = got.where(F.length("content") > 800).select("content").collect()
    assert all(len([s for s in __import__("re").split(r"(?<=[。！？.!?])\s*", r.content) if s.strip()]) == 1 for r in long)
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    joined = got.groupBy("filename").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda s: bare(s["content"])), "").alias("all")
    )
    whole = docs.select("filename", bare(F.col("text")).alias("bare"))
    # nothing is lost but pieces of ten characters or fewer
    lost = whole.join(joined, "filename").where(F.length("bare") - F.length("all") > 10)
    assert lost.count() == 0


def test_packing_takes_time_in_proportion_to_its_output():
    import time

    from corpusqa.operators.chunking import _packed

    def seconds_per_name(n):
        segments = [{"content": f"# Heading number {i}", "seg_type": "heading", "heading": f"Heading number {i}"} for i in range(n)]
        start = time.perf_counter()
        out = _packed(segments, 800, True)
        return (time.perf_counter() - start) / sum(len(c["headings"]) for c in out), time.perf_counter() - start

    (small, _), (large, whole) = seconds_per_name(1000), seconds_per_name(4000)
    assert whole < 2 and large < 4 * small


def test_heading_chains_of_a_long_document(spark):
    import time

    n = 4000
    text = "\n\n".join(f"# Heading {i}\n\nText {i} below it." for i in range(n))
    docs = spark.createDataFrame([("long", text, 1), ("none", "No heading here.", 2), ("empty", "", 3), ("null", None, 4)], "filename string, text string, chain int")
    docs = docs.withColumnRenamed("chain", "extra")
    start = time.perf_counter()
    rows = C.heading_chain(docs).select("filename", "extra", "para_pos", "seg_type", F.length("chain").alias("n"), F.right("chain", F.lit(14)).alias("last")).collect()
    assert time.perf_counter() - start < 15
    lengths = [0]
    for i in range(n):
        lengths.append(lengths[-1] + len(f"Heading {i}") + (3 if i else 0))
    got = {r.para_pos: r for r in rows if r.filename == "long"}
    assert [got[2 * i].n for i in range(n)] == lengths[:-1] and [got[2 * i + 1].n for i in range(n)] == lengths[1:]
    assert got[2 * n - 1].last == f"› Heading {n - 1}"
    assert [(r.filename, r.extra, r.n) for r in rows if r.filename != "long"] == [("none", 2, 0)]
    assert "headings" not in C.segments(docs).columns and "Pandas" not in C.segments(docs)._jdf.queryExecution().toString()


def test_cutting_takes_time_in_proportion_to_the_text(spark):
    import time

    def seconds(cut, text):
        start = time.perf_counter()
        pieces = cut(text)
        return time.perf_counter() - start, pieces

    for cut, line, head in ((C.cut_sentences, "A sentence of eight words stands here alone. ", ""), (C.cut_table, "\n| cell | another cell |", "| a | b |")):
        (small, _), (large, pieces) = (seconds(cut, head + line * n) for n in (20_000, 160_000))
        assert large < 3 and large < 40 * max(small, 0.01)
        assert all(len(p) <= 1100 for p in pieces)
    frame = spark.createDataFrame([(None,), ("",), ("a.b",), ("| a |",)], "t string")
    assert [r.s for r in frame.select(C.split_sentences(F.col("t")).alias("s")).collect()] == [[None], [""], ["a.b"], ["| a |"]]
    assert [r.s for r in frame.select(C.split_table(F.col("t")).alias("s")).collect()] == [[None], [""], ["a.b"], ["| a |"]]


def test_walk_unpacks_a_few_documents_at_a_time():
    """A batch used to be unpacked whole, so the memory of a Python worker followed its texts."""
    rows = [[{"content": "x" * 300, "seg_type": "paragraph", "heading": None}] * (i % 4) if i % 5 else None for i in range(50)]
    segments = pa.array(rows, pa.list_(pa.struct([("content", pa.string()), ("seg_type", pa.string()), ("heading", pa.string())])))
    cut = list(C._portions(segments.slice(1), 4000))
    assert len(cut) > 5 and [start for start, _ in cut] == [sum(n for _, n in cut[:i]) for i in range(len(cut))]
    assert sum(n for _, n in cut) == 49 and max(n for _, n in cut) < 30


def test_disk_of_chunk_pages(spark):
    """Pages and chunks are written once, without what their texts hold already, and shuffles are removed when a table is written."""
    r = random.Random(6)
    texts = [(f"f{i}", "s", " ".join("".join(r.choices(string.ascii_lowercase, k=r.randint(2, 9))) for _ in range(1500))) for i in range(100)]
    pages = paginate_text(spark.createDataFrame(texts, "filename string, source string, text string"))
    root = Path(session.checkpoint_root(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in root.rglob("*.parquet"))
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in map(str, spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles())) if "shuffle_" in f}
    before, kept = size(), shuffles()
    assert chunk_pages(pages).where("type = 'page'").count() == pages.count()
    assert size() - before < 2 * sum(len(t) for _, _, t in texts)
    kept = shuffles()
    session.materialise(pages.repartition("filename"), "pages")
    until = time.perf_counter() + 20
    while shuffles() - kept and time.perf_counter() < until:
        time.sleep(0.1)
    assert not shuffles() - kept
    assert spark.conf.get(session._CLEAN_UP) == "false"


def test_numbers_of_pages(spark):
    pages = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", None, "z"), ("b", 7, "u"), (None, 1, "v")], "filename string, page_number int, text string")
    chunks = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "filename string")
    assert sorted((r.filename, r.chunk_index, r.text) for r in C.number_chunks(chunks, pages).collect()) == [("a", 2, "z"), ("a", 3, "y"), ("a", 4, "x"), ("b", 0, "u")]
