import pytest
from pyspark.sql import functions as F

from corpusqa.models import batch_embedder, hashing_embedder
from corpusqa.operators.bm25 import bm25_search
from corpusqa.plans.hybrid import chunk_lookup
from corpusqa.plans.ingest import ingest_documents, ingest_pages
from corpusqa.session import HELD_BYTES, hold
from corpusqa.sources import knowledge_base as K

DOC = "filename string, source string, text string"


def docs(spark, *names, text="Some text about {}, long enough to keep."):
    return spark.createDataFrame([(n, "s", text.format(n)) for n in names], DOC)


@pytest.fixture
def base(spark, tmp_path):
    return K.KnowledgeBase(spark, str(tmp_path / "base"), hashing_embedder(8))


def listing(base):
    return {r.filename: r.chunks for r in K.list_documents(base.scan()).collect()}


def test_append_keeps_replace_replaces(spark, base):
    assert listing(base) == {}
    assert ingest_documents(base, docs(spark, "a.md", "b.md")) == 2
    assert ingest_documents(base, docs(spark, "a.md")) == 1
    assert listing(base) == {"a.md": 2, "b.md": 1}
    assert ingest_documents(base, docs(spark, "a.md", text="New text for {} only."), replace=True) == 1
    assert listing(base) == {"a.md": 1, "b.md": 1}
    assert base.scan().where("filename = 'a.md'").first().text == "New text for a.md only."


def test_delete_and_clear(spark, base):
    ingest_documents(base, docs(spark, "a.md", "b.md", "c.md"))
    gone = base.delete(spark.createDataFrame([("a.md",), ("nosuch.md",)], "filename string"))
    assert {r.filename: r.deleted for r in gone.collect()} == {"a.md": 1, "nosuch.md": 0}
    assert listing(base) == {"b.md": 1, "c.md": 1}
    ingest_documents(base, docs(spark, "a.md"))  # comes back after its deletion
    assert listing(base) == {"a.md": 1, "b.md": 1, "c.md": 1}
    assert base.clear() == 3
    assert listing(base) == {}
    ingest_documents(base, docs(spark, "d.md"))
    assert listing(base) == {"d.md": 1}


def test_repeated_transaction_is_ignored(spark, base):
    assert ingest_documents(base, docs(spark, "a.md"), txn="t1") == 1
    assert ingest_documents(base, docs(spark, "a.md"), txn="t1") == 0
    assert listing(base) == {"a.md": 1}


def test_interrupted_commit_is_invisible(spark, base):
    ingest_documents(base, docs(spark, "a.md"))
    base._write(*base._next(), docs(spark, "half.md").withColumn("chunk_index", F.lit(0)))
    assert listing(base) == {"a.md": 1}
    ingest_documents(base, docs(spark, "b.md"))
    assert listing(base) == {"a.md": 1, "b.md": 1}


def test_new_dimension_embeds_everything_again(spark, base, tmp_path):
    ingest_documents(base, docs(spark, "a.md", "b.md"))
    wider = K.KnowledgeBase(spark, base.path, hashing_embedder(16))
    assert ingest_documents(wider, docs(spark, "c.md")) == 1
    assert [r[0] for r in wider.rows().select(F.size("vector")).distinct().collect()] == [16]
    assert listing(wider) == {"a.md": 1, "b.md": 1, "c.md": 1}
    keys = wider.rows().select("commit_id", "row_id").collect()
    assert len(set(keys)) == len(keys)
    assert wider.reembed() == 3 and listing(wider) == {"a.md": 1, "b.md": 1, "c.md": 1}


def test_failed_embeddings_are_skipped(spark, tmp_path):
    def picky(texts):
        return texts.map(lambda t: None if "b.md" in t else [1.0, 2.0])

    base = K.KnowledgeBase(spark, str(tmp_path / "kb"), batch_embedder(picky))
    assert ingest_documents(base, docs(spark, "a.md", "b.md")) == 1
    assert listing(base) == {"a.md": 1}
    with pytest.raises(RuntimeError):
        ingest_documents(base, docs(spark, "b.md"))
    assert listing(base) == {"a.md": 1}


def test_rate_limits_are_retried(spark, tmp_path):
    flag = tmp_path / "seen"

    def limited(texts):
        if not flag.exists():
            flag.write_text("x")
            raise RuntimeError("HTTP 429 Too Many Requests")
        return texts.map(lambda t: [1.0])

    base = K.KnowledgeBase(spark, str(tmp_path / "kb"), batch_embedder(limited, base_seconds=0.01))
    assert base.append(docs(spark, "a.md").withColumn("chunk_index", F.lit(0)).coalesce(1)) == 1


def test_index_over_stored_rows_counts_copies(spark, base):
    ingest_documents(base, docs(spark, "a.md"))
    ingest_documents(base, docs(spark, "a.md"))
    asked = spark.createDataFrame([(0, "text about a")], "question_id bigint, question string")
    assert bm25_search(asked, base.build_index()).count() == 2


def test_pages_with_pictures(spark, base):
    pages = spark.createDataFrame(
        [("f.pdf", "s", 1, "A page with words on it.", "data:image/png;base64,AA==")],
        "filename string, source string, page_number int, text_hint string, image string",
    )
    assert ingest_pages(base, pages) == 3
    kinds = {(r.type, r.image) for r in base.scan().collect()}
    assert kinds == {("text", ""), ("page", "data:image/png;base64,AA==")}


def test_scan_fills_defaults(spark):
    old = spark.createDataFrame([("a", None, "video"), (None, "x", "page"), ("init", "x", "page"), ("b", "t", "image")], "filename string, text string, type string")
    got = {tuple(r) for r in K.scan_chunks(old).collect()}
    assert got == {("a", 0, "", "text", "", ""), ("b", 0, "", "image", "t", "")}


def test_paging(spark):
    rows = spark.range(45).select(F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("filename"))
    third = K.page_results(rows, ["filename"], 20, page=3).orderBy("filename").collect()
    assert [r.filename for r in third] == [f"f{i:03d}" for i in range(40, 45)]
    assert {(r.page_no, r.total_pages) for r in third} == {(3, 3)}
    assert K.filename_filter(rows, "F01").count() == 10


def test_one_page_of_rows_with_equal_and_null_keys(spark, monkeypatch):
    """Every page by itself is what the whole table has under its number; wide columns of other pages are not written."""
    rows = [(None if i % 9 == 0 else f"f{i % 7}", i % 3, f"wide{i}") for i in range(60)]
    frame = spark.createDataFrame(rows, "filename string, chunk_index int, text string").repartition(5)
    sizes = lambda found: sorted((r.filename or "", r.chunk_index, r.page_no, r.total_pages) for r in found)
    whole = K.page_results(frame, ["filename", "chunk_index"], 8).collect()
    written = []
    from corpusqa.operators import ranking

    monkeypatch.setattr(ranking, "materialise", lambda df, name: written.append((df.columns, df.count())) or K.materialise(df, name))
    for page in range(1, 9):
        got = K.page_results(frame, ["filename", "chunk_index"], 8, page).collect()
        assert sizes(got) == sizes([r for r in whole if r.page_no == page])
    assert len({r.text for p in range(1, 9) for r in K.page_results(frame, ["filename", "chunk_index", "text"], 8, p).collect()}) == 60
    written.clear()
    K.page_results(frame, ["text"], 8, 2).collect()
    assert max(n for columns, n in written if "filename" in columns) == 8
    assert K.page_results(frame, ["filename"], 8, 99).count() == 0 and K.page_results(frame.limit(0), ["filename"], 8, 1).count() == 0


def test_from_files_to_answers(spark, tmp_path, base):
    """The example of the README."""
    from corpusqa.operators.fusion import lexical_coverage
    from corpusqa.operators.lexical_index import load_index
    from corpusqa.plans.hybrid import answer_questions, hybrid_search
    from corpusqa.sources.files import read_documents

    uploads = tmp_path / "uploads"
    uploads.mkdir()
    (uploads / "tokens.md").write_text("# Tokens\n\nA token is refreshed every hour by the server.\n\n## Keys\n\nKeys are kept for a year.")
    (uploads / "other.txt").write_text("Nothing here is about the matter, only filler text.")
    assert ingest_documents(base, read_documents(spark, str(uploads))) == 3
    assert ingest_documents(base, read_documents(spark, str(uploads))) == 3  # stored twice, as told
    base.build_index(str(tmp_path / "index"))
    index = load_index(spark, str(tmp_path / "index"), K.ROW_KEY)
    asked = spark.createDataFrame([(1, "How often is a token refreshed?"), (2, "zzz")], "question_id bigint, question string")
    hits = hybrid_search(asked, index, base.rows(), base.scan(), lexical_coverage, base.embedder)
    answers = {r.question_id: r for r in answer_questions(asked, hits).collect()}
    assert answers[1].sources[0] == "tokens.md" and answers[1].answer.startswith("[文档1: tokens.md]\n[Tokens]\nA token is")
    assert "[文档2: tokens.md]" not in answers[1].answer or answers[1].answer.count("A token is refreshed") == 1
    assert answers[2].sources == [] and answers[2].answer == "暂无相关文档"


def test_the_row_that_was_hit_is_returned(spark, tmp_path):
    """A file stored twice with other texts: a question finds the row that answers it, not the greatest of equal keys."""
    from corpusqa.plans.hybrid import hybrid_search

    base = K.KnowledgeBase(spark, str(tmp_path / "twice"), hashing_embedder(32))
    text = lambda t: spark.createDataFrame([("a.md", 0, t), ("b.md", 0, "filler of another file " + t[:3])], "filename string, chunk_index int, text string")
    base.append(text("apples are harvested in autumn"))
    base.append(text("zebras graze on the plain"))
    index = base.build_index()
    asked = spark.createDataFrame([(1, "harvested apples"), (2, "zebras graze")], "question_id bigint, question string")
    hits = hybrid_search(asked, index, base.rows(), base.scan(), embedder=base.embedder)
    first = {r.question_id: r for r in hits.where("filename = 'a.md'").collect()}
    # both texts have the same file and number, so a question has one hit of them: the row of the last lexical hit
    assert first[1].text == "apples are harvested in autumn" and first[1].commit_id == 0
    assert first[2].text == "zebras graze on the plain" and first[2].commit_id == 1
    assert hits.groupBy("question_id", "filename", "chunk_index").count().where("count > 1").isEmpty()


def test_two_writers_of_one_number(spark, tmp_path):
    """One of them enters the log; the other fails and has destroyed nothing."""
    base, other = (K.KnowledgeBase(spark, str(tmp_path / "two"), hashing_embedder(8)) for _ in range(2))
    base.append(docs(spark, "first.md").withColumn("chunk_index", F.lit(0)))
    taken = other._next()
    base.append(docs(spark, "mine.md").withColumn("chunk_index", F.lit(0)))
    other._write(*taken, docs(spark, "theirs.md").withColumn("chunk_index", F.lit(0)).withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    with pytest.raises(RuntimeError, match="another writer"):
        other._publish(taken[0], "write", writer=taken[1])
    assert {r.filename for r in base.scan().collect()} == {"first.md", "mine.md"}


def test_purge(spark, tmp_path):
    base = K.KnowledgeBase(spark, str(tmp_path / "purged"), hashing_embedder(8))
    base.append(docs(spark, "a.md").withColumn("chunk_index", F.lit(0)), txn="t1")
    base.append(docs(spark, "b.md").withColumn("chunk_index", F.lit(0)))
    base.delete(spark.createDataFrame([("a.md",)], "filename string"))
    before = base.scan().drop("commit_id", "row_id").collect()
    assert base.purge() == len(before) == 1
    assert base.scan().drop("commit_id", "row_id").collect() == before and base.dimension() == 8
    assert len(list((tmp_path / "purged" / "chunks").glob("commit_id=*"))) == len(list((tmp_path / "purged" / "log").glob("commit_id=*"))) == 1
    assert base.append(docs(spark, "a.md").withColumn("chunk_index", F.lit(0)), txn="t1") == 0
    assert base.append(docs(spark, "c.md").withColumn("chunk_index", F.lit(0))) == 1
    assert {r.filename for r in base.scan().collect()} == {"b.md", "c.md"}


class Counting:
    """An embedder that keeps the texts it was asked for in files of its own."""

    def __init__(self, folder, dim):
        self.folder, self.dim = str(folder), dim
        folder.mkdir()

    def __call__(self, df, text, out):
        folder, dim = self.folder, self.dim

        def call(texts):
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write("\n".join(texts) + "\n")
            return texts.map(lambda t: [float(len(t))] * dim)

        return batch_embedder(call)(df, text, out)

    def asked(self):
        import os

        return sorted(line for name in os.listdir(self.folder) for line in open(f"{self.folder}/{name}").read().splitlines())


def test_content_is_embedded_once(spark, tmp_path):
    """Over two appends, copies, a deletion and a purge; again after a change of the model; not if vectors were given."""
    counter, other = Counting(tmp_path / "calls", 2), Counting(tmp_path / "others", 2)
    base = K.KnowledgeBase(spark, str(tmp_path / "base"), counter, "first")
    chunk = "filename string, chunk_index int, text string"
    rows = [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "one"), ("c", 0, None), ("c", 1, "")]
    assert base.append(spark.createDataFrame(rows, chunk), reuse=True) == 5
    assert counter.asked() == ["[空块]", "one", "two"]
    base.delete(spark.createDataFrame([("a",)], "filename string"))
    assert base.append(spark.createDataFrame([("d", 0, "two"), ("d", 1, "three"), ("e", 0, "")], chunk), reuse=True) == 3
    assert counter.asked() == ["[空块]", "one", "three", "two"]
    base.purge()
    assert base.append(spark.createDataFrame([("f", 0, "three"), ("f", 1, "one")], chunk), reuse=True) == 2
    assert counter.asked() == ["[空块]", "one", "three", "two"]
    assert {(r.text, r.vector[0]) for r in base.rows().collect()} == {("one", 3.0), ("two", 3.0), ("three", 5.0), ("[图片块]", 4.0)}

    changed = K.KnowledgeBase(spark, str(tmp_path / "base"), other, "second")
    assert changed.append(spark.createDataFrame([("g", 0, "one"), ("g", 1, "one")], chunk), reuse=True) == 2
    assert other.asked() == ["one"] and counter.asked() == ["[空块]", "one", "three", "two"]
    changed.append(spark.createDataFrame([("h", 0, "given", [1.0, 2.0])], chunk + ", vector array<float>"))
    changed.append(spark.createDataFrame([("i", 0, "given")], chunk), reuse=True)
    assert other.asked() == ["given", "one"]


def test_new_content_only(spark):
    chunks = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("",), ("c",)], "text string")
    known = chunks.where("text = 'b'").select(K.content_hash(F.col("text")).alias("content"))
    found = K.new_content_only(chunks, known)
    assert sorted((r.text or "") for r in found.collect()) == ["", "a", "c"]
    assert K.new_content_only(chunks, known.limit(0)).count() == 4 and K.new_content_only(chunks.limit(0), known).count() == 0


def test_lookup_of_few_hits_reads_their_commits_only(spark, base):
    for part in range(3):
        ingest_documents(base, docs(spark, *[f"{part}-{i}.md" for i in range(4)]))
    key = list(K.ROW_KEY)
    stored = [tuple(r) for r in base.rows().where("commit_id = 1").select(*key).collect()]
    schema = "filename string, chunk_index int, commit_id bigint, row_id bigint"
    asked = [*stored[:2], stored[0], (None, 0, 1, 0), ("nosuch.md", 0, 1, 0)]
    for rows in (asked, asked[3:], []):
        hits = spark.createDataFrame(rows, schema)
        found = chunk_lookup(hits, base.scan(), key, few=True)
        same = chunk_lookup(hits, base.scan(), key)
        assert sorted(found.collect()) == sorted(same.collect())
    found = chunk_lookup(spark.createDataFrame(asked, schema), base.scan(), key, few=True)
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "image" in line)
    folders, pushed = scan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "commit_id" in folders and "(commit_id" in folders.replace("cast(", "(")
    assert "filename" in pushed and "row_id" in pushed


def test_held_results_are_those_of_written_ones(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y"]), (2, None, []), (None, "", None)], "id bigint, name string, words array<string>")
    small, large = hold(rows, "rows", 100), hold(rows, "rows", HELD_BYTES + 1)
    assert small.schema == large.schema == rows.schema
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)
    assert hold(rows.where("id > 5"), "none", 0).collect() == []
