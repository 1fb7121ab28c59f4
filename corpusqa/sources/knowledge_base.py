"""The chunk table at rest: append, delete, replace, clear, re-embed, list, page.

Plain Parquet under one folder::

    chunks/commit_id=N/writer=W/…    rows written by commit N, never changed afterwards
    log/commit_id=N/…                written last: makes commit N visible, and names what it removes

A reader sees the rows of logged commits after the last ``clear``, minus the files deleted by a later
commit. Every commit writes to a folder of its own, named in the log, so a commit interrupted half-way is invisible. Of
two writers that take the same number one enters the log; the other fails and has changed nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.models import EMPTY_CHUNK, IMAGE_CHUNK, Embedder, embed_chunks
from corpusqa.operators.lexical_index import LexicalIndex, build_index
from corpusqa.operators.ranking import number_rows
from corpusqa.operators.vectors import check_dimension
from corpusqa.schema import CHUNK_TYPES, VECTORS, conform, struct_of
from corpusqa.session import materialise

# Fixed values
PLACEHOLDER_FILE = "init"
PAGE_SIZES = (10, 20, 50, 100)

_LOG = "kind string, filename string, txn string, dimension int, writer string"
_STORED = VECTORS + ", content string, model string, row_id bigint, writer string"
ROW_KEY = ("filename", "chunk_index", "commit_id", "row_id")


def scan_chunks(rows: DataFrame) -> DataFrame:
    """Stored rows with defaults filled in; placeholder and nameless rows dropped.

    Columns the table lacks get their default, so older files stay readable; the vector is only read
    when it is asked for.
    """
    have = rows.columns
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in have else F.lit("").alias(c)
    kind = F.col("type") if "type" in have else F.lit(None).cast("string")
    index = F.col("chunk_index") if "chunk_index" in have else F.lit(None).cast("int")
    known = {"text", "image", "source", "filename", "chunk_index", "type"}
    return valid_rows(rows).select(
        "filename",
        F.coalesce(index, F.lit(0)).cast("int").alias("chunk_index"),
        text("source"),
        F.when(kind.isin(*CHUNK_TYPES[1:]), kind).otherwise(CHUNK_TYPES[0]).alias("type"),
        text("text"),
        text("image"),
        *[c for c in have if c not in known],
    )


def valid_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("filename").isNotNull() & (F.col("filename") != "") & (F.col("filename") != PLACEHOLDER_FILE))


def count_rows(rows: DataFrame, predicate=None) -> DataFrame:
    """One row: how many rows satisfy a predicate (default: those with a file name)."""
    return rows.agg(F.count_if(F.col("filename").isNotNull() if predicate is None else predicate).alias("n_rows"))


def list_documents(chunks: DataFrame) -> DataFrame:
    """(filename, chunks) per file."""
    return chunks.groupBy("filename").agg(F.count("*").alias("chunks"))


def list_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select("filename", "chunk_index", "text", F.size("vector").alias("vector_dimension"))


def filename_filter(rows: DataFrame, part: str) -> DataFrame:
    """Case-insensitive substring of the file name."""
    return rows.where(F.contains(F.lower("filename"), F.lower(F.lit(part))))


def page_results(rows: DataFrame, order, page_size: int = PAGE_SIZES[0], page: int | None = None) -> DataFrame:
    """rows + page_no (from 1) + total_pages; one page of them when ``page`` is given.

    For one page only the columns of the order are sorted and written; the rows between its first and its last key are then read.
    """
    order = list(order)
    numbered = number_rows(rows if page is None else rows.select(*order), order, (), "_at")
    total = numbered.agg(F.ceil(F.count("*") / page_size).cast("int")).scalar()
    if page is not None:
        inside = (F.col("_at") >= (page - 1) * page_size) & (F.col("_at") < page * page_size)
        key = F.struct(*order)
        ends = numbered.where(inside).agg(F.min(key).alias("low"), F.max(key).alias("high"))
        low, high = ends.select("low").scalar(), ends.select("high").scalar()
        before = numbered.where(key.eqNullSafe(low)).agg(F.min("_at")).scalar()
        near = number_rows(rows.where((key >= low) & (key <= high)), order, (), "_at")
        numbered = near.withColumn("_at", F.col("_at") + before).where(inside)
    number = (F.floor(F.col("_at") / page_size) + 1).cast("int")
    return numbered.withColumn("page_no", number).drop("_at").withColumn("total_pages", total)


def delete_document(chunks: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, (filename, deleted) per name); an unknown name deletes 0 rows."""
    wanted = names.select("filename").distinct()
    kept = chunks.join(wanted, "filename", "left_anti")
    counts = chunks.join(wanted, "filename", "left_semi").groupBy("filename").agg(F.count("*").alias("n"))
    deleted = wanted.join(counts, "filename", "left").select("filename", F.coalesce("n", F.lit(0)).alias("deleted"))
    return kept, deleted


def content_hash(text: Column) -> Column:
    """SHA-256 of what an embedding model is given for a text; null and empty texts are given the same stand-in."""
    return F.sha2(F.coalesce(F.nullif(text, F.lit("")), F.lit(EMPTY_CHUNK)).cast("binary"), 256)


def _content(rows: DataFrame) -> Column:
    return content_hash(F.col("text")) if "text" in rows.columns else F.lit(None).cast("string")


def new_content_only(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``chunks`` whose content is not in ``known(content)``, one row per different content: content and text.

    Copies are put together before anything is shuffled; of ``known`` only the hashes are read, and only those that
    the chunks have are compared (a semi-join, for which Spark may send a Bloom filter of the chunks' hashes to the scan).
    """
    asked = chunks.select(content_hash(F.col("text")).alias("content"), "text").groupBy("content").agg(F.first("text").alias("text"))
    have = known.select("content").join(asked.select("content"), "content", "left_semi")
    return asked.join(have, "content", "left_anti")


class KnowledgeBase:
    """``model`` names the embedding model: vectors of the same content by a model of that name can be used again."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, model: str = ""):
        self.spark, self.path, self.embedder, self.model = spark, path.rstrip("/"), embedder, model

    def _read(self, name: str, ddl: str) -> DataFrame:
        schema = struct_of(ddl + ", commit_id bigint")
        folder = f"{self.path}/{name}"
        try:
            return self.spark.read.schema(schema).option("basePath", folder).parquet(folder)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        return self._read("log", _LOG)

    def rows(self) -> DataFrame:
        """All visible rows with vector, commit_id and row_id (together with the key: unique)."""
        return self._visible().drop("content", "model")

    def _visible(self) -> DataFrame:
        log = self.log()
        cleared = F.coalesce(F.max(F.when(F.col("kind") == "clear", F.col("commit_id"))), F.lit(-1))
        since = log.agg(cleared).scalar()
        live = log.where((F.col("kind") == "write") & (F.col("commit_id") >= since)).select("commit_id", "writer").distinct()
        removed = log.where(F.col("kind") == "delete").groupBy("filename").agg(F.max("commit_id").alias("gone_at"))
        stored = self._read("chunks", _STORED).join(live, ["commit_id", "writer"], "left_semi")
        visible = stored.drop("writer").alias("s")
        gone = removed.alias("r")
        return visible.join(
            gone, (F.col("s.filename") == F.col("r.filename")) & (F.col("s.commit_id") < F.col("r.gone_at")), "left_anti"
        )

    def scan(self) -> DataFrame:
        return scan_chunks(self.rows())

    def _done(self, txn: str | None) -> bool:
        return txn is not None and not self.log().where(F.col("txn") == txn).isEmpty()

    def _next(self) -> tuple[int, str]:
        """A number after all logged and all claimed ones, and a name for this writer's folder."""
        last = self.log().agg(F.max("commit_id")).first()[0]
        commit = 0 if last is None else last + 1
        while self._claim(commit)[0].exists(self._claim(commit)[1]):
            commit += 1
        return commit, uuid.uuid4().hex

    def _claim(self, commit: int):
        """The file system and path of the file that claims a number."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/{commit}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _write(self, commit: int, writer: str, rows: DataFrame, extra: bool = False) -> DataFrame:
        """Write rows of a commit (``extra``: more of them) and return all its rows so far."""
        place = F.monotonically_increasing_id()
        given = rows if "content" in rows.columns else rows.withColumn("content", _content(rows))
        given = given if "model" in rows.columns else given.withColumn("model", F.lit(self.model))
        stored = conform(given, VECTORS + ", content string, model string").withColumn("row_id", -1 - place if extra else place)
        stored.write.mode("append" if extra else "error").parquet(f"{self.path}/chunks/commit_id={commit}/writer={writer}")
        return self._read("chunks", _STORED).where((F.col("commit_id") == commit) & (F.col("writer") == writer)).drop("writer", "content", "model")

    def _embedded_once(self, chunks: DataFrame) -> DataFrame:
        """chunks + vector, content: the model is called once for each different text it has not embedded before, whatever has become of the rows."""
        chunks = materialise(chunks, "chunks")
        contents = chunks.select("content").distinct()
        known = self._read("chunks", _STORED).where((F.col("model") == self.model) & F.col("vector").isNotNull()).select("content", "vector")
        held = materialise(known.join(contents, "content", "left_semi").groupBy("content").agg(F.first("vector").alias("vector")), "known")
        made = embed_chunks(new_content_only(chunks, held), self.embedder).select("content", "vector")
        # one row for each different content
        vectors = materialise(held.unionByName(made.withColumn("vector", F.col("vector").cast(held.schema["vector"].dataType))), "vectors")
        return chunks.join(vectors, "content").withColumn("text", F.coalesce(F.nullif("text", F.lit("")), F.lit(IMAGE_CHUNK)))

    def _publish(self, commit: int, *kinds: str, removals: DataFrame | None = None, txn=None, dimension=None, writer=None, known: DataFrame | None = None) -> None:
        entries = self.spark.createDataFrame([(kind, None, txn, dimension, writer) for kind in kinds], struct_of(_LOG)).coalesce(1)
        if removals is not None:
            # as many tasks as there is work: a commit may remove any number of files
            gone = removals.select(F.lit("delete").alias("kind"), "filename").distinct()
            entries = entries.unionByName(gone, allowMissingColumns=True)
        if known is not None:
            entries = entries.unionByName(known.select(F.lit("note").alias("kind"), "txn"), allowMissingColumns=True)
        self._enter(commit)
        entries.write.mode("append").parquet(f"{self.path}/log/commit_id={commit}")

    def _enter(self, commit: int) -> None:
        """Claim the number: an empty file that only one writer can create."""
        files, place = self._claim(commit)
        try:
            files.create(place, False).close()
        except Exception as error:
            if not files.exists(place):
                raise
            raise RuntimeError(f"another writer has taken commit {commit}; run this one again") from error

    def append(self, chunks: DataFrame, replace: bool = False, txn: str | None = None, reuse: bool = False) -> int:
        """Embed (unless a ``vector`` column is given) and add chunks; returns how many were added.

        Chunks whose embedding failed are skipped; if all fail, nothing is added and an error raised.
        Rows of a file that is there already stay, unless ``replace``. When the new vectors have
        another dimension, the stored chunks are embedded again in the same commit. A repeated
        ``txn`` is ignored. With ``reuse`` only content that the model of this name has not embedded before is given to it, once
        for each different text.
        """
        if self._done(txn):
            return 0
        commit, writer = self._next()
        chunks = chunks.withColumn("content", _content(chunks))
        if "vector" in chunks.columns:  # made by no model that is known here
            embedded = chunks.withColumn("model", F.lit(None).cast("string"))
        else:
            embedded = self._embedded_once(chunks) if reuse else embed_chunks(chunks, self.embedder)
        written = self._write(commit, writer, embedded)
        dimension, added = check_dimension(written)
        if not added:
            if chunks.isEmpty():
                return 0
            raise RuntimeError("embedding failed for all chunks")
        removals = written.select("filename") if replace else None
        if self.dimension() in (None, dimension):
            self._publish(commit, "write", removals=removals, txn=txn, dimension=dimension, writer=writer)
            return added
        kept = self._texts() if removals is None else self._texts().join(removals, "filename", "left_anti")
        check_dimension(self._write(commit, writer, embed_chunks(kept, self.embedder), extra=True), dimension)
        self._publish(commit, "write", "clear", txn=txn, dimension=dimension, writer=writer)
        return added

    def dimension(self) -> int | None:
        """Dimension of the stored vectors, as noted by the last commit that wrote any (None: no rows)."""
        log = self.log().where(F.col("kind").isin("write", "clear"))
        last = log.orderBy(F.desc("commit_id"), F.desc("kind")).select("kind", "dimension").first()
        return None if last is None or last["kind"] == "clear" else last["dimension"]

    def _texts(self) -> DataFrame:
        return self.scan().drop("vector", "commit_id", "row_id")

    def delete(self, names: DataFrame) -> DataFrame:
        """Remove files by name; returns (filename, deleted)."""
        _, deleted = delete_document(self.rows().select("filename"), names)
        deleted = materialise(deleted, "deleted")
        self._publish(self._next()[0], "note", removals=deleted.where(F.col("deleted") > 0))
        return deleted

    def clear(self) -> int:
        """Remove everything; returns how many rows that were."""
        n = self.rows().count()
        self._publish(self._next()[0], "clear")
        return n

    def reembed(self) -> int:
        """Embed every stored chunk again and put the result in place of all rows, in one commit."""
        commit, writer = self._next()
        dimension, n = check_dimension(self._write(commit, writer, embed_chunks(self._texts(), self.embedder)))
        self._publish(commit, "write", "clear", dimension=dimension, writer=writer)
        return n

    def purge(self) -> int:
        """Write all visible rows anew, as one commit, and remove the folders of all earlier ones; returns the number of rows.

        What was deleted or replaced is gone from the disk afterwards, and the log is one entry long again, besides
        the names of transactions, which are kept. Up to the new commit an interruption leaves everything as it was; after
        it, what is left to remove is removed by the next call. No other reader or writer may be at work.
        """
        commit, writer = self._next()
        known = self.log().where(F.col("txn").isNotNull()).select("txn").distinct()
        known = materialise(known, "transactions")
        dimension, n = check_dimension(self._write(commit, writer, self._visible().drop("commit_id", "row_id")))
        self._publish(commit, "write", "clear", dimension=dimension, writer=writer, known=known)
        for name in ("log", "chunks"):
            top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for entry in files.listStatus(top):
                folder = entry.getPath()
                number = folder.getName().removeprefix("commit_id=")
                if number.isdigit() and int(number) < commit:
                    files.delete(folder, True)
        return n

    def build_index(self, path: str | None = None, strip_images: bool = True) -> LexicalIndex:
        """Lexical index over the rows as they are now; every stored row counts on its own. Substring search in texts
        with image blocks needs ``strip_images=False``."""
        return build_index(self.scan(), path, ROW_KEY, strip_images)
