"""Readers for uploaded files."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.functions.text import file_extension, utrim

# Fixed values ---------------------------------------------------------------
ACCEPTED = (".pdf", ".txt", ".md", ".docx", ".png", ".jpg", ".jpeg", ".webp", ".xlsx", ".csv")
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_IMAGE_BYTES = 4 * 1024 * 1024
TEXT_FILES = (".txt", ".md")
TABLE_FILES = (".csv",)
IMAGE_FILES = (".png", ".jpg", ".jpeg", ".webp")
EMPTY_TABLE = "空表格"
TABLE_HEAD = "\n--- 表格: Sheet1 ---\n"
WRONG_TYPE = "不支持的文件类型: "
TOO_LARGE = "File too large"
FOLDER_FILES = 1000  # files put in a folder: many folders are listed by several tasks
LISTED_FOLDERS = 256  # folders known at which tasks go on with them, each with its own
MOST_TASKS = 10_000  # that read a folder
BATCH_BYTES = 4 * 1024 * 1024  # of contents that a task hands on at a time
# -----------------------------------------------------------------------------


def accept_files(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """files + rejected_reason (null: accepted): ten extensions, at most 50 MiB."""
    extension = file_extension(F.col(path))
    return files.withColumn(
        "rejected_reason",
        F.when(~extension.isin(*ACCEPTED), F.concat(F.lit(WRONG_TYPE), extension)).when(
            F.col(length) > MAX_FILE_BYTES, F.lit(TOO_LARGE)
        ),
    )


def _glob(extensions) -> str:
    spelled = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return "*{" + ",".join(spelled) + "}"


def file_to_text(name: Column, value: Column) -> Column:
    """Searchable text of a text or CSV file's contents."""
    value = F.make_valid_utf8(value)
    table = F.when(utrim(value) == "", F.lit(EMPTY_TABLE)).otherwise(
        F.concat(F.lit(TABLE_HEAD), F.regexp_replace(value, r"\r\n?", "\n"), F.lit("\n"))
    )
    return F.when(file_extension(name).isin(*TABLE_FILES), table).otherwise(value)


def _refused(size: Column, max_bytes: int | None) -> list[Column]:
    """The column ``rejected_reason``, only where a limit was asked for."""
    return [] if max_bytes is None else [F.when(size > max_bytes, F.lit(TOO_LARGE)).alias("rejected_reason")]


def _unless_refused(size: Column, max_bytes: int | None, value: Column) -> Column:
    return value if max_bytes is None else F.when(size <= max_bytes, value)


def text_reader(reader, path: str, max_bytes: int | None = None) -> DataFrame:
    """documents(filename, source, text) of the text and CSV files below ``path``: every file is a row.

    ``reader`` is ``spark.read`` or ``spark.readStream``. Files are read as bytes: the reader of whole texts makes its settings and codecs anew
    for each file, which takes longer than small files themselves. With ``max_bytes`` larger files come back without their
    text and with a ``rejected_reason`` (null for the others).
    """
    raw = (
        reader.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _glob(TEXT_FILES + TABLE_FILES))
        .load(path)
    )
    name = F.col("_metadata.file_name")
    size = F.col("_metadata.file_size")
    return raw.select(
        F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("filename"),
        F.col("_metadata.file_path").alias("source"),
        _unless_refused(size, max_bytes, file_to_text(name, F.col("content").cast("string"))).alias("text"),
        *_refused(size, max_bytes),
    )


def write_texts(texts: DataFrame, path: str) -> None:
    """Every row's ``value``, ended by a line break, as a text file of its own below ``path``; a null is an empty line.

    Tasks write the files themselves: Hadoop's local file system starts a process for the permissions of each file it makes. Names come from the
    order of the rows in their partition, so that a task run again writes the same files. A place only Hadoop knows is left to Spark's writer.
    """
    texts = texts.select("value").sortWithinPartitions("value")
    try:
        fs.FileSystem.from_uri(path)
    except (OSError, ValueError):  # pa.ArrowInvalid is a ValueError
        texts.write.option("maxRecordsPerFile", 1).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(path)
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for value in batch.column(0):
                folder = f"{top}/{part:05d}-{n // FOLDER_FILES:05d}"
                if n % FOLDER_FILES == 0:
                    system.create_dir(folder)
                with system.open_output_stream(f"{folder}/{n % FOLDER_FILES:05d}.txt") as file:
                    file.write(f"{value.as_py()}\n".encode() if value.is_valid else b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    fs.FileSystem.from_uri(path)[0].create_dir(fs.FileSystem.from_uri(path)[1])
    texts.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def read_documents(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """``text_reader`` of a folder as it is now. In a local or mounted one the tasks list folders and read the files themselves: of small files
    Spark's reader takes 32 to a task, and opening them takes most of its time."""
    top = _local_folder(spark, path)
    if top is None:
        return text_reader(spark.read, path, max_bytes)
    # of a size unknown to Spark, as the files are: a join does not take it for a small table
    places = [[p] for p in _places(top)]
    listed = spark.createDataFrame(spark.sparkContext.parallelize(places, max(1, min(len(places), MOST_TASKS))), "paths array<string>")
    raw = listed.mapInArrow(_contents(max_bytes), "filename string, source string not null, size bigint, content binary")
    text = _unless_refused(F.col("size"), max_bytes, file_to_text(F.col("filename"), F.col("content").cast("string")))
    return raw.select("filename", "source", text.alias("text"), *_refused(F.col("size"), max_bytes))


_TEXT_NAME = re.compile(r"(?is).*(" + "|".join(map(re.escape, TEXT_FILES + TABLE_FILES)) + r")\Z")


def _seen(name: str, is_dir: bool) -> bool:
    """Whether Spark's readers see a file or folder of that name."""
    if is_dir and name.startswith(("_common_metadata", "_metadata")):
        return True
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder as Python opens it; null for a file, a pattern, or a place that only Hadoop knows."""
    if re.search(r"[*?\[\]{}\\]", path):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toUri()
    return place.getPath() if place.getScheme() == "file" and os.path.isdir(place.getPath()) else None


def _scan(folder: str) -> tuple[list[str], list[str]]:
    """The folders and text files in ``folder``."""
    with os.scandir(folder) as found:
        seen = [(e.is_dir(), e.path) for e in found if _seen(e.name, e.is_dir())]
    return [p for is_dir, p in seen if is_dir], [p for is_dir, p in seen if not is_dir and _TEXT_NAME.match(p)]


def _places(top: str) -> list[list[str]]:
    """Folders and files below ``top``, dealt out: a folder with all below it, or ``FOLDER_FILES`` files."""
    folders, files = [top], []
    while folders and len(folders) < LISTED_FOLDERS:
        found = [_scan(folder) for folder in folders]
        folders = [p for inner, _ in found for p in inner]
        files += [p for _, own in found for p in own]
    return [[p] for p in folders] + [files[at : at + FOLDER_FILES] for at in range(0, len(files), FOLDER_FILES)]


def _walk(paths: list[str]) -> Iterator[str]:
    todo = list(paths)
    while todo:
        path = todo.pop()
        if os.path.isdir(path):
            inner, own = _scan(path)
            todo += inner
            yield from own
        else:
            yield path


def _url(path: str) -> str:
    """As Hadoop spells a path in a URL."""
    legal = lambda c: c.isascii() and (c.isalnum() or c in "-_.!~*'():@&=+$,;/") or not c.isascii() and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc")
    return "file:" + "".join(c if legal(c) else "".join(f"%{b:02X}" for b in c.encode()) for c in path)


def _contents(max_bytes: int | None):
    """For mapInArrow: (filename, source, size, content) of all files at or below ``paths``; files over ``max_bytes`` are not opened."""
    schema = pa.schema([("filename", pa.string()), ("source", pa.string()), ("size", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for paths in batch.column(0):
                for path in _walk(paths.as_py()):
                    size, content = os.stat(path).st_size, None
                    if not size:  # Spark's readers pass over empty files
                        continue
                    if max_bytes is None or size <= max_bytes:
                        with open(path, "rb", buffering=0) as file:
                            content = file.readall()
                        held += len(content)
                    rows.append((os.path.basename(path), _url(path), size, content))
                    if held >= BATCH_BYTES or len(rows) >= FOLDER_FILES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read


def read_csv_as_text(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Only the CSV files, each as one text under a heading line; an empty file says so."""
    return read_documents(spark, path, max_bytes).where(file_extension(F.col("filename")).isin(*TABLE_FILES))


def image_data_url(name: Column, content: Column) -> Column:
    """``data:`` URL of an image file's bytes."""
    extension = file_extension(name)
    mime = (
        F.when(extension == ".png", "image/png").when(extension == ".webp", "image/webp").otherwise("image/jpeg")
    )
    # base64() breaks its lines after 76 characters
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def flag_oversize_images(data_url: Column, max_bytes: int = MAX_IMAGE_BYTES) -> Column:
    """True when the picture behind a data URL is estimated at more than ``max_bytes``."""
    payload = F.when(F.contains(data_url, F.lit(",")), F.split_part(data_url, F.lit(","), F.lit(2))).otherwise(data_url)
    return F.ceil(F.length(payload) * 3 / 4) > max_bytes


def read_images(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """pages(filename, source, page_number, text_hint, image) of image files: one page each.

    With ``max_bytes`` larger files come back without their picture and with a ``rejected_reason``.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _glob(IMAGE_FILES))
        .load(path)
    )
    size = F.col("length")
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    return raw.select(
        name.alias("filename"),
        F.col("path").alias("source"),
        F.lit(1).alias("page_number"),
        F.lit(None).cast("string").alias("text_hint"),
        _unless_refused(size, max_bytes, image_data_url(name, F.col("content"))).alias("image"),
        *_refused(size, max_bytes),
    )
