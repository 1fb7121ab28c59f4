"""Literal fixtures for the column helpers."""

import pytest
from pyspark.sql import functions as F

from corpusqa.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


NONE = lambda: F.array().cast("array<string>")


def test_normalise(spark):
    raw = 'Hello, WORLD 知识库助手! [IMAGES_DATA]["x"][/IMAGES_DATA] v2_1 é'
    assert value(spark, T.normalize_search_text(F.lit(raw))) == "hello world 知识库助手 v2 1 é"
    assert value(spark, T.normalize_search_text(F.lit("a [images_data]b[/images_data]"), False)) == "a images data b images data"


def test_trim_knows_wide_space(spark):
    assert value(spark, T.utrim(F.lit("　 x﻿\n"))) == "x"


@pytest.mark.parametrize(
    "raw, tokens",
    [
        ("知识库助手", ["知识库助手", "知识", "识库", "库助", "助手", "知识库", "识库助", "库助手"]),
        ("你好", ["你好", "你好"]),
        (" !! ", []),
        ("v2 文", ["v2", "文"]),
        ("a知识", ["a知识"]),
    ],
)
def test_tokenize(spark, raw, tokens):
    assert value(spark, T.tokenize(F.lit(raw))) == tokens


def test_search_terms(spark):
    q = F.lit("refresh token?")
    assert value(spark, T.build_search_terms(q, q, NONE())) == ["refresh token", "refresh", "token"]
    q = F.lit("知识库助手怎么用")
    assert value(spark, T.build_search_terms(q, q, F.array(F.lit("助手")))) == (
        "助手 知识库助手怎么用 知识 识库 库助 手怎 怎么 么用 知识库 识库助 库助手 助手怎 手怎么 怎么用".split()
    )


@pytest.mark.parametrize(
    "reply, score", [("8分", 8.0), ("7.5/10", 7.5), ("-3", 0.0), ("n/a", 5.0), ("42", 10.0), (" 5.", 5.0), (".5e1", 5.0), ("Infinity", 10.0)]
)
def test_parse_score(spark, reply, score):
    assert value(spark, T.parse_score(F.lit(reply))) == score


def test_code_fence(spark):
    assert value(spark, T.strip_code_fence(F.lit("```markdown\nx\n```"))) == "x"
    assert value(spark, T.strip_code_fence(F.lit("x\n```\n"))) == "x\n```"


def test_file_names(spark):
    broken = "文档.md".encode().decode("latin1")
    assert value(spark, T.repair_filename(F.lit(broken))) == "文档.md"
    assert value(spark, T.repair_filename(F.lit("文档.md"))) == "文档.md"
    assert value(spark, T.repair_filename(F.lit("a.txt"))) == "a.txt"
    assert value(spark, T.repair_filename(F.lit("\xe9.txt"))) == "�.txt"
    assert value(spark, T.file_extension(F.lit("a.b/c.PDF"))) == ".pdf"
    assert value(spark, T.file_extension(F.lit(".bashrc"))) == ""


def test_titles(spark):
    assert value(spark, T.title_from_text(F.lit("x" * 15))) == "x" * 15 + "..."
    assert value(spark, T.title_from_text(F.lit("x" * 14))) == "x" * 14
    assert value(spark, T.title_from_text(F.lit(None).cast("string"))) == "新对话"


def test_images_data(spark):
    raw = 'hi\n[IMAGES_DATA]["a","b"][/IMAGES_DATA] x [IMAGES_DATA]["c"][/IMAGES_DATA]'
    got = value(spark, T.extract_images_data(F.lit(raw), F.lit("assistant")))
    assert (got.text, got.images) == ('hi\n x [IMAGES_DATA]["c"][/IMAGES_DATA]', ["a", "b"])
    assert value(spark, T.extract_images_data(F.lit(raw), F.lit("user"))).text == raw
    bad = "hi [IMAGES_DATA]oops[/IMAGES_DATA] x"
    assert value(spark, T.extract_images_data(F.lit(bad), F.lit("assistant"))).text == bad
    assert value(spark, T.strip_images_data(F.lit(raw))) == "hi\n x"


def test_occurrences_do_not_overlap(spark):
    assert value(spark, T.count_occurrences(F.lit("aaaaa"), F.lit("aa"))) == 2
    assert value(spark, T.count_occurrences(F.lit("aaaaa"), F.lit(""))) == 0


def test_keyword_list(spark):
    assert value(spark, T.parse_keyword_list(F.lit(" a, b，c、、d "))) == ["a", "b", "c", "d"]


def test_page_heading(spark):
    f, n, none = F.lit("f.pdf"), F.lit(2), F.lit(None).cast("string")
    assert value(spark, T.page_heading_text(f, n, F.lit("seen"))) == "# f.pdf - 第 2 页多模态解读\n\nseen"
    failed = value(spark, T.page_heading_text(f, n, none, F.lit("hint")))
    assert failed.startswith("# f.pdf - 第 2 页多模态解读\n\n【页面摘要】\nhint\n\n")
