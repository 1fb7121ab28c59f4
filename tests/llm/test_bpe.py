import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusqa.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
MODEL = bpe.WordBpe(PATH)
TEXTS = [
    "", " ", "Hello, WORLD! it's we'll 'sup they'd've 12345 a1b2", "aaaaaaa aaaa aaa aa a", "ΑΣ ΣΑΣ İstanbul ẞ ß ŉ", "école É́ ﬁ",
    "<|startoftext|>x<|endoftext|> <|endoftext|><|endoftext|> <| endoftext|> <|ENDOFTEXT|>", "\x1ca\x1d\x1fb \x85c\xa0d　e​f﻿f g",
    "日本語のテキスト 中文字符 한국어", "\U0001f600\U0001f468‍\U0001f469‍\U0001f467!!!??", "don't''s'''t", "x" * 300, "\x00\x01 \x7f", "½ ² ٣ Ⅷ ①",
]


def ours(text):
    ids = b"".join(b"".join(MODEL.encode_chunks(c)) for c in bpe.pieces(text))
    return np.frombuffer(ids, "<u4").tolist(), MODEL.decode(ids).decode()


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    assert ours(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cn", "Cs"]), max_size=40) | st.text(alphabet="abehinot 's'.,1É<|>endoftx", max_size=60))
def test_any_text_as_the_library(text):
    """Of characters that are assigned: the libraries differ in how recent a Unicode they know."""
    assert ours(text) == library(text)


@pytest.mark.parametrize("rounds", [0, 4096])
def test_long_words_through_the_heap(monkeypatch, rounds):
    monkeypatch.setattr(bpe, "ROUNDS", rounds)
    r = random.Random(5)
    for text in ["ab" * 500, "a" * 1001, "".join(r.choices("abcdehiorstn", k=3000)), "the" * 400, "x"]:
        assert ours(text) == library(text)


def test_table(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (None, "no id", 1), (99, None, 1), (100, "word " * 900_000 + "end", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = bpe.bpe_encode_decode(docs, PATH)
    assert found.columns == ["doc_id", "ids", "decoded"]
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in found.collect()]
    assert sorted(got, key=repr) == sorted([(i, *library(t or "")) for i, t, _ in rows], key=repr)
    assert bpe.bpe_encode_decode(docs.limit(0), PATH).count() == 0


def test_query_against_the_library(spark):
    from corpusqa.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    wanted = set()
    for d in docs:
        ids, decoded = library(d.text or "")
        wanted.add((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert set(map(tuple, QUERIES["op6_bpe"](spark, folder).collect())) == wanted
