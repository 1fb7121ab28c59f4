import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusqa.llm import sentencepieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = sp.PieceBpe(PATH)
TEXTS = [
    "", " ", "   ", "Hello, WORLD! it's we'll 12345 a1b2", "aaaaaaa aaaa  aaa   aa a", "école É́ ﬁ naïve Straße", "▁x▁▁ y▁", "a\nb\r\n\tc\n\n",
    "<s>x</s> <unk> <0x41> <|endoftext|>", "\x1ca\x1d \x85c\xa0d　e​f﻿f g", "日本語のテキスト 中文字符 한국어 ไทย", "\U0001f600\U0001f468‍\U0001f469!!!??", "«So» “he said”, (…) ».”",
    "x" * 300, "\x00\x01 \x7f", "a" + " " * 100 + "b", "�" * 3, " leading and trailing ",
]


def ours(text):
    packed = b"".join(b"".join(MODEL.segment(c)) for c in MODEL.pieces(text))
    ids = [*np.frombuffer(packed, "<i4").tolist(), MODEL.end]
    return ids, MODEL.decode(ids)


def library(text):
    ids = LIBRARY.encode(text, add_eos=True, num_threads=1)
    return ids, LIBRARY.decode(ids)


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    assert ours(text) == library(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="abehinot 's'.,1É▁\n«”", max_size=80))
def test_any_text_as_the_library(text):
    assert ours(text) == library(text)


@pytest.mark.parametrize("long", [0, 3, 48, 10_000])
def test_rounds_and_heap_agree(monkeypatch, long):
    monkeypatch.setattr(sp, "LONG", long)
    r = random.Random(5)
    for text in ["ab" * 200, "a" * 401, "".join(r.choices("abcdehiorstn", k=900)), "the" * 100, "x", "ééöß日本" * 30, "." * 99, *TEXTS]:
        assert ours(text) == library(text)


def test_chunks_cannot_be_crossed():
    """No piece holds a boundary of the chunk pattern: a piece alone is one chunk."""
    for n in range(LIBRARY.vocab_size()):
        if not (LIBRARY.is_control(n) or LIBRARY.is_byte(n) or LIBRARY.is_unknown(n)):
            assert MODEL.chunk.fullmatch(LIBRARY.id_to_piece(n))


@pytest.mark.parametrize("pattern", [r"(?s).+", "▁*[^▁]+|▁+"])
def test_wider_chunks_give_the_same(monkeypatch, pattern):
    monkeypatch.setattr(MODEL, "chunk", sp.re.compile(pattern))
    for text in TEXTS:
        assert ours(text) == library(text)


def test_ids_that_are_no_text():
    for ids in ([MODEL.bytes[0xE9].item()] * 3, [0, 5, 300], [1, 1, 264, 2], [MODEL.bytes[b].item() for b in b"a\xe2\x96"] + [300], []):
        assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_other_models_are_refused(tmp_path):
    (tmp_path / "unigram").write_bytes(b"")
    with pytest.raises(ValueError):
        sp.PieceBpe(str(tmp_path / "unigram"))


def test_table(spark, monkeypatch):
    monkeypatch.setattr(sp, "CACHED", 5)
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (None, "no id", 1), (99, None, 1), (100, "word, " * 700_000 + "end", 1), (101, "ab" * 1_100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = sp.encode_decode(docs, PATH)
    assert found.columns == ["doc_id", "ids", "decoded"]
    got = [(r.doc_id, list(r.ids), r.decoded) for r in found.collect()]
    assert sorted(got, key=repr) == sorted([(i, *library(t or "")) for i, t, _ in rows], key=repr)
    assert sp.encode_decode(docs.limit(0), PATH).count() == 0


def test_query_against_the_library(spark):
    from corpusqa.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    wanted = set()
    for d in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids, decoded = library(d.text or "")
        wanted.add((d.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert set(map(tuple, QUERIES["op11_sentencepiece"](spark, folder).collect())) == wanted
