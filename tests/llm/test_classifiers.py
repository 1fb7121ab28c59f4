import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusqa.llm import grams, language, linear, quality
from corpusqa.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
ENGLISH, GERMAN, FRENCH = "the cat of the house is here ", "der hund und das haus sind da ", "le chat est dans la maison "


def crc(i):
    return zlib.crc32(str(i).encode())


def test_families_are_told_apart_first():
    assert language.family_of("en-GB") == language.family_of("de") == "germanic" and language.family_of("fr") == "romance"
    assert language.family_of("xx") == "xx"


@pytest.mark.parametrize("text", ["", " 12 .,!", None])
def test_no_letter_no_profile(text):
    assert language.profile(text) is None


def test_long_texts_go_in_slices(monkeypatch):
    text = "some words and ümläuts " * 300
    whole, styles = language.profile(text), quality.indicators(text)
    monkeypatch.setattr(grams, "_SLICE", 100)
    assert np.abs(language.profile(text) - whole).max() < 0.02
    assert set(styles) >= set(quality.indicators(text)) - {0} or len(np.setxor1d(styles, quality.indicators(text))) < 30


def test_languages_of_a_small_table(spark):
    rows = [(i, [ENGLISH, GERMAN, FRENCH][i % 3] * (1 + i % 4), ["en", "de", "fr"][i % 3], "x") for i in range(90)]
    rows += [(200, None, "en", "x"), (201, "", "de", "x"), (202, "123 ...", None, "x"), (203, ENGLISH * 40_000, None, "x"), (None, GERMAN, "de", "x"), (3, rows[3][1], "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    found = language.identify_languages(docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(by_id[3]) == 2 and sum(map(len, by_id.values())) == len(rows)
    for i, text, lang, _ in rows[:90]:
        assert by_id[i][0].lang_pred == lang and 0.5 < by_id[i][0].score <= 1 and by_id[i][0].held_out == (crc(i) % 3 == 1)
    assert [by_id[i][0].lang_pred for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "en", "de"]
    assert by_id[200][0].score == 0 and not by_id[None][0].held_out
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert len(left) == len(rows) - 3 and {r.doc_id: r.lang for r in left}[203] == "en"
    assert language.identify_languages(docs.limit(0)).count() == 0 and language.keep_identified(docs.limit(0)).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, "more", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify_languages(docs).collect()} == {("und", 0.0)}
    labels = spark.createDataFrame([(9, 1), (1, 7), (None, 0)], "doc_id long, quality int")
    assert len({r.score for r in quality.score_quality(docs, labels).collect()}) == 1
    assert quality.score_quality(docs.limit(0), labels.limit(0)).count() == 0


def test_held_out_languages(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = QUERIES["op1_language_id"](spark, FOLDER).collect()
    assert len(found) == len(truth) and all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_held_out_quality(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    found = QUERIES["op4_quality"](spark, FOLDER).collect()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    good, bad = ([r.score for r in held if truth[r.doc_id] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_quality_of_odd_rows(spark):
    good, bad = "Plain words make a sentence here. And another one.", "buy buy buy $$$ ### BUY NOW %%%"
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + f" w{i}", "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (None, bad, "x"), (7, good, "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, i % 2, 5) for i in range(60)] + [(3, 1, 5), (4, None, 5)], "doc_id long, quality int, score int")
    found = quality.score_quality(docs, labels).collect()
    assert len(found) == 64
    scores = {r.doc_id: r.score for r in found}
    assert min(scores[i] for i in range(1, 60, 2)) > max(scores[i] for i in range(0, 60, 2))
    assert scores[100] == scores[101] and scores[None] < 0.5


def test_the_sample_is_bounded_whatever_the_texts(spark):
    """Rows come in the order of their ids' hashes until their n-grams are over the bound; what is kept is what the texts have."""
    draw = np.random.default_rng(2)
    words = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(4000)]
    texts = [" ".join(words[i : i + 400 * (i % 9 + 1)]) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = lambda per_class, grams: quality.training_rows(docs, labels, F.lit(True), "doc_id", "text", "quality", per_class, grams)
    every, positive, rate = rows(100, quality.SAMPLE_GRAMS)
    assert sorted(map(len, every)) == sorted(len(quality.indicators(t)) for t in texts) and rate == 0.5
    assert {tuple(r) for r in every} == {tuple(quality.indicators(t)) for t in texts}
    bound = sum(map(len, every)) // 2
    some, labelled, _ = rows(100, bound)
    assert 0 < len(some) < 40 and sum(map(len, some)) <= bound < sum(map(len, every[: len(some) + 1]))
    assert all((a == b).all() for a, b in zip(some, every)) and (labelled == positive[: len(some)]).all()
    assert quality.SAMPLE_GRAMS >= 1000 << quality.BITS
    for n in (0, 1, 4095, 4096, 4097, 1 << quality.BITS):
        found = np.sort(draw.choice(1 << quality.BITS, n, replace=False)).astype(np.int32)
        assert (quality._unpacked(quality._packed(found)) == found).all() and len(quality._packed(found)) <= 1 << 14


def test_coordinate_descent_reaches_the_optimum():
    """Against subgradient steps on the primal problem."""
    draw = np.random.default_rng(0)
    x = draw.normal(size=(120, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) + 0.3 + draw.normal(size=120) * 0.5 > 0, 1.0, -1.0)
    rows = [(np.arange(5), v) for v in x]
    w = linear.fit_hinge(rows, y, 5, cost=1.0, epochs=400)
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])).sum()
    other = np.zeros(6)
    for k in range(1, 20_000):
        inside = y * (x @ other[:-1] + other[-1]) < 1
        step = other - np.append((x[inside] * y[inside, None]).sum(axis=0), y[inside].sum())
        other = other - step / k
    assert loss(w) <= loss(other) * 1.001


def test_sigmoid_fits_frequencies():
    draw = np.random.default_rng(1)
    m = draw.normal(size=5000)
    positive = draw.random(5000) < linear.sigmoid(1.7 * m - 0.4)
    a, b = linear.fit_sigmoid(m, positive, np.ones(5000))
    assert abs(a - 1.7) < 0.15 and abs(b + 0.4) < 0.1
