import collections
import math
import random
import re

import numpy as np
import pytest

from corpusqa.llm import lemp

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """All pairs scored in whole numbers: one list of (rank, doc_id, score) per item."""
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    N, L, df = len(counts), sum(n for _, _, n in counts), collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in counts:
            m = 100 - 50 + ((50 * n * N) // L)
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    often = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(r.choices(words, often, k=r.choice([1, 5, 30, 200])))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(n // 3)]  # copies: ties
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 3, 12])))) for i in range(15)]
    return docs, items


@pytest.mark.parametrize("docs_at_once, share, common", [(7, (1 / 64, 1 / 8), 1 / 16), (50, (1 / 3,), 2.0), (2048, (), 0.0), (16, (1 / 8, 1 / 2), 0.2)])
def test_against_all_pairs(spark, monkeypatch, docs_at_once, share, common):
    monkeypatch.setattr(lemp, "_DOCS", docs_at_once)
    monkeypatch.setattr(lemp, "FIRST_SHARE", share)
    monkeypatch.setattr(lemp, "COMMON", common)
    docs, items = corpus(400)
    found = lemp.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=10)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(docs, items, 10)


def test_odd_rows(spark):
    docs = [(1, "Ärger über ÄRGER a-b_c"), (2, None), (3, ""), (4, " .,;"), (None, "x y z"), (5, "x y z"), (5, "x y z"), (6, "X\x00Y　Z"), (7, "rare " * 900_000 + "end"), (8, "end of it"), (9, "filler"), (10, "more filler")]
    items = [(1, "X y Z"), (1, "END rare"), (2, None), (3, ""), (4, "never seen"), (None, "ärger"), (5, "x"), (5, "x"), (6, "b c")]
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, item_id int, terms int, n int")
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, doc_id int, place int")
    wanted = plain(docs, items, 50)
    for options in ({}, {"block_items": 2}, {"block_bytes": 4}):
        assert sorted(map(tuple, lemp.search(frame, asked, **options).collect()), key=repr) == wanted
    assert lemp.search(frame.limit(0), asked).count() == 0
    assert lemp.search(frame, asked.limit(0)).count() == 0
    assert lemp.search(frame, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(lemp, "_PIECE", 5)
    text = "Aa bbbbbbbbbbbb,c é" * 20
    assert [t.decode() for part in lemp.terms_of(text.encode()) for t in part if t] == terms(text)


def test_items_of_very_many_terms_add_up_in_whole_numbers():
    n = 500
    weights = np.full(n, 2**33)
    args = 1, np.zeros(n, np.int64), np.arange(n), weights, np.arange(n) % 2 == 0
    held = lemp.Search(*args, np.zeros(1), 3)
    assert not held.exact
    impact = np.arange(999_000, 999_000 + n)
    _, _, score = held.bucket(np.zeros(n, np.int64), np.arange(n), impact, 1)
    assert score.tolist() == [2**33 * int(impact.sum())]


def test_bounds_skip_pairs(monkeypatch):
    """With a score to beat, buckets and pairs below it are not rescored."""
    args = 1, np.array([0, 0]), np.array([0, 1]), np.array([1000, 10]), np.array([False, True])
    row, term, impact = np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([900, 900, 900])
    every = lemp.Search(*args, np.zeros(1), 3).bucket(row, term, impact, 2)
    assert [c.tolist() for c in every] == [[0, 1], [0, 0], [909_000, 9_000]]
    some = lemp.Search(*args, np.array([10_000.0]), 3).bucket(row, term, impact, 2)
    assert [c.tolist() for c in some] == [[0], [0], [909_000]]
    assert all(len(c) == 0 for c in lemp.Search(*args, np.array([2e6]), 3).bucket(row, term, impact, 2))
