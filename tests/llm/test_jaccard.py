"""Groups of near duplicates against the exact similarity of all pairs."""

import random

import numpy as np
import pytest

from corpusqa.llm import jaccard as J
from corpusqa.llm.simhash import keep_one_of_each_group


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_groups(texts):
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(sets))]


def edited(words, n, r):
    places = set(r.sample(range(len(words)), n))
    return [f"new{r.random()}" if k in places else w for k, w in enumerate(words)]


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in keep_one_of_each_group(docs).collect())


def test_short_texts_below_the_threshold_stay(spark):
    """One word of ten leaves 5 of 7 shingles, two of sixteen 10 of 14: both under 0.8."""
    r = random.Random(2)
    texts = []
    for _ in range(30):
        words = [f"w{r.randrange(9000)}" for _ in range(16)]
        texts += [" ".join(words[:10]), " ".join([*words[:9], "other"]), " ".join(words), " ".join([*words[:14], "two", "others"])]
    texts += [" ".join(f"v{i}" for i in range(40)), " ".join([*(f"v{i}" for i in range(39)), "end"])]  # 35 of 37: a copy
    groups = plain_groups(texts)
    assert kept_ids(spark, texts) == sorted(set(groups)) and len(set(groups)) == len(texts) - 1


@pytest.mark.parametrize("together, weight", [(J.TOGETHER, J.WEIGHT), (16, 4000)])
def test_true_pairs_inside_a_crowd_under_the_threshold(spark, monkeypatch, together, weight):
    """Texts of one template are at 0.6 to 0.75 of each other; a tenth has a copy at 0.85."""
    r = random.Random(3)
    template = [f"t{i}" for i in range(400)]
    texts = []
    for k in range(200):
        words = template[:330] + [f"own{k}w{i}" for i in range(70)]
        texts.append(" ".join(words))
        if k % 10 == 0:
            texts.append(" ".join(edited(words, 6, r)))
    texts += [None, "", "  ", texts[0].upper()]
    groups = plain_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = J.sketches(docs, "doc_id", "text").cache()
    roots = {x.text_hash: x.root for x in J.similar_groups(docs, found, "text", 100, weight, together).collect()}
    by = {}
    for row in found.collect():
        by.setdefault(roots.get(row.text_hash, row.text_hash), []).append(row.doc_id)
    wanted = {}
    for n, g in enumerate(groups):
        wanted.setdefault(g, []).append(n)
    assert sorted(map(sorted, by.values())) == sorted(wanted.values()) and len(wanted) == 201


def test_pairs_at_the_threshold_are_candidates():
    """The chance to share a band and to agree in the sketches is over 0.999 at 0.8."""
    from math import comb

    share = 1 - (1 - 0.8**J.ROWS) ** J.BANDS
    n = J.BANDS * J.ROWS
    agree = sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(J.AGREEING, n + 1))
    assert share > 0.9999 and agree > 0.9999
    draw = np.random.default_rng(4)
    met = 0
    for _ in range(2000):
        values = draw.integers(0, 1 << 63, size=200).astype(np.uint64)
        a, b = J.least_hashes(np.sort(values[:180])), J.least_hashes(np.sort(values[20:]))  # 160 of 200
        met += bool((J.bands_of(a) == J.bands_of(b)).any()) and ((a >> np.uint64(24)).astype(np.uint8) == (b >> np.uint64(24)).astype(np.uint8)).sum() >= J.AGREEING
    assert met >= 1999
