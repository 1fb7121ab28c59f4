import collections
import itertools
import random
import re

import pytest

from corpusqa.llm import decontamination as D


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(docs, items):
    """Every alignment of every item with every document."""
    out = {}
    distinct = {}
    for i, t in items:
        w = tuple(tokens(t))
        if w:
            distinct[w] = min(i, distinct.get(w, i))
    for doc_id, text in docs:
        d = tokens(text)
        for item, item_id in distinct.items():
            width, best = min(D.WINDOW, len(item)), None
            places = collections.defaultdict(list)
            for k, w in enumerate(item):
                places[w].append(k)
            # alignments with too few equal words in all need not be looked at
            equal_on = collections.Counter(at - k for at, w in enumerate(d) for k in places.get(w, ()))
            for diagonal in [x for x, n in equal_on.items() if n >= D.SHARE * width]:
                for start in range(max(0, -diagonal), min(len(item), len(d) - diagonal) - width + 1):
                    equal = sum(item[start + k] == d[start + diagonal + k] for k in range(width))
                    if equal >= D.SHARE * width:
                        best = max(best or (0,), (equal, width, -(start + diagonal), -start))
            if best:
                out[doc_id, item_id] = (best[0], best[1], -best[2], -best[3])
    return out


def found(frame):
    return {(r.doc_id, r.item_id): (r.n_equal, r.n_words, r.doc_word, r.item_word) for r in frame.collect()}


@pytest.mark.parametrize("size", range(1, D.WINDOW + 1))
def test_masks_lose_no_window(size):
    masks = D.masks_of(size)
    replaced = size - -(-4 * size // 5)
    places = [{o + k for k, c in enumerate(m) if c == "1"} for m in masks for o in range(size - len(m) + 1)]
    assert all(any(not p & set(bad) for p in places) for bad in itertools.combinations(range(size), replaced))


def test_substituted_passages(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ünder"]
    items = [(i, " ".join(r.choices(vocabulary, k=n))) for i, n in enumerate([5, 6, 7, 9, 11, 14, 15, 20, 40, 60, 4, 0, 1, 2, 3])]
    items += [(50, items[8][1].upper()), (51, None), (52, "¡" + items[7][1] + "!")]
    docs = []
    for n in range(120):
        body = r.choices(vocabulary, k=r.randint(0, 60))
        item = tokens(r.choice(items)[1])
        cut = item[r.randint(0, 3) :] if r.random() < 0.3 else item
        changed = [w if r.random() > 0.15 else "zzz" for w in cut]
        at = r.randint(0, len(body))
        docs.append((n, " ,".join(body[:at] + changed + body[at:])))
    docs += [(500, None), (501, ""), (502, "..."), (503, items[9][1]), (504, "x " * 100_000 + items[8][1])]
    frame = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, item_id int, seed string")
    wanted = plain(docs[:-1], items)
    short = tokens(items[8][1])
    wanted |= {(504, 8): (15, 15, 100_000, 0)} | {k: v for k, v in plain([(504, "x " * 100 + items[8][1])], items).items() if k[1] not in (8, 50)}
    wanted = {k: (*v[:2], v[2] + 99_900, v[3]) if k[0] == 504 and k[1] != 8 else v for k, v in wanted.items()}
    got = found(D.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")))
    assert got == wanted and len(short) == 40
    assert found(D.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), sent=0)) == wanted


def test_empty_and_repeated(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    text = "so: One two three; four five, six seven."
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "clean"), (2, "clean")], "doc_id long, text string")
    rows = D.contaminated(docs, items)
    assert sorted((r.doc_id or 0, r.item_id, r.n_equal) for r in rows.collect()) == [(0, 1, 7), (1, 1, 7)]
    left = D.without_rows(docs, rows)
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "clean"), (2, "clean")]
    assert sorted(map(repr, D.without_rows(docs, rows, sent=0).collect())) == sorted(map(repr, left.collect()))
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0
    assert D.contaminated(docs, spark.createDataFrame([(1, None), (2, "a b c d")], "item_id long, text string")).count() == 0


def test_short_items(spark):
    items = [(1, "Alpha"), (2, "alpha beta"), (3, "one two three"), (4, "two three four five"), (5, "你好世界"), (6, "never there"), (7, " ...")]
    docs = [(1, "the ALPHA, beta"), (2, "beta alpha"), (3, "zero one two three four five"), (4, "one two x three"), (5, "他说 你好世界 了"), (6, None)]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for sent in (D.SENT_SEEDS, 0):
        got = found(D.contaminated(frame, asked, sent=sent))
        assert got == plain(docs, items) and got.keys() == {(1, 1), (1, 2), (2, 1), (3, 3), (3, 4), (5, 5)}
        assert found(D.contaminated(frame, asked, sent=sent, least_words=3)).keys() == {(3, 3), (3, 4)}


def test_hits_do_not_hold_the_document(spark):
    """A long document of one passage, again and again: its hits with all of its words would be some 200 GB, and items over the length of a part are compared whole."""
    r = random.Random(4)
    item = [f"w{i}" for i in range(30)]
    long = [f"v{i}" for i in range(400)]
    changed = [w if i % 6 else "zzz" for i, w in enumerate(long)]
    docs = [(1, " ".join(item * 4000)), (2, " ".join(["x"] * 3 + changed[130:260] + ["y"])), (3, " ".join(long[300:314])), (4, " ".join(long[r.randint(60, 70) :]))]
    items = [(1, " ".join(item)), (2, " ".join(long))]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    wanted = {(1, 1): (15, 15, 0, 0)} | plain(docs[1:], items)
    assert found(D.contaminated(frame, asked)) == wanted and wanted.keys() == {(1, 1), (2, 2), (4, 2)}
    assert found(D.contaminated(frame, asked, sent=0)) == wanted


def shuffled(frame):
    """Bytes that the exchanges of a frame took, when it has run."""
    frame.collect()
    todo, size = [frame._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                size += node.metrics().apply("dataSize").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return size


def test_shuffle_in_proportion_to_a_text(spark, monkeypatch):
    """Seeds met by a shuffle, with broadcasts switched off: twice the words, twice the bytes."""
    written = []
    monkeypatch.setattr(D, "materialise", lambda df, name: written.append(shuffled(df)) or df)
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = []
        for n in (10_000, 20_000):
            text = " ".join(f"w{i % 9000}" for i in range(n))
            written.clear()
            rows = D.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), items, sent=0)
            sizes.append(shuffled(rows) + sum(written))
            assert rows.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 1.5 * sizes[0] < sizes[1] < 2.5 * sizes[0]
