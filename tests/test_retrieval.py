"""Searches against fixtures and against plain loops."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusqa.models import batch_scorer
from corpusqa.operators import bm25, fusion, inverted_lists, lexical_index, substring, vectors
from corpusqa.operators.lexical_index import build_index
from corpusqa.operators.ranking import number_rows

SF = "/root/testdata/sf0.001"
CHUNKS = [
    ("a.md", 0, "token refresh guide"),
    ("a.md", 1, "refresh the token then refresh again"),
    ("b.md", 0, "知识库助手 说明"),
    ("b.md", 1, ""),
]


@pytest.fixture(scope="module")
def small(spark):
    chunks = spark.createDataFrame(CHUNKS, "filename string, chunk_index int, text string")
    return chunks, build_index(chunks)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chunks = docs.select(F.concat_ws("/", "source", "doc_id").alias("filename"), F.lit(0).alias("chunk_index"), "text")
    questions = spark.read.parquet(f"{SF}/benchmark.parquet").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )
    return chunks, questions, build_index(chunks)


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "question_id bigint, question string")


def test_corpus_stats(small):
    stats = small[1].corpus_stats.first()
    assert (stats.n_docs, stats.avg_len) == (4, 8.75)
    lens = {(r.filename, r.chunk_index): r.doc_len for r in small[1].doc_terms.collect()}
    assert lens == {("a.md", 0): 7, ("a.md", 1): 10, ("b.md", 0): 14, ("b.md", 1): 4}


def test_bm25_fixture(spark, small):
    hits = bm25.bm25_search(ask(spark, "refresh token?", "知识库助手"), small[1])
    got = [
        (r.question_id, r["rank"], f"{r.filename}-{r.chunk_index}", round(r.score, 6), r.matched_terms)
        for r in hits.orderBy("question_id", "rank").collect()
    ]
    assert got[:2] == [
        (0, 0, "a.md-1", 1.598017, ["refresh", "token"]),
        (0, 1, "a.md-0", 1.5234, ["refresh", "token"]),
    ]
    assert got[2][:4] == (1, 0, "b.md-0", 7.584081) and len(got[2][4]) == 8 and len(got) == 3


def test_one_pass_or_several(spark, corpus, monkeypatch):
    """The same hits as from all scores, in one pass or in many, and for text ids as well."""
    _, questions, index = corpus
    spell = lambda hits: [
        (str(r.question_id), r["rank"], r.filename, r.score, tuple(r.matched_terms)) for r in hits.orderBy(F.col("question_id").cast("string"), "rank").collect()
    ]
    whole = spell(bm25.bm25_search(questions, index, k=7))
    all_scores = {(str(r.question_id), r.filename): r.score for r in bm25.bm25_score(questions, index).collect()}
    assert all(all_scores[q, f] == s for q, _, f, s, _ in whole)
    for q in {q for q, *_ in whole}:
        mine = sorted((s for (p, _), s in all_scores.items() if p == q), reverse=True)[:7]
        assert [s for p, _, _, s, _ in whole if p == q] == mine
    monkeypatch.setattr(bm25, "_CELLS", 100)  # two or three chunks at a time
    assert spell(bm25.bm25_search(questions, index, k=7, block_bytes=2000)) == whole
    named = questions.withColumn("question_id", F.col("question_id").cast("string"))
    assert spell(bm25.bm25_search(named, index, k=7)) == whole
    assert bm25.bm25_search(questions.limit(0), index).count() == 0


def both_ways(questions, index, monkeypatch, k=7):
    """Hits by the postings of the questions' terms and by the forward index."""
    spell = lambda hits: [(r.question_id, r["rank"], r.filename, r.score, tuple(r.matched_terms)) for r in hits.orderBy("question_id", "rank").collect()]
    found = []
    monkeypatch.setattr(bm25, "SOUGHT_FROM", 0)
    for share in (1e9, -1.0):
        monkeypatch.setattr(bm25, "SOUGHT_SHARE", share)
        found.append(spell(bm25.bm25_search(questions, index, k)))
    return found


@pytest.mark.parametrize("bits", [0, 2, 10])
def test_postings_and_forward_index_give_the_same(spark, corpus, monkeypatch, bits):
    """Bit for bit, with ties, for blocks of one chunk, of four and of all; text and decimal ids as well."""
    from corpusqa.operators import lexical_index

    chunks, questions, _ = corpus
    monkeypatch.setattr(lexical_index, "BLOCK_BITS", bits)
    doubled = chunks.unionByName(chunks.limit(40).withColumn("filename", F.concat("filename", F.lit("-copy"))))
    index = build_index(doubled)
    few = questions.limit(25)
    sought, passed = both_ways(few, index, monkeypatch)
    assert sought == passed and len(sought) > 100
    for kind in ("string", "decimal(20,3)", "double"):
        sought, passed = both_ways(few.limit(5).withColumn("question_id", F.col("question_id").cast(kind)), index, monkeypatch, 3)
        assert sought == passed and sought


def scanned(frame, folder):
    """Rows that scans of a folder gave out when the frame ran."""
    frame.collect()
    todo, rows = [frame._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec" and folder in node.relation().location().rootPaths().toString():
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


def test_one_question_reads_a_few_pages(spark, monkeypatch):
    """Of an index of some million postings a question of rare terms reads under a tenth of the rows."""
    rows = spark.range(4000).select(
        F.concat(F.lit("f"), "id").alias("filename"), F.lit(0).alias("chunk_index"),
        F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(250)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(5000))))).alias("text"),
    )
    index = build_index(rows)
    monkeypatch.setattr(bm25, "SOUGHT_FROM", 0)
    found = bm25.bm25_search(ask(spark, "w17 w4711 w99"), index)
    assert found.count() == 10
    total = index.postings.count()
    assert total > 900_000
    found = bm25.bm25_search(ask(spark, "w17 w4711 w99"), index)
    assert 0 < scanned(found, "/postings") < total / 10 and scanned(found, "/blocks") < total / 10


def test_many_copies(spark):
    rows = [(f"f{i:03d}", 0, "the same words" if i >= 100 else f"the word {i}") for i in range(300)]
    index = build_index(spark.createDataFrame(rows, "filename string, chunk_index int, text string"))
    hits = bm25.bm25_search(ask(spark, "same words", "the"), index, 5).orderBy("question_id", "rank").collect()
    assert [r.filename for r in hits[:5]] == [f"f{i}" for i in range(100, 105)]


def test_scores_do_not_depend_on_partitioning(spark, corpus):
    chunks, questions, index = corpus
    other = build_index(chunks.repartition(5))
    key = lambda i: {(r.question_id, r["rank"], r.filename, r.score) for r in bm25.bm25_search(questions, i).collect()}
    assert key(index) == key(other)


def test_passages_find_their_document(corpus):
    chunks, questions, index = corpus
    top = bm25.bm25_search(questions, index, k=1).select("question_id", "filename")
    texts = {r.filename: r.text for r in chunks.collect()}
    asked = {r.question_id: r.question for r in questions.collect()}
    held = {q for q, t in asked.items() if any(t in d for d in texts.values())}
    right = [r for r in top.collect() if r.question_id in held and asked[r.question_id] in texts[r.filename]]
    assert held and len(right) >= 0.95 * len(held)


def test_copies_count_as_documents_of_their_own(spark):
    rows = [("a", 0, "same words here", i) for i in range(3)] + [("b", 0, "other", 9)]
    chunks = spark.createDataFrame(rows, "filename string, chunk_index int, text string, row_id bigint")
    index = build_index(chunks, key=("filename", "chunk_index", "row_id"))
    assert bm25.bm25_search(ask(spark, "same words"), index).count() == 3


def plain_nearest(asked, stored, k):
    out = []
    for q, v in asked:
        d = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), key) for key, w in stored)
        out += [(q, key, rank, round(dist, 9)) for rank, (dist, key) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("limit", [vectors.BLOCK_BYTES, 300])
def test_nearest_with_many_copies(spark, limit):
    rng = np.random.default_rng(3)
    pool = rng.normal(size=(60, 8)).astype("float32")
    pool[20:60] = pool[20]  # two thirds are copies of one vector
    stored = [(f"f{i:03d}", pool[i].tolist()) for i in range(60)]
    asked = [(i, (pool[i] + (i % 3) * 0.01).tolist()) for i in range(25)]
    vdf = spark.createDataFrame(stored, "filename string, vector array<float>").repartition(5)
    qdf = spark.createDataFrame(asked, "question_id bigint, vector array<double>")
    got = vectors.nearest(qdf, vdf, 6, key=["filename"], block_bytes=limit).collect()
    exact = [(q, np.array(v, dtype="float64")) for q, v in asked]
    want = plain_nearest(exact, [(k, np.array(v, dtype="float64")) for k, v in stored], 6)
    assert sorted((r.question_id, r.filename, r["rank"], round(r.distance, 9)) for r in got) == want


def test_dimension_check(spark):
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<float>")
    with pytest.raises(ValueError):
        vectors.check_dimension(mixed)
    with pytest.raises(ValueError):
        vectors.check_dimension(mixed.limit(1), 3)


def test_rank_fusion(spark):
    v = [(0, "a", 0, 0), (0, "a", 1, 1), (0, "b", 0, 2), (1, "x", 0, 0)]
    b = [(0, "a", 1, 0, 3.0, ["t"]), (0, "c", 0, 1, 2.0, ["t"]), (0, "a", 0, 2, 1.0, ["t"]), (1, "y", 0, 0, 1.0, []), (2, "z", 0, 0, 9.0, []), (2, "z", 0, 3, 2.0, [])]
    vdf = spark.createDataFrame(v, "question_id bigint, filename string, chunk_index int, rank int")
    bdf = spark.createDataFrame(b, "question_id bigint, filename string, chunk_index int, rank int, score double, matched_terms array<string>")
    fused = fusion.rrf_topk(fusion.rrf_score(fusion.rrf_merge(vdf, bdf))).orderBy("question_id", "fused_rank").collect()
    got = [(r.question_id, f"{r.filename}-{r.chunk_index}", round(r.rrf_score, 6)) for r in fused]
    assert got == [
        (0, "a-1", 0.038839),
        (0, "a-0", 0.038476),
        (0, "c-0", 0.019231),
        (0, "b-0", 0.018868),
        (1, "x-0", 0.019608),
        (1, "y-0", 0.019608),
        (2, "z-0", round(1 / 54, 6)),
    ]


def test_rerank_and_final_cut(spark):
    rows = [(0, i, f"f{i}", "q", text) for i, text in enumerate(["2", "9.5", "no number", "7", "fail"])]
    df = spark.createDataFrame(rows, "question_id bigint, fused_rank int, filename string, question string, text string")

    def chat(question: pd.Series, text: pd.Series) -> pd.Series:
        return text.where(text != "fail")

    scored = fusion.rerank(df, batch_scorer(chat, chat=True))
    kept = fusion.final_topk(scored, k=3).orderBy("final_rank").collect()
    assert [(r.filename, r.rerank_score) for r in kept] == [("f1", 9.5), ("f3", 7.0), ("f2", 5.0)]

    def broken(question, text):
        raise RuntimeError("model is down")

    down = fusion.final_topk(fusion.rerank(df, batch_scorer(broken)), k=3).orderBy("final_rank").collect()
    assert [(r.filename, r.rerank_score) for r in down] == [("f0", 5.0), ("f1", 5.0), ("f2", 5.0)]


def test_keyword_counts_match_a_plain_loop(spark, corpus):
    chunks, _, index = corpus
    texts = {r.filename: r.text.lower() for r in chunks.collect()}
    asked = {0: ["the", "An"], 1: ["in, "], 2: ["zzzz"], 3: [". ", "eau", "é"], 4: ["!?"], 5: ["n the"], 6: [" the ", ".\n"], 7: ["e the i", "d in zzzz the"], 8: ["s. T", "-", " "]}
    df = spark.createDataFrame(list(asked.items()), "question_id bigint, keywords array<string>")
    got = substring.keyword_count_score(df, chunks, index).collect()
    want = set()
    for q, words in asked.items():
        scored = [(-sum(t.count(w.lower()) for w in words), f) for f, t in texts.items()]
        want |= {(q, f, -s) for s, f in sorted(scored)[:5] if s < 0}
    assert {(r.question_id, r.filename, r.score) for r in got} == want


def test_like_search_matches_a_plain_loop(spark, corpus):
    chunks, _, index = corpus
    texts = {r.filename: r.text for r in chunks.collect()}
    asked = ["the and", "src1 THE", "eau qu", "nosuchword the", "!!", "ion ed in", "en"]
    got = substring.like_search_score(ask(spark, *asked), chunks, index).collect()
    want = set()
    for q, text in enumerate(asked):
        words = [w for w in text.replace("!", " ").lower().split() if len(w) >= 2]
        scored = []
        for f, t in texts.items():
            if words and all(w in t or w in f for w in words):
                scored.append((-sum(t.lower().count(w) + 3 * (w in f.lower()) for w in words), f))
        want |= {(q, f, -s) for s, f in sorted(scored)[:8] if s < 0}
    assert {(r.question_id, r.filename, r.score) for r in got} == want


def test_numbering_survives_a_hot_group(spark):
    rows = [("hot", i) for i in range(500)] + [(f"g{i}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, o int").repartition(7)
    got = number_rows(df, ["o"], ["g"]).collect()
    assert sorted((r.g, r.o, r.row_no) for r in got) == sorted((g, o, o if g == "hot" else 0) for g, o in rows)
    every = number_rows(df.where("g = 'hot'"), ["o"]).collect()
    assert all(r.row_no == r.o for r in every) and len(every) == 500


def test_idf_formula(small):
    row = small[1].term_stats.where("term = 'refresh'").first()
    assert row.df == 2 and math.isclose(row.idf, math.log(1 + 2.5 / 2.5))


def test_inverted_lists(spark, tmp_path):
    """Recall with few lists probed, equality with all, partitions that are not probed stay unread, copies and odd rows."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 16)) * 4
    stored = [(f"f{i:04d}", (middle[i % 12] + rng.normal(size=16) * 0.3).tolist()) for i in range(600)]
    stored += [(f"g{i:04d}", stored[0][1]) for i in range(300)] + [("none", None)]
    vdf = spark.createDataFrame(stored, "filename string, vector array<float>")
    asked = spark.createDataFrame([(i, stored[i * 7][1]) for i in range(60)] + [(99, None)], "question_id bigint, vector array<double>")
    index = inverted_lists.build_vector_index(vdf, str(tmp_path / "lists"), ["filename"], n_lists=12, sample=200)
    assert index.vectors.count() == 900
    spell = lambda hits: sorted((r.question_id, r.filename, r["rank"], round(r.distance, 9)) for r in hits.collect())
    exact = vectors.nearest(asked, vdf, 8, ["filename"])
    for known in (index, inverted_lists.load_vector_index(spark, str(tmp_path / "lists"), ["filename"])):
        assert spell(inverted_lists.nearest_approx(asked, known, 8, 12)) == spell(exact)
        assert spell(inverted_lists.nearest_approx(asked, known, 8, 12, block_bytes=500)) == spell(exact)
    found = inverted_lists.nearest_approx(asked, index, 8, 2)
    assert inverted_lists.recall(found, exact, ["filename"]).first()["recall"] >= 0.9
    one = inverted_lists.nearest_approx(asked.limit(1), index, 8, 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "(list#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    few = inverted_lists.vector_search_approx(asked, index, 3, 0.5, probes=12)
    assert spell(few) == spell(vectors.vector_search(asked, vdf, 3, 0.5, ["filename"]))
    nothing = inverted_lists.build_vector_index(vdf.limit(0), None, ["filename"])
    assert inverted_lists.nearest_approx(asked, nothing, 3).count() == 0 and inverted_lists.nearest_approx(asked.limit(0), index, 3).count() == 0
    single = inverted_lists.build_vector_index(vdf.where("filename = 'f0000'"), None, ["filename"])
    assert inverted_lists.nearest_approx(asked, single, 3).count() == 60


def test_query_of_the_store_search_takes_all_words(spark, tmp_path):
    from catalog.queries import QUERIES

    docs = [(1, "alpha beta gamma delta delta", "en", "s"), (2, "alpha beta gamma", "en", "s"), (3, "delta", "en", "s")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES["like_search_score"](spark, str(tmp_path)).collect()
    assert [(r["question_id"], r["filename"], r["score"]) for r in rows] == [(7, "s/1", 5)]


def test_hits_that_a_task_holds_are_bounded():
    rng = np.random.default_rng(5)
    stored, asked, k = rng.integers(-3, 4, (900, 4)).astype(float), rng.integers(-3, 4, (70, 4)).astype(float), 5
    best, held = vectors.Best(np.arange(70) + 100, asked, ["name"], k), []
    for low in range(0, 900, 30):
        best.add(pd.DataFrame({"name": [f"v{n}" for n in range(low, low + 30)], "vector": list(stored[low : low + 30])}))
        held.append(sum(map(len, best.frames)))
    assert max(held) <= 2 * k * 70
    got = [(r.question_id, r.name, r.distance) for r in next(best.rows()).itertuples(index=False)]
    names = [f"v{n}" for n in range(900)]
    want = [(q + 100, n, d) for q, a in enumerate(asked) for d, n in sorted(zip(((stored - a) ** 2).sum(axis=1), names))[:k]]
    assert got == want
    # a pass has no more hits than BLOCK_HITS, however small the vectors are
    assert -(-1_000_000 // vectors.n_blocks(1_000_000, 4, 20, vectors.BLOCK_BYTES)) * 20 <= vectors.BLOCK_HITS


def test_symbols_are_the_signs_of_the_text(spark):
    from corpusqa.operators import lexical_index

    texts = ["Ab, c.\n\td  é-知 1 .", "", None, "😀😀 -- word", ".,.,", "plain"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string").repartition(2)
    got = {r["n"]: r["s"] for r in rows.select("n", lexical_index.symbols_of(F.lit("a/b"), F.col("text")).alias("s")).collect()}
    for n, text in enumerate(texts):
        want = {c for c in "a/b" + ("" if text is None else "\n" + text.lower()) if not c.isalnum()}
        assert set(got[n]) == want and len(got[n]) == len(want)


def test_index_tables_of_many_rows_have_more_partitions(spark, monkeypatch):
    """Sorted partitions stay of one size, and a term is in the table of stretches once per place at most (three times before)."""
    monkeypatch.setattr(lexical_index, "_SORTED_ROWS", 20)
    rows = [(f"f{i}", 0, f"lalala word{i} other{i * 7} de") for i in range(60)]
    index = lexical_index.build_index(spark.createDataFrame(rows, "filename string, chunk_index int, text string"))
    assert index.postings.select(F.spark_partition_id()).distinct().count() > 1
    assert len(index.postings.inputFiles()) > 8
    terms = [r.term for r in index.term_stats.select("term").collect()]
    assert index.grams.count() <= sum(map(len, terms))
    got = sorted((r.gram, r.term) for r in lexical_index.beginnings(index.grams).collect())
    assert got == sorted({(t[i : i + n], t) for t in terms for n in (1, 2, 3) for i in range(len(t) - n + 1)})


def test_term_counts(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["é", "z", "𝄞", "￮"])], "n int, tokens array<string>")
    got = {r.n: [tuple(t) for t in r.c] for r in rows.select("n", lexical_index.term_counts("tokens").alias("c")).collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: [], 3: [("z", 1), ("é", 1), ("￮", 1), ("𝄞", 1)]}


def test_bm25_score_shuffles_no_pairs(spark):
    """Every pair comes out of a pass over the forward index, for questions without a number too."""
    rows = [(f"f{i}", 0, f"common word{i % 5}") for i in range(50)]
    index = lexical_index.build_index(spark.createDataFrame(rows, "filename string, chunk_index int, text string"))
    asked = spark.createDataFrame([(1, "common word1"), (2**60 + 1, "word2"), (None, "common")], "question_id bigint, question string")
    scores = bm25.bm25_score(asked, index)
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    got = scores.groupBy("question_id").count().collect()
    assert {r.question_id: r["count"] for r in got} == {1: 50, 2**60 + 1: 10, None: 50}


def _written(monkeypatch):
    """Rows and plan of every table that substring search writes, by name."""
    seen, write = {}, substring.materialise

    def note(df, name):
        out = write(df, name)
        seen.setdefault(name, []).append((out.count(), df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(substring, "materialise", note)
    return seen


def _many_words(spark):
    """Sixty chunks, each with twenty words of its own that hold "abc"; one of them holds "zabcq" too."""
    rows = [(f"f{i}", 0, " ".join(f"x{i}abc{j}" for j in range(20)) + (" ZABCQ zabcq. The end" if i == 7 else " the end")) for i in range(60)]
    df = spark.createDataFrame(rows, "filename string, chunk_index int, text string")
    return df, lexical_index.build_index(df, strip_images=False)


def test_words_of_frequent_needles_are_not_kept(spark, monkeypatch):
    chunks, index = _many_words(spark)
    seen = _written(monkeypatch)
    for query in (substring.like_filter, substring.like_search_score):
        seen.clear()
        got = query(ask(spark, "abc zabcq", "abc"), chunks, index)
        hits = {(r.question_id, r.filename) for r in got.collect()}
        assert (0, "f7") in hits and not {f for q, f in hits if q == 0 and f != "f7"}
        assert sum(q == 1 for q, _ in hits) == (60 if query is substring.like_filter else 8)
        # "abc" is in 1,201 words and 1,201 (chunk, word) pairs: it is looked for in the texts instead
        assert sum(n for name in seen if name != "candidates" for n, _ in seen[name] if name not in ("wanted", "pairs")) < 60


def test_keyword_candidates_are_not_put_together_where_the_index_is_read(spark, monkeypatch):
    chunks, index = _many_words(spark)
    seen = _written(monkeypatch)
    asked = spark.createDataFrame([(0, ["abc", "the end", "zabcq. t"])], "question_id bigint, keywords array<string>")
    got = substring.keyword_count_score(asked, chunks, index).collect()
    assert [(r.filename, r.score, r.matched_keywords) for r in got][0] == ("f7", 24, ["abc", "the end", "zabcq. t"]) and len(got) == 5
    (n, plan), = seen["candidates"]
    assert n == 60 and "keys=[needle" not in plan


def test_chunks_that_share_a_key_are_told_apart_by_their_words(spark):
    """A chunk without the words of a needle adds nothing to another chunk of the same key."""
    rows = [("f", 0, "zero one two three"), ("f", 0, "zero one other"), ("g", 0, "two"), ("h", 0, "two")]
    chunks = spark.createDataFrame(rows, "filename string, chunk_index int, text string")
    index = lexical_index.build_index(chunks, strip_images=False)
    asked = spark.createDataFrame([(0, ["o one two t"])], "question_id bigint, keywords array<string>")
    assert [(r.filename, r.score) for r in substring.keyword_count_score(asked, chunks, index).collect()] == [("f", 1)]
    assert [(r.filename, r.text) for r in substring.like_filter(ask(spark, "one two"), chunks, index).collect()] == [("f", "zero one two three")]


def test_store_search_pays_for_what_it_reads_only(spark, monkeypatch, tmp_path):
    """No sorted table is written for it, and only the texts of candidates are dealt out and lower-cased."""
    rows = [(f"f{i}", 0, f"Word{i} word{i} of the text") for i in range(60)]
    chunks = spark.createDataFrame(rows, "filename string, chunk_index int, text string")
    index = lexical_index.build_index(chunks, strip_images=False)
    seen = _written(monkeypatch)
    hits = substring.like_search_score(ask(spark, "ord7 the", "word59", "nowhere the"), chunks, index)
    assert sorted((r.question_id, r.filename, r.score) for r in hits.collect()) == [(0, "f7", 3), (1, "f59", 2)]
    assert [n for n, _ in seen["candidates"]] == [2]
    tables = lambda place: {name.split("-")[0] for name in os.listdir(place.removeprefix("file:"))}
    assert tables(index.path) == {"doc_terms", "corpus_stats", "term_stats"}
    # tables written when they are read are those of an index that is kept
    kept = lexical_index.build_index(chunks, str(tmp_path / "kept"), strip_images=False)
    every = {"doc_terms", "corpus_stats", "term_stats", "postings", "blocks", "grams"}
    assert tables(kept.path) == every
    for name in every:
        spell = lambda i: sorted(map(str, getattr(i, name).collect()))
        assert spell(index) == spell(kept) == spell(lexical_index.load_index(spark, str(tmp_path / "kept")))
    assert substring.like_search_score(ask(spark, "ord7 the"), chunks, kept).count() == 1
    assert index.postings is index.postings and tables(index.path) == every - {"grams"}


def test_hits_of_many_passes(spark, monkeypatch):
    """Each task of a pass returns k hits a question: with many questions, passes keep the cores at work and a pass needs few tasks."""
    r = np.random.default_rng(3)
    stored = [(f"f{i:04d}", r.normal(size=8).astype("float32").tolist()) for i in range(640)]
    vdf = spark.createDataFrame(stored, "filename string, vector array<float>").repartition(64)
    qdf = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(stored[:40])], "question_id bigint, vector array<float>")
    whole = sorted(map(tuple, vectors.nearest(qdf, vdf, 5, ["filename"]).collect()))
    index = inverted_lists.build_vector_index(vdf, None, ["filename"], n_lists=40)
    monkeypatch.setattr(vectors, "BLOCK_HITS", 25)  # eight passes
    for module in (vectors, inverted_lists):
        top_k, made = module.top_k, []
        monkeypatch.setattr(module, "top_k", lambda frame, *a: made.append(frame.count()) or top_k(frame, *a))
        found = vectors.nearest(qdf, vdf, 5, ["filename"]) if module is vectors else inverted_lists.nearest_approx(qdf, index, 5, 40)
        assert sorted(map(tuple, found.collect())) == whole
        assert made[0] <= vectors.LEAST_TASKS * 40 * 5


@pytest.mark.parametrize("case", ["even", "copies", "near copies", "far off", "short", "long", "mixed", "infinite", "zeros"])
def test_pairs_near_a_limit(case):
    """Distances are looked through in single precision first: none that counts is lost, whatever the lengths of the vectors."""
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 16))
    if case == "copies":
        x[50:400] = x[50]
    elif case == "near copies":
        x = np.repeat(x[:6], 100, axis=0) + r.normal(size=x.shape) * 1e-5
    elif case == "mixed":
        x *= 10.0 ** r.integers(-30, 30, size=(600, 1))
    elif case == "infinite":
        x[3, 3] = np.inf
    else:
        x = x * {"short": 1e-25, "long": 1e30, "zeros": 0.0}.get(case, 1.0) + (1000 if case == "far off" else 0)
    asked = x[20:60]
    best = vectors.Best(np.arange(40), asked, ["name"], 7)
    for low in range(0, 600, 150):
        best.add(pd.DataFrame({"name": [f"v{n:04d}" for n in range(low, low + 150)], "vector": list(x[low : low + 150])}))
    got = next(best.rows()).sort_values(["question_id", "distance", "name"])
    distance = ((x[None, :, :] - asked[:, None, :]) ** 2).sum(axis=2)
    want = [(q, f"v{n:04d}", distance[q, n]) for q in range(40) for n in sorted(range(600), key=lambda n: (distance[q, n], n))[:7]]
    assert list(got.itertuples(index=False, name=None)) == want
