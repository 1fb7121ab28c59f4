from pyspark.sql import functions as F

from corpusqa.models import embed_questions, extract_keywords, generate_answers, hashing_embedder, interpret_pages, rewrite_queries
from corpusqa.operators import context, conversation
from corpusqa.operators.fusion import lexical_coverage
from corpusqa.operators.lexical_index import build_index
from corpusqa.plans.hybrid import answer_questions, hybrid_search
from corpusqa.models import embed_chunks
from corpusqa.schema import prepare_questions

MESSAGE = "conv_id int, turn int, role string, text string"


def test_history_window(spark):
    texts = ["aaaa", "bbbb", '[IMAGES_DATA]["x"][/IMAGES_DATA] ', "cccc", "dd"]
    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], MESSAGE)
    kept = lambda m, c: [r.text for r in conversation.history_window(df, m, c).orderBy("turn").collect()]
    assert kept(3, 10) == ["bbbb", "cccc", "dd"]
    assert kept(3, 9) == ["cccc", "dd"]
    assert kept(1, 100) == ["dd"]
    assert kept(5, 1) == []


def test_history_text_and_title(spark):
    df = spark.createDataFrame([(1, 1, "system", "s"), (1, 0, "user", "q"), (2, 0, "assistant", "a")], MESSAGE)
    history = conversation.format_history(df)
    assert {r.conv_id: r.history for r in history.collect()} == {1: "用户: q\n助手: s", 2: "助手: a"}
    asked = spark.createDataFrame([(1,), (3,)], "conv_id int")
    assert {r.conv_id: r.history for r in conversation.with_history(asked, history).collect()} == {1: "用户: q\n助手: s", 3: "无"}
    assert {r.conv_id: r.title for r in conversation.conversation_title(df).collect()} == {1: "q", 2: "新对话"}


def test_compaction_takes_the_first_tier_that_fits(spark):
    rows = [(c, t, "user", "x" * 30) for c in range(5) for t in range(4)]
    df = spark.createDataFrame(rows, MESSAGE).withColumn("sources", F.sequence(F.lit(1), F.lit(20)).cast("array<string>"))
    tiers = ((4, 3, 100), (3, 2, 20), (1, 1, 10))
    kept = lambda quota: conversation.compact_conversations(df, quota, tiers)
    assert {(r.conv_id, r.turn) for r in kept(360).collect()} == {(c, t) for c in (1, 2, 3, 4) for t in (1, 2, 3)}
    second = kept(359).collect()
    assert {(r.conv_id, r.turn) for r in second} == {(c, t) for c in (2, 3, 4) for t in (2, 3)}
    assert all(len(r.sources) == 12 and r.text.endswith("[内容已为本地存储截断]") for r in second)
    assert kept(5).count() == 0


def test_context_blocks(spark):
    rows = [
        (1, 1, "b.pdf", "page", "seen", "data:2"),
        (1, 0, "a.md", "text", "words", None),
        (1, 2, "b.pdf", "page", "unseen", ""),
        (1, 3, "c.png", "image", "pic", "data:3"),
    ]
    hits = spark.createDataFrame(rows, "question_id bigint, final_rank int, filename string, type string, text string, image string")
    asked = spark.createDataFrame([(1,), (2,)], "question_id bigint")
    got = {r.question_id: r.context for r in context.build_context(hits, asked).collect()}
    assert got == {
        1: "[文档1: a.md]\nwords\n\n---\n\n[页面图1: b.pdf]\n页面多模态解读: seen\n\n---\n\n[文档3: b.pdf]\nunseen\n\n---\n\n"
        "[页面图2: c.png]\n页面多模态解读: pic",
        2: "暂无相关文档",
    }
    assert context.answer_sources(hits).first().sources == ["a.md", "b.pdf", "c.png"]
    assert context.collect_images(hits).first().images == ["data:2", "data:3"]
    answers = answer_questions(asked.withColumn("question", F.lit("q")), hits)
    told = context.answer_events(answers).where("request_id = 1").orderBy("seq").collect()
    assert [r.type for r in told] == ["sources", "images", "content", "done"]
    folded = {r.request_id: r for r in context.fold_answer_events(context.answer_events(answers)).collect()}
    assert folded[1].content == got[1] and folded[1].sources == ["a.md", "b.pdf", "c.png"] and folded[2].sources == []


def test_question_models_and_their_failures(spark):
    asked = spark.createDataFrame([(1, "what is it"), (2, "fail")], "question_id bigint, question string")

    def reply(texts):
        return texts.map(lambda t: None if t == "fail" else "x, y、z")

    def broken(*_):
        raise RuntimeError("down")

    rows = rewrite_queries(extract_keywords(asked, reply), reply).orderBy("question_id").collect()
    assert [(r.keywords, r.rewritten) for r in rows] == [(["x", "y", "z"], "x, y、z"), ([], "fail")]
    rows = rewrite_queries(extract_keywords(asked, broken), broken).collect()
    assert all(r.keywords == [] and r.rewritten == r.question for r in rows)
    prompts = asked.withColumn("prompt", F.lit("p")).withColumn("context", F.lit("c"))
    assert {r.answer for r in generate_answers(prompts).collect()} == {"c"}
    assert all(r.answer.startswith("抱歉") for r in generate_answers(prompts, broken).collect())
    pages = spark.createDataFrame([("f", 1, "hint"), ("f", 2, None)], "filename string, page_number int, text_hint string")
    failed = {r.page_number: r.text for r in interpret_pages(pages, broken, wait_scale=0).collect()}
    assert "【页面摘要】\nhint\n" in failed[1] and "[页面视觉解读失败，且没有可用文本]" in failed[2]


def test_hybrid_search_end_to_end(spark):
    texts = {
        "cats.md": "Cats sleep most of the day and hunt at night.",
        "dogs.md": "Dogs guard the house and like long walks.",
        "fish.md": "Fish need clean water and a quiet tank.",
    }
    chunks = spark.createDataFrame(
        [(f, 0, "s", "text", t, None) for f, t in texts.items()],
        "filename string, chunk_index int, source string, type string, text string, image string",
    )
    asked = spark.createDataFrame([(1, "when do cats hunt"), (2, "clean water tank"), (3, "!!")], "question_id bigint, question string")
    embedder = hashing_embedder(64)
    vectors = embed_chunks(chunks, embedder).select("filename", "chunk_index", "vector")
    hits = hybrid_search(asked, build_index(chunks), vectors, chunks, lexical_coverage, embedder)
    best = {r.question_id: r.filename for r in hits.where("final_rank = 0").collect()}
    assert best[1] == "cats.md" and best[2] == "fish.md"
    offline = hybrid_search(asked, build_index(chunks), vectors, chunks, embedder=embedder)
    assert all(r.rerank_score == 5.0 for r in offline.collect())
    assert embed_questions(prepare_questions(asked), embedder).where(F.size("vector") == 64).count() == 3


def test_empty_corpus(spark):
    asked = spark.createDataFrame([(1,)], "question_id bigint")
    full = spark.createDataFrame([("a",)], "filename string")
    assert context.empty_corpus_reply(asked, full.limit(0)).count() == 1
    assert context.empty_corpus_reply(asked, full).count() == 0


def test_chunked_search_matches_a_plain_loop(spark):
    """The flagship query, recomputed with dictionaries from the chunks and vectors it used."""
    import math
    import re
    from collections import Counter

    import numpy as np

    from catalog import tables as S
    from catalog.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = QUERIES["chunked_hybrid_search"](spark, folder).collect()
    chunks = {(r.filename, r.chunk_index): r.text for r in S.chunks(spark, folder).collect()}
    stored = {(r.filename, r.chunk_index): np.array(r.vector, dtype="float64") for r in S.chunk_vectors(spark, folder).collect()}
    words = lambda t: re.sub(r"[\W_]+", " ", t.lower()).split()
    counts = {key: Counter(words(f"{key[0]} {key[0]} {text}")) for key, text in chunks.items()}
    sizes = {key: max(sum(c.values()), 1) for key, c in counts.items()}
    mean, n = sum(sizes.values()) / len(sizes), len(sizes)
    df = Counter(w for c in counts.values() for w in c)
    asked = prepare_questions(S.plain_questions(spark, folder))
    want = {}
    for r in embed_questions(asked).collect():
        scores = {}
        terms = {w for w in words(r.question) if len(w) >= 2}
        for key, c in counts.items():
            s = sum(
                math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sizes[key] / mean))
                for w in terms
                if w in c
            )
            if s > 0:
                scores[key] = round(s, 9)
        lexical = [key for key, _ in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]]
        v = np.array(r.vector, dtype="float64")
        near = sorted((float(((v - w) ** 2).sum()), key) for key, w in stored.items())[:20]
        vector = [key for d, key in near if 1 / (1 + d) >= 0.35][:10]
        fused = {}
        for side, hits in enumerate((vector, lexical)):
            for i, key in enumerate(hits):
                fused.setdefault(key, [99, 99])[side] = i
        share = lambda i: 1 / (51 + i) if i < 99 else 0
        order = sorted(fused.items(), key=lambda x: (-(share(x[1][0]) + share(x[1][1])), x[1][0], x[1][1], x[0]))
        want[r.question_id] = [key for key, _ in order[:6]]
    ours = {}
    for r in sorted(got, key=lambda r: (r.question_id, r.final_rank)):
        ours.setdefault(r.question_id, []).append((r.filename, r.chunk_index))
    assert ours == want


def test_a_failed_call_costs_its_own_row(spark):
    from corpusqa.models import batch_embedder, embed_chunks

    def call(texts):
        if (texts == "bad").any():
            raise RuntimeError("cannot embed")
        return texts.map(lambda t: [float(len(t))])

    rows = [(f"f{i}", "bad" if i == 77 else f"text {i}") for i in range(1000)]
    chunks = spark.createDataFrame(rows, "filename string, text string").coalesce(1)
    assert embed_chunks(chunks, batch_embedder(call)).count() == 999


def test_models_get_the_pictures(spark):
    def see(images, hints, names, numbers, totals):
        return images + "|" + hints + "|" + names + "|" + numbers.astype(str) + "/" + totals.astype(str)

    pages = spark.createDataFrame([("f", 1, "hint", "data:1"), ("f", 2, None, "data:2")], "filename string, page_number int, text_hint string, image string")
    seen = {r.page_number: r.text for r in interpret_pages(pages, see).collect()}
    assert seen[1].endswith("data:1|hint|f|1/2") and seen[2].endswith("data:2||f|2/2")

    def answer(prompts, questions, images):
        if (questions == "fail").any():
            raise RuntimeError("no model")
        return prompts + images.map(lambda x: ",".join(x))

    asked = spark.createDataFrame([(1, "q", "p", "c", ["a", "b"]), (2, "fail", "p", "c", [])], "question_id int, question string, prompt string, context string, images array<string>")
    assert {r.question_id: r.answer for r in generate_answers(asked, answer).collect()} == {1: "pa,b", 2: "抱歉，处理您的问题时出现错误: no model"}


def test_texts_are_not_dealt_out_to_be_looked_up(spark):
    """The catalog's chunks used to be shuffled whole before the few that were hit were looked up."""
    from catalog.queries import _chunks

    assert "Exchange" not in _chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
