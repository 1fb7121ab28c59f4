"""Substring search of many questions over many chunks, without pairing all of them.

A needle is cut into runs of letters and digits. A run with something else on both sides in the needle is a word of the text as it
stands, so the vocabulary has it or the needle occurs nowhere; a run at the edge of a needle lies inside a word, which is found through shared
stretches of three characters (the index has a table of them). So: needles -> runs -> words -> the run in the fewest
chunks -> chunks that hold it (one pass over the forward index) -> the texts of those chunks, where the needle itself is counted. Every step is an
equi-join, but for needles that are in so many chunks that the index narrows nothing: these are looked for in every text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpusqa.functions.text import contains_all, count_occurrences, store_search_terms
from corpusqa.operators.lexical_index import GRAM, LexicalIndex, term_frequency
from corpusqa.operators.ranking import top_k
from corpusqa.session import materialise

FILENAME_BONUS = 3
ANCHORS = 2  # runs of a needle, or words of a question, that its chunks are tested for
SOUGHT_GRAMS = 2000  # more different stretches than this are met by a join with the whole table of them
SOUGHT_SHORT = 8  # and so are more than this of fewer than three characters, which are beginnings of what the table holds
COMMON = 4  # a run that is met more than this many times per chunk is not looked up: finding a needle in a text takes about as long as so many lookups
_RUN = r"[\p{L}\p{N}]+"
_SOUGHT = ["run", "open_start", "open_end"]


def _tests(needles: DataFrame, index: LexicalIndex) -> DataFrame:
    """(needle, reach, tests): the runs of each needle that a chunk is tested for, rarest first, and in how many (chunk, word) pairs a word can hold the rarest.

    Reaches are summed up as words are found and the words are not kept. A needle with a run that no word holds occurs nowhere and is left out.
    """
    low, n = F.lower("needle"), F.size("runs")
    cut = needles.select("needle", F.regexp_extract_all(low, F.lit(_RUN), F.lit(0)).alias("runs"), low.rlike(rf"\A{_RUN}").alias("from_start"), low.rlike(rf"{_RUN}\z").alias("to_end"))
    inner = F.slice("runs", 1 + F.col("from_start").cast("int"), F.greatest(n - F.col("from_start").cast("int") - F.col("to_end").cast("int"), F.lit(0)))
    cut = cut.where(n > 0).withColumn("whole", F.array_distinct(inner))
    words = cut.select("needle", F.explode("whole").alias("run"), F.lit(False).alias("open_start"), F.lit(False).alias("open_end"))
    words = words.join(index.term_stats.select(F.col("term").alias("run"), F.col("df").alias("reach")), "run", "left")
    # needles of one or two runs, at the edges: words that hold them, end or begin with them
    edges = cut.where(F.size("whole") == 0).select("needle", n.alias("n"), "from_start", "to_end", F.posexplode("runs").alias("at", "run"))
    edges = edges.select("needle", "run", ((F.col("at") == 0) & F.col("from_start")).alias("open_start"), ((F.col("at") == F.col("n") - 1) & F.col("to_end")).alias("open_end"))
    sought = _sought(edges.select(*_SOUGHT).distinct(), index)
    reach = _words(sought, index).groupBy(*_SOUGHT).agg(F.sum("df").alias("reach"))
    edges = edges.join(sought, _SOUGHT).join(reach, _SOUGHT, "left")
    found = words.withColumn("gram", F.lit("")).unionByName(edges)
    found = found.select("needle", F.struct(F.coalesce("reach", F.lit(0)).alias("reach"), *_SOUGHT, "gram").alias("test"))
    tests = found.groupBy("needle").agg(F.slice(F.sort_array(F.collect_list("test")), 1, ANCHORS).alias("tests"))
    tests = tests.select("needle", F.col("tests")[0]["reach"].alias("reach"), "tests")
    return materialise(tests.where(F.col("reach") > 0), "tests")


def _holds(term: Column, run: Column, open_start: Column, open_end: Column) -> Column:
    """Whether a word of the text can be the one around a run: something may stand before or behind the run where it is open."""
    inside = F.contains(term, run) & (open_start | F.startswith(term, run)) & (open_end | F.endswith(term, run))
    return F.when(open_start | open_end, inside).otherwise(term == run)


def _sought(runs: DataFrame, index: LexicalIndex) -> DataFrame:
    """runs(run, open_start, open_end) with the stretch that each is looked up by: of three characters the one that the fewest words hold, or all of a short run."""
    places = F.sequence(F.lit(1), F.length("run") - (GRAM - 1))
    cut = F.when(F.length("run") > GRAM, F.transform(places, lambda at: F.substring("run", at, F.lit(GRAM)))).otherwise(F.array("run"))
    cut = runs.select(*_SOUGHT, F.explode(F.array_distinct(cut)).alias("gram"))
    met = index.grams.select("gram").join(cut.where(F.length("run") > GRAM).select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("met"))
    fewest = F.min(F.struct(F.coalesce("met", F.lit(0)).alias("met"), F.col("gram")))
    return materialise(cut.join(met, "gram", "left").groupBy(*_SOUGHT).agg(fewest["gram"].alias("gram")), "sought")


def _words(sought: DataFrame, index: LexicalIndex) -> DataFrame:
    """sought(run, open_start, open_end, gram) -> (run, open_start, open_end, term, df): all words that can hold a run."""
    sizes = sought.select(F.length("gram").alias("size")).distinct().orderBy("size").collect()  # up to GRAM
    known = [_known(sought, index.grams, r["size"]) for r in sizes] or [index.grams.select("gram", "term", "df")]
    held = _holds(F.col("term"), *map(F.col, _SOUGHT))
    return reduce(DataFrame.unionByName, known).join(sought, "gram").where(held).select(*_SOUGHT, "term", "df")


def _known(sought: DataFrame, grams: DataFrame, size: int) -> DataFrame:
    """(gram, term, df): the stretches of ``size`` characters, once per term that holds it; if few are sought, of their pages only."""
    few = SOUGHT_GRAMS if size == GRAM else SOUGHT_SHORT
    found = [r["gram"] for r in sought.where(F.length("gram") == size).select("gram").distinct().limit(few + 1).collect()]
    if len(found) <= few:
        grams = grams.where(F.col("gram").isin(found) if size == GRAM else reduce(Column.__or__, [F.startswith("gram", F.lit(g)) for g in found]))
    cut = grams.where((F.col("fresh") <= size) & (F.length("gram") >= size))
    return cut.select(F.substring("gram", 1, size).alias("gram"), "term", "df")


def _totals(index: LexicalIndex) -> Row:
    """Totals of an index of whole texts: one without the words inside image blocks would lose matches there."""
    totals = index.corpus_stats.select("hides_images", "n_docs").first()
    if totals["hides_images"]:
        raise ValueError("texts hold image blocks: build the index with strip_images=False for substring search")
    return totals


def _holders(tests: DataFrame, index: LexicalIndex, n_docs: int) -> DataFrame:
    """tests(needle, reach, tests) -> (needle, doc_no): chunks with a word for the rarest run of the needle, some more than once.

    The text decides; looking for a needle there is cheaper than looking up a second run, or a run that is met in nearly every chunk and
    in several words of it: of such a needle every chunk is a holder.
    """
    most = COMMON * n_docs
    common = tests.where(F.col("reach") > most).select("needle")
    rare = materialise(tests.where(F.col("reach") <= most).select("needle", F.inline(F.slice("tests", 1, 1))).drop("reach"), "rare")
    whole = ~F.col("open_start") & ~F.col("open_end")
    terms = rare.where(whole).select("needle", F.col("run").alias("term"))
    edges = rare.where(~whole)
    held = _words(edges.drop("needle").distinct(), index).join(edges, _SOUGHT).select("needle", "term")
    anchors = materialise(terms.unionByName(held), "anchors")
    # a join reads an inverted index whole as well, and that had to be sorted before
    found = term_frequency(index.doc_terms, ["doc_no"]).join(anchors, "term").select("needle", "doc_no")
    return found.unionByName(index.doc_terms.select("doc_no").crossJoin(common).select("needle", "doc_no"))


def _tested(pairs: DataFrame, tests: DataFrame, by: str, index: LexicalIndex) -> DataFrame:
    """Those of ``pairs``(by, doc_no) whose chunk has a word for all ``tests``(by, tests), for chunks that share their key with others.

    A chunk with a key of its own needs no such look, as its text decides.
    """
    key = list(index.key)
    shared = index.doc_terms.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    if shared.isEmpty():
        return pairs
    terms = index.doc_terms.join(shared, key, "left_semi").select("doc_no", "terms")
    held = F.forall("tests", lambda t: F.exists("terms", lambda w: _holds(w["term"], *[t[c] for c in _SOUGHT])))
    met = pairs.join(terms, "doc_no", "left").join(tests.select(by, "tests"), by)
    return met.where(F.col("terms").isNull() | held).select(by, "doc_no")


def _signs(needles: DataFrame, index: LexicalIndex) -> DataFrame:
    """(needle, doc_no): chunks with the first character of needles that have neither letters nor digits."""
    signs = needles.where(~F.col("needle").rlike(_RUN) & (F.length("needle") > 0)).withColumn("sign", F.lower(F.substring("needle", 1, 1)))
    return index.doc_terms.select("doc_no", F.explode("symbols").alias("sign")).join(signs, "sign").select("needle", "doc_no")


def keyword_count_score(questions: DataFrame, chunks: DataFrame, index: LexicalIndex, k: int = 5) -> DataFrame:
    """Best ``k`` chunks per question by how often its keywords occur, ignoring case.

    questions(question_id, keywords) -> (question_id, key…, rank, score, matched_keywords).
    """
    key, n_docs = list(index.key), _totals(index)["n_docs"]
    asked = materialise(
        questions.select("question_id", F.posexplode("keywords").alias("pos", "keyword"))
        .where(F.col("keyword") != "")
        .withColumn("needle", F.lower("keyword")),
        "keywords",
    )
    needles = materialise(asked.select("needle").distinct(), "needles")
    tests = _tests(needles, index)
    pairs = _tested(_holders(tests, index, n_docs), tests, "needle", index).unionByName(_signs(needles, index))
    # as many needles per chunk as may occur in it, put together after the pairs are dealt out: a task that reads the index holds none;
    # written, so that its size is known and the texts stay where they are if it is small
    per_chunk = pairs.repartition("doc_no").groupBy("doc_no").agg(F.collect_set("needle").alias("needles"))
    per_chunk = materialise(index.with_keys(per_chunk), "candidates")
    counted = _counted(chunks, per_chunk, key)
    scored = (
        counted.join(asked, "needle")
        .groupBy("question_id", *key)
        .agg(F.sum("n").alias("score"), F.sort_array(F.collect_list(F.struct("pos", "keyword"))).alias("m"))
        .withColumn("matched_keywords", F.transform("m", lambda s: s["keyword"]))
        .drop("m")
    )
    return top_k(scored, ["question_id"], [F.desc("score"), *[F.asc(c) for c in key]], k)


def _counted(chunks: DataFrame, per_chunk: DataFrame, key: list[str]) -> DataFrame:
    """(key…, needle, n): how often each of a chunk's needles occurs in its text, in lower case; those that do not occur are left out."""
    texts = chunks.select(*key, F.lower("text").alias("lowered"))
    # looking is much cheaper than counting, and most candidates fail here
    held = F.filter("needles", lambda n: F.contains(F.col("lowered"), n))
    found = texts.join(per_chunk, key).select(*key, "lowered", held.alias("held"))
    counts = F.transform("held", lambda n: F.struct(n.alias("needle"), count_occurrences(F.col("lowered"), n).alias("n")))
    return found.select(*key, F.explode(counts).alias("c")).select(*key, "c.*")


def _wanted(questions: DataFrame, index: LexicalIndex, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(question_id, words) of the questions that have any, and (question_id, doc_no) of the chunks that hold the rarest word of one."""
    n_docs = _totals(index)["n_docs"]
    asked = materialise(
        questions.select("question_id", store_search_terms(F.col("question"), most).alias("words")).where(F.size("words") > 0),
        "words",
    )
    spelled = asked.select("question_id", F.explode(F.array_distinct("words")).alias("needle"))
    tests = _tests(spelled.select("needle").distinct(), index)
    reach = spelled.join(tests, "needle", "left").fillna(0, ["reach"])
    words = materialise(top_k(reach, ["question_id"], [F.asc("reach"), F.asc("needle")], ANCHORS, "at"), "rarest")
    # a word the corpus does not contain at all makes the question unanswerable: nothing to read
    rarest = words.where((F.col("at") == 0) & (F.col("reach") > 0)).select("question_id", "needle")
    holders = _holders(tests.join(rarest.select("needle").distinct(), "needle", "left_semi"), index, n_docs).distinct()
    both = words.groupBy("question_id").agg(F.flatten(F.collect_list("tests")).alias("tests"))
    wanted = _tested(holders.join(rarest, "needle").select("question_id", "doc_no"), both, "question_id", index)
    return asked, materialise(wanted, "wanted")


def like_filter(questions: DataFrame, chunks: DataFrame, index: LexicalIndex, most: int | None = None) -> DataFrame:
    """Chunks in which every word of the question occurs, in the text or the file name.

    questions(question_id, question); all words count, or the first ``most``. Matching is case-sensitive against
    lower-cased words. Candidates hold the rarest word of a question.
    """
    asked, wanted = _wanted(questions, index, most)
    return (
        chunks.join(index.with_keys(wanted), list(index.key))
        .join(asked, "question_id")
        .where(contains_all(F.col("words"), F.col("text"), F.col("filename")))
    )


def like_search_score(questions: DataFrame, chunks: DataFrame, index: LexicalIndex, k: int = 8, most: int | None = None) -> DataFrame:
    """Best ``k`` of the chunks that pass ``like_filter``: occurrences, plus 3 per word in the file name.

    All matches are scored, not an arbitrary first few of them. A chunk looks for each word once, however many questions have it.
    """
    key = list(index.key)
    asked, wanted = _wanted(questions, index, most)
    spelled = asked.select("question_id", F.explode("words").alias("needle")).groupBy("question_id", "needle").agg(F.count("*").alias("times"))
    pairs = materialise(wanted.join(spelled, "question_id"), "pairs")
    # few chunks have pairs: their texts are dealt out for the counting, not those of all chunks
    sought = materialise(index.doc_terms.select("doc_no", *key).join(wanted.select("doc_no").distinct(), "doc_no"), "candidates")
    found = chunks.select(*{*key, "filename", "text"}).join(sought, key).select("doc_no", "filename", "text").repartition("doc_no")
    low = F.struct(F.col("text"), F.lower("text").alias("lowered"), F.col("filename"), F.lower("filename").alias("name"))
    per_chunk = pairs.groupBy("doc_no").agg(F.collect_set("needle").alias("needles"))
    texts = found.select("doc_no", low.alias("t")).join(per_chunk, "doc_no")

    def judged(n):
        held = F.contains("t.text", n) | F.contains("t.filename", n)
        bonus = F.when(F.contains("t.name", n), FILENAME_BONUS).otherwise(0)
        return F.struct(n.alias("needle"), F.when(held, count_occurrences(F.col("t.lowered"), n) + bonus).alias("n"))

    counted = texts.select("doc_no", F.explode(F.filter(F.transform("needles", judged), lambda c: c["n"].isNotNull())).alias("c")).select("doc_no", "c.*")
    needed = spelled.groupBy("question_id").agg(F.count("*").alias("held"))
    scored = pairs.join(counted, ["doc_no", "needle"]).groupBy("question_id", "doc_no").agg(F.sum(F.col("n") * F.col("times")).alias("score"), F.count("*").alias("held"))
    matched = index.with_keys(scored.join(needed, ["question_id", "held"], "left_semi").where(F.col("score") > 0).drop("held"))
    return top_k(matched, ["question_id"], [F.desc("score"), *[F.asc(c) for c in key]], k)
