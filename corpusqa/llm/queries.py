"""One query per operator, over its whole table, and the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op5_simhash_dedup(spark, folder):
    from corpusqa.llm.simhash import simhash_components

    return simhash_components(table(spark, folder, "documents"))


@query
def op6_bpe(spark, folder):
    import public_tokenizers

    from corpusqa.llm.bpe import bpe_encode_decode

    found = bpe_encode_decode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op1_language_id(spark, folder):
    from corpusqa.llm.language import identify_languages

    return identify_languages(table(spark, folder, "documents"))


@query
def op4_quality(spark, folder):
    from corpusqa.llm.quality import score_quality

    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_pii(spark, folder):
    from corpusqa.llm import pii

    found = pii.find_pii(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("pii"), kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.listed(pii.base_spans(F.col("pii"))).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("pii")).alias("spans"),
    )


@query
def op7_decontamination(spark, folder):
    from corpusqa.llm.decontamination import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


# every alignment of words of an item with words of a document, without seeds
ORACLES["op7_decontamination"] = r"""
WITH split_items AS (
  SELECT [w for w in regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') if w <> ''] AS item, min(item_id) AS item_id
  FROM benchmark GROUP BY 1 HAVING len(item) >= 1
), item_words AS (
  SELECT item_id, len(item) AS n, unnest(item) AS word, generate_subscripts(item, 1) - 1 AS item_at FROM split_items
), split_docs AS (
  SELECT doc_id, [w for w in regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') if w <> ''] AS doc FROM documents
), doc_words AS (
  SELECT doc_id, len(doc) AS size, unnest(doc) AS word, generate_subscripts(doc, 1) - 1 AS doc_at FROM split_docs
), equal AS (
  SELECT doc_id, item_id, n, size, doc_at - item_at AS diagonal, item_at FROM doc_words JOIN item_words USING (word)
), crowded AS (
  SELECT * FROM equal QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, diagonal) >= 0.8 * least(15, n)
), windows AS (
  SELECT doc_id, item_id, diagonal, n, size, start, count(*) AS n_equal
  FROM (SELECT *, unnest(range(greatest(0, item_at - least(15, n) + 1), item_at + 1)) AS start FROM crowded)
  WHERE start + least(15, n) <= n AND start + diagonal >= 0 AND start + diagonal + least(15, n) <= size
  GROUP BY ALL
)
SELECT doc_id, item_id, CAST(n_equal AS INTEGER) AS n_equal, CAST(least(15, n) AS INTEGER) AS n_words,
       CAST(start + diagonal AS INTEGER) AS doc_word, CAST(start AS INTEGER) AS item_word
FROM windows WHERE n_equal >= 0.8 * least(15, n)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, start + diagonal, start) = 1
"""


@query
def op3_url_filter(spark, folder):
    from corpusqa.llm.urls import judge_urls, stated_rules

    return judge_urls(table(spark, folder, "pages"), stated_rules(spark))


ORACLES["op3_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) = 1
"""


@query
def op2_lattice_dedup(spark, folder):
    from corpusqa.llm.lattice import link_vectors

    return link_vectors(table(spark, folder, "embeddings"))


ORACLES["op2_lattice_dedup"] = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98
), reached(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a
), components AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM linked l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM components
"""


@query
def op10_html_extraction(spark, folder):
    from corpusqa.llm.extraction import extract_main_text

    found = extract_main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op9_license_scan(spark, folder):
    from corpusqa.llm.licenses import find_licenses

    return find_licenses(table(spark, folder, "documents"), every_template=False)


@query
def op11_sentencepiece(spark, folder):
    import public_tokenizers

    from corpusqa.llm.sentencepieces import encode_decode

    found = encode_decode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op13_merkle_manifest(spark, folder):
    from corpusqa.llm.merkle import manifest, proof_digest

    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit("")))
    found = manifest(table(spark, folder, "documents"), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE marked AS (
  SELECT *, list_reduce(
           flatten([[unicode(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(CAST(doc_id AS VARCHAR), '')]),
           lambda acc, x: CASE WHEN xor(acc, x) & 1 = 1 THEN xor(xor(acc, x) >> 1, 3988292384) ELSE xor(acc, x) >> 1 END,
           4294967295) % 2 = 1 AS even FROM documents
), leaves AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN even AND text IS NOT NULL THEN sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS tampered
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM marked)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes(tree, level, r, n, h) AS (
  SELECT tree, 0, r, n, leaf FROM ranked
  UNION ALL
  SELECT tree, level + 1, r // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY r)) FROM nodes WHERE n > 1 GROUP BY tree, level, r // 3, n
), subroots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS r, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, r, n, h) AS (
  SELECT 0, r, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, r // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY r)) FROM tops WHERE n > 1 GROUP BY level, r // 3, n
), steps AS (
  SELECT tree, level, r,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, r // 3 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, r // 3 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS x
  FROM (SELECT tree, level, r, n, h FROM nodes UNION ALL SELECT NULL, level, r, n, h FROM tops) WHERE n > 1
), inside(id, tree, level, r, cur, proof) AS (
  SELECT id, tree, 0, r, coalesce(tampered, leaf), '' FROM ranked
  UNION ALL
  SELECT id, tree, level + 1, inside.r // 3, sha256(l || cur || x), proof || l || x FROM inside JOIN steps USING (tree, level, r)
), ends AS (
  SELECT id, tree, max_by(cur, level) AS cur, max_by(proof, level) AS proof FROM inside GROUP BY id, tree
), above(id, level, r, cur, proof) AS (
  SELECT id, 0, r, cur, proof FROM ends JOIN subroots USING (tree)
  UNION ALL
  SELECT id, above.level + 1, above.r // 3, sha256(l || cur || x), proof || l || x FROM above JOIN steps ON steps.tree IS NULL AND steps.level = above.level AND steps.r = above.r
), done AS (
  SELECT id, max_by(cur, level) AS cur, max_by(proof, level) AS proof FROM above GROUP BY id
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM ranked JOIN subroots USING (tree) JOIN done USING (id) CROSS JOIN (SELECT h AS root FROM tops WHERE n = 1)
"""


@query
def op12_ranked_search(spark, folder):
    from corpusqa.llm.lemp import search

    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op12_ranked_search"] = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL
), sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id
), totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), norms AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM sizes, totals
), weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term, docs
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM item_terms JOIN tfs USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
