"""SQL counterparts of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from catalog.queries import EXTENSIONS, QUOTA, SMALL_TIERS
from corpusqa.functions.text import CJK, PAGE_FAILURE_NOTICE, TRUNCATION_NOTICE, WHITE_SPACE
from corpusqa.sources.files import ACCEPTED, MAX_FILE_BYTES

ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACES = lit(WHITE_SPACE)
WS = f"[{WHITE_SPACE}]"


def trim(x: str) -> str:
    return f"trim({x}, {SPACES})"


def norm(x: str, images: bool = True) -> str:
    low = f"lower({x})"
    if images:
        low = f"regexp_replace({low}, '(?s)\\[images_data\\].*?\\[/images_data\\]', ' ', 'g')"
    return f"trim(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}{CJK}]+', ' ', 'g'))"


def grams(x: str) -> str:
    two = f"[substring({x}, i, 2) for i in range(1, length({x}))]"
    three = f"[substring({x}, i, 3) for i in range(1, length({x}) - 1)]"
    return f"list_concat({two}, {three})"


def tokens(normal: str) -> str:
    """Token list of an already normalised column."""
    segment = f"CASE WHEN regexp_full_match(s, '[{CJK}]+') THEN list_concat([s], {grams('s')}) ELSE [s] END"
    return f"CASE WHEN {normal} = '' THEN []::VARCHAR[] ELSE flatten([{segment} for s in string_split({normal}, ' ')]) END"


DOCS = "SELECT doc_id, source || '/' || doc_id AS filename, 0 AS chunk_index, source, lang, text FROM documents"
EXTENSION_OF = "list_extract([" + ", ".join(map(lit, EXTENSIONS)) + "], (doc_id % 12 + 1)::INT)"
EMBEDDED = "(SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"

# --- texts -----------------------------------------------------------------------------------------

_raw = "text || ' [IMAGES_DATA][\"' || source || '\"][/IMAGES_DATA] 知识库_' || lang"
ORACLES["normalize_search_text"] = f"SELECT doc_id, {norm(_raw)} AS normalized FROM documents"
ORACLES["normalize_store_text"] = f"SELECT doc_id, {norm(_raw, False)} AS normalized FROM documents"
ORACLES["normalize_ingest_text"] = f"""
SELECT doc_id, {trim("replace(chr(13) || chr(10) || '　' || replace(text, chr(10), chr(13) || chr(10)) || chr(9) || chr(13) || ' ', chr(13), '')")} AS normalized
FROM documents"""
ORACLES["strip_images_data"] = f"""
SELECT conv_id, turn, {trim("regexp_replace(text || '[IMAGES_DATA][' || conv_id || ']' || chr(10) || '[/IMAGES_DATA] tail [IMAGES_DATA][/IMAGES_DATA]' || chr(10), '(?s)\\[IMAGES_DATA\\].*?\\[/IMAGES_DATA\\]', '', 'g')")} AS stripped
FROM conversations"""
ORACLES["extract_images_data"] = """
SELECT conv_id, turn,
  CASE WHEN role <> 'user' AND turn % 3 <> 2 THEN text || chr(10) || ' tail'
       ELSE text || chr(10) || '[IMAGES_DATA]' || CASE WHEN turn % 3 = 2 THEN '[oops' ELSE '["img' || turn || '.png","b.png"]' END
            || '[/IMAGES_DATA] tail' END AS text,
  CASE WHEN role <> 'user' AND turn % 3 <> 2 THEN 'img' || turn || '.png|b.png' ELSE '' END AS images
FROM conversations"""
ORACLES["repair_filename"] = "SELECT doc_id, '文档-é-' || source || '/' || doc_id || '.md' AS repaired FROM documents"
ORACLES["file_extension"] = f"SELECT doc_id, lower({EXTENSION_OF}) AS extension FROM documents"
ORACLES["unique_terms"] = f"""
WITH parts AS (SELECT doc_id, regexp_split_to_array(text, '[,.\\n]') AS p FROM documents),
 terms AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS raw FROM parts),
 clean AS (SELECT doc_id, {norm('raw')} AS term, pos FROM terms),
 firsts AS (SELECT doc_id, term, min(pos) AS pos FROM clean WHERE term <> '' GROUP BY doc_id, term)
SELECT d.doc_id, coalesce(string_agg(term, '|' ORDER BY pos), '') AS terms, count(term)::INT AS n_terms
FROM documents d LEFT JOIN firsts f USING (doc_id) GROUP BY d.doc_id"""
ORACLES["tokenize"] = f"""
WITH n AS (SELECT doc_id, {norm("text || ' 知识库助手 你好 ' || source || '/' || doc_id")} AS n FROM documents),
 t AS (SELECT doc_id, {tokens('n')} AS t FROM n)
SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t)::INT AS n_tokens FROM t"""

KEYWORDS = f"[{trim('k')} for k in regexp_split_to_array(text, '[,，、]') if {trim('k')} <> '']"
BREAKS = lit(f"[{WHITE_SPACE},，。！？、；：/]+")


def search_terms(question: str, rewritten: str, keywords: str) -> str:
    """CTEs ending in qterms(question_id, term, pos): the terms each question is searched with."""
    base = f"""flatten([{keywords}, [{question}, {rewritten}], regexp_split_to_array({question}, {BREAKS}), regexp_split_to_array({rewritten}, {BREAKS})])"""
    derived = f"CASE WHEN regexp_full_match(term, '[{CJK}]{{4,8}}') THEN list_concat([term], {grams('term')}) ELSE [term] END"
    return f"""qbase AS (SELECT item_id AS question_id, {base} AS b FROM benchmark),
 qraw AS (SELECT question_id, generate_subscripts(b, 1) AS pos, unnest(b) AS raw FROM qbase),
 qclean AS (SELECT question_id, {norm('raw')} AS term, pos FROM qraw),
 qnorm AS (SELECT question_id, term, min(pos) AS pos FROM qclean WHERE term <> '' GROUP BY question_id, term),
 qlist AS (SELECT question_id, pos, {derived} AS d FROM qnorm),
 qderived AS (SELECT question_id, pos, generate_subscripts(d, 1) AS sub, unnest(d) AS term FROM qlist),
 qterms AS (SELECT question_id, term, min(pos * 1000 + sub) AS pos FROM qderived WHERE length(term) >= 2 GROUP BY ALL)"""


ORACLES["build_search_terms"] = f"""
WITH {search_terms("text || ' 知识库助手怎么用？ 助手'", 'text', KEYWORDS)}
SELECT question_id, string_agg(term, '|' ORDER BY pos) AS terms, count(*)::INT AS n_terms FROM qterms GROUP BY question_id"""
_occ = lambda t: f"((length(lower(text)) - length(replace(lower(text), {t}, ''))) // length({t}))::BIGINT"
ORACLES["count_occurrences"] = f"""
SELECT doc_id, {_occ("'en'")} AS en, {_occ("'the '")} AS the, {_occ('lang')} AS own, 0::BIGINT AS blank FROM documents"""
ORACLES["parse_keyword_list"] = f"""
WITH k AS (SELECT item_id, {KEYWORDS} AS k FROM (SELECT item_id, text || '，重点、 ,x' AS text FROM benchmark))
SELECT item_id, array_to_string(k, '|') AS keywords, len(k)::INT AS n FROM k"""
ORACLES["parse_score"] = f"""
WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN ' ' || (turn * 3 - 4) || '.25/10 ' || text
    WHEN turn % 2 = 0 THEN text ELSE '+.' || (turn + 1) || 'e1分' END AS reply FROM conversations)
SELECT conv_id, turn, greatest(0.0::DOUBLE, least(10.0::DOUBLE, coalesce(try_cast(regexp_extract(reply,
  '^[ \\t\\n]*([+-]?(?:[0-9]+\\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\\.[0-9]+(?:[eE][+-]?[0-9]+)?))', 1) AS DOUBLE), 5.0::DOUBLE))) AS score FROM r"""
ORACLES["truncate_text"] = """
SELECT doc_id, substring(text, 1, 800) AS excerpt, length(substring(text, 1, 1800))::INT AS n_hint FROM documents"""
ORACLES["truncate_with_notice"] = f"""
SELECT doc_id, CASE WHEN length(text) > 1500 THEN substring(text, 1, 1500) || {lit(TRUNCATION_NOTICE)} ELSE text END AS kept FROM documents"""
ORACLES["strip_code_fence"] = f"""
SELECT conv_id, turn, {trim('''CASE turn % 4 WHEN 0 THEN chr(10) || text || chr(10) WHEN 1 THEN text WHEN 2 THEN text || chr(10) || '```'
  ELSE text || ' ```x``` in the middle ' END''')} AS plain FROM conversations"""

# --- files, pages, tables --------------------------------------------------------------------------

ORACLES["accept_files"] = f"""
WITH f AS (SELECT doc_id, '/up/' || source || '/' || doc_id || {EXTENSION_OF} AS path, lower({EXTENSION_OF}) AS ext,
  (length(text) * 10000)::BIGINT AS length FROM documents)
SELECT doc_id, path, length, CASE WHEN ext NOT IN ({", ".join(map(lit, ACCEPTED))}) THEN '不支持的文件类型: ' || ext
  WHEN length > {MAX_FILE_BYTES} THEN 'File too large' END AS rejected_reason FROM f"""
ORACLES["read_documents"] = "SELECT doc_id, '.txt' AS extension, doc_id || chr(10) || text || chr(10) AS text FROM documents"
ORACLES["read_csv_as_text"] = """
SELECT c_nationkey::INT AS nation, chr(10) || '--- 表格: Sheet1 ---' || chr(10)
  || string_agg(c_custkey || ',' || c_name || ',' || c_mktsegment, chr(10) ORDER BY c_custkey) || chr(10) || chr(10) AS text FROM customer GROUP BY c_nationkey"""
ORACLES["flag_oversize_images"] = """
SELECT doc_id, ceil(length(base64(encode(text))) * 3 / 4) > 4096 AS oversize FROM documents"""
ORACLES["image_data_url"] = """
SELECT doc_id, 'data:' || CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' ELSE 'image/jpeg' END
  || ';base64,' || base64(encode(text)) AS url FROM documents"""

PAGED = f"""docs AS ({DOCS}),
 raw_lines AS (SELECT filename, generate_subscripts(l, 1) AS line_no, {trim('unnest(l)')} AS line FROM
   (SELECT filename, string_split(CASE WHEN {trim('text')} = '' THEN '空文档' ELSE {trim('text')} END, chr(10)) AS l FROM docs)),
 cut AS (SELECT filename, line_no, CASE WHEN line = '' THEN [''] ELSE regexp_extract_all(line, '(?s).{{1,42}}') END AS c FROM raw_lines),
 pieces AS (SELECT filename, line_no, generate_subscripts(c, 1) AS sub, unnest(c) AS piece FROM cut),
 placed AS (SELECT filename, piece, row_number() OVER (PARTITION BY filename ORDER BY line_no, sub) - 1 AS n FROM pieces),
 pages_ AS (SELECT filename, (n // 42 + 1)::INT AS page_number, string_agg(piece, chr(10) ORDER BY n) AS text_hint FROM placed GROUP BY ALL)"""
ORACLES["paginate_text"] = f"WITH {PAGED} SELECT filename, page_number, text_hint FROM pages_"
ORACLES["assemble_pages"] = f"""
WITH {PAGED} SELECT filename, string_agg('第 ' || page_number || ' 页' || chr(10) || text_hint, chr(10) || chr(10) ORDER BY page_number) AS text,
 count(*) AS n_pages FROM pages_ GROUP BY filename"""
_title = "'# ' || filename || ' - 第 ' || page_number || ' 页多模态解读' || chr(10) || chr(10)"
ORACLES["interpret_pages"] = f"""
WITH {PAGED} SELECT filename, string_agg({_title} || text_hint, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_number) AS text,
 count(*) AS n_pages FROM pages_ GROUP BY filename"""
ORACLES["page_heading_text"] = f"""
WITH {PAGED} SELECT filename, page_number, {_title} || CASE WHEN page_number % 2 = 1 THEN text_hint ELSE
 '【页面摘要】' || chr(10) || CASE WHEN page_number % 4 <> 0 AND text_hint <> '' THEN text_hint ELSE {lit(PAGE_FAILURE_NOTICE)} END
 || chr(10) || chr(10) || '【图表/表格/截图解读】' || chr(10) || '视觉模型调用失败。' || chr(10) || chr(10) || '【关键数据】' || chr(10) || '请参考页面文本候选。' END AS text
FROM pages_"""
ORACLES["renumber_pages"] = f"""
WITH {PAGED}, last AS (SELECT filename, max(page_number) AS n FROM pages_ GROUP BY filename)
SELECT filename, page_number, text_hint FROM pages_ UNION ALL
SELECT filename, (n + row_number() OVER (PARTITION BY filename ORDER BY page_number))::INT, 'DOCX 内嵌图片'
FROM pages_ JOIN last USING (filename) WHERE page_number % 2 = 1"""
ORACLES["table_to_documents"] = """
WITH n AS (SELECT o_orderstatus AS filename, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS spot,
   o_orderkey || ',' || o_orderpriority || ',' || o_custkey AS line FROM orders)
SELECT filename, (spot // 1000)::INT AS part, chr(10) || '--- 表格: ' || filename || ' ---' || chr(10) || 'o_orderkey,o_orderpriority,o_custkey' || chr(10)
  || string_agg(line, chr(10) ORDER BY spot) || chr(10) AS text, count(*) AS n_rows FROM n GROUP BY filename, spot // 1000"""

# --- chunking --------------------------------------------------------------------------------------

MARKDOWN = f"""md AS (SELECT doc_id, filename, source, '# ' || source || E'\\n\\n' || replace(text, E'\\n', E'\\n \\t\\n') || E'\\n\\n## Facts of ' || doc_id
 || E'\\n\\n| name | value |\\n|---|---|\\n| number | ' || doc_id || E' |\\n| language | ' || lang || E' |\\n| length | ' || length(text)
 || E' |\\n\\n- from ' || source || E'\\n- in ' || lang || E'\\n\\n1.1 Notes on ' || doc_id || E'\\n\\nShort note.\\n\\n第一章 概述\\n\\n【摘要】 ' || filename
 || E'\\n继续\\n\\n1. one\\n\\n\\n# End\\n\\nThat was document ' || doc_id || E'.\\n' AS text FROM ({DOCS}))"""


def paragraphs(source: str, text: str = "text", carry: str = "doc_id") -> str:
    """CTE paras(carry, para_pos, content)."""
    return f"""para_lists AS (SELECT {carry}, [{trim('p')} for p in regexp_split_to_array({text}, {lit(chr(10) + WS + "*" + chr(10))}) if {trim('p')} <> ''] AS l FROM {source}),
 paras AS (SELECT {carry}, generate_subscripts(l, 1) - 1 AS para_pos, unnest(l) AS content FROM para_lists)"""


CLASSES = f"""CASE WHEN regexp_matches(content, '^\\|[^\\n]+\\|') THEN 'table'
 WHEN regexp_matches(content, {lit(f"^(?:[0-9]+[.、]|[*]|[-•▪▸]){WS}+")}) THEN 'list'
 WHEN regexp_matches(content, {lit(f"^#{{1,6}}{WS}+(?s:.)")}) OR regexp_matches(content, '^[{CJK}]+[章节条点](?s:.)')
   OR regexp_full_match(content, '[0-9]+[.、][{CJK}a-zA-Z0-9][^\\n]*') THEN 'heading'
 WHEN length(content) > 50 OR contains(content, chr(10)) THEN 'paragraph' ELSE 'other' END"""
HEADINGS = f"""coalesce({trim(f"nullif(regexp_extract(content, {lit(f'^#{{1,6}}{WS}+([^{chr(10)}]+)')}, 1), '')")},
 {trim(f"nullif(regexp_extract(content, '^[{CJK}]+[章节条点](?s:.)+', 0), '')")},
 {trim(f"nullif(regexp_extract(content, '^[0-9]+[.、][{CJK}a-zA-Z0-9][^\\n]*', 0), '')")},
 {trim("nullif(regexp_extract(content, '^【([^\\n]+?)】', 1), '')")})"""


def segmented(documents: str) -> str:
    """CTEs after md(doc_id, filename, text), up to chained(doc_id, para_pos, content, seg_type, title, chain)."""
    return f"""{documents}, {paragraphs('md')},
 segs AS (SELECT *, {CLASSES} AS seg_type, {HEADINGS} AS title FROM paras),
 chained AS (SELECT *, coalesce(string_agg(CASE WHEN seg_type = 'heading' THEN title END, ' › ') OVER (PARTITION BY doc_id ORDER BY para_pos
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS chain FROM segs)"""


SEGMENTS = segmented(MARKDOWN)
ORACLES["split_paragraphs"] = f"WITH {MARKDOWN}, {paragraphs('md')} SELECT doc_id, para_pos::INT AS para_pos, content FROM paras"
ORACLES["classify_segment"] = f"WITH {SEGMENTS} SELECT doc_id, para_pos::INT AS para_pos, seg_type FROM segs"
ORACLES["parse_heading"] = f"WITH {SEGMENTS} SELECT doc_id, para_pos::INT AS para_pos, title AS heading FROM segs WHERE title IS NOT NULL"
ORACLES["heading_chain"] = f"WITH {SEGMENTS} SELECT doc_id, para_pos::INT AS para_pos, chain FROM chained"
ORACLES["chunk_text_with_headings"] = f"""WITH {SEGMENTS}
SELECT doc_id, para_pos::INT AS para_pos, CASE WHEN chain = '' THEN content ELSE '[' || chain || ']' || chr(10) || content END AS text FROM chained"""


def greedy(source: str, key: str) -> str:
    """CTE packed(key, n, content): sentences of source(key, content) re-joined up to 800 characters."""
    return f"""sent AS (SELECT {key}, [s for s in string_split(regexp_replace(content, {lit(f"([。！？.!?]){WS}*")}, '\\1' || chr(1), 'g'), chr(1)) if {trim('s')} <> ''] AS s
   FROM {source}),
 fold AS (SELECT {key}, s, 1 AS i, '' AS cur, NULL::VARCHAR AS emitted FROM sent UNION ALL
   SELECT {key}, s, i + 1, CASE WHEN length(cur || s[i]) <= 800 THEN cur || s[i] ELSE s[i] END,
     CASE WHEN length(cur || s[i]) > 800 THEN cur END FROM fold WHERE i <= len(s)),
 emitted AS (SELECT {key}, i, {trim('emitted')} AS content FROM fold WHERE emitted IS NOT NULL
   UNION ALL SELECT {key}, i + 1, {trim('cur')} FROM fold WHERE i = len(s) + 1),
 packed AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS n, content FROM emitted WHERE content <> '')"""


ORACLES["split_sentences"] = f"""WITH RECURSIVE texts AS (SELECT doc_id, {trim("replace(text, chr(13), '')")} AS content FROM documents), {greedy('texts', 'doc_id')}
SELECT doc_id, n::INT AS piece, content FROM packed"""
ORACLES["min_chunk_length"] = f"""
WITH l AS (SELECT doc_id, regexp_split_to_array(text, '[.\\n]') AS l FROM documents),
 p AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS piece, unnest(l) AS content FROM l)
SELECT * FROM p WHERE length({trim('content')}) > 10"""


def row_groups(source: str, key: str) -> str:
    """CTE grouped(key, n, content): lines of source(key, content) in groups of up to 1000 characters, each under the first line."""
    return f"""tlines AS (SELECT {key}, string_split(content, chr(10)) AS l FROM {source}),
 tfold AS (SELECT {key}, l, 2 AS i, '' AS cur, length(l[1]) AS size, NULL::VARCHAR AS emitted FROM tlines UNION ALL
  SELECT {key}, l, i + 1, CASE WHEN size + length(l[i]) > 1000 AND cur <> '' THEN chr(10) || l[i] ELSE cur || chr(10) || l[i] END,
   CASE WHEN size + length(l[i]) > 1000 AND cur <> '' THEN length(l[1]) + length(l[i]) ELSE size + length(l[i]) END,
   CASE WHEN size + length(l[i]) > 1000 AND cur <> '' THEN l[1] || cur END FROM tfold WHERE i <= len(l)),
 tcut AS (SELECT {key}, i, {trim('emitted')} AS content FROM tfold WHERE emitted IS NOT NULL UNION ALL
  SELECT {key}, i + 1, {trim('l[1] || cur')} FROM tfold WHERE i = len(l) + 1),
 grouped AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS n, content FROM tcut)"""


ORACLES["split_table"] = f"""
WITH RECURSIVE t AS (SELECT doc_id, '| sentence |' || chr(10) || '| ' || replace(replace(text, chr(10), ' '), '. ', '. |' || chr(10) || '| ') || ' |' AS content
  FROM documents), {row_groups('t', 'doc_id')}
SELECT doc_id, n::INT AS piece, content FROM grouped"""


def packing(segments: str) -> str:
    """CTEs after segs(doc_id, para_pos, content, seg_type, chain), up to blocks(doc_id, at, sub, content, seg_type, chain)."""
    return f"""{segments},
 walk AS (SELECT *, seg_type IN ('heading', 'table', 'list') OR length(content) > 800 AS hard FROM chained),
 lists AS (SELECT doc_id, list(struct_pack(c := content, hard := hard, chain := chain) ORDER BY para_pos) AS s FROM walk GROUP BY doc_id),
 steps AS (SELECT doc_id, s, 1 AS i, '' AS cur, NULL::VARCHAR AS out FROM lists UNION ALL
  SELECT doc_id, s, i + 1,
   CASE WHEN s[i].hard THEN '' WHEN cur = '' THEN s[i].c WHEN length(cur) + 2 + length(s[i].c) <= 800 THEN cur || chr(10) || chr(10) || s[i].c ELSE s[i].c END,
   CASE WHEN cur <> '' AND (s[i].hard OR length(cur) + 2 + length(s[i].c) > 800) THEN cur END
  FROM steps WHERE i <= len(s)),
 flushed AS (SELECT doc_id, i - 2 AS spot, 0 AS sub, out AS content, 'paragraph' AS seg_type, s[i - 1].chain AS chain FROM steps WHERE out IS NOT NULL UNION ALL
  SELECT doc_id, i - 1, 0, cur, 'paragraph', NULL FROM steps WHERE i = len(s) + 1 AND cur <> ''),
 long AS (SELECT doc_id * 100000 + para_pos AS key, content FROM walk WHERE hard AND seg_type NOT IN ('heading', 'table', 'list')),
 {greedy('long', 'key')},
 rowed AS (SELECT doc_id * 100000 + para_pos AS key, content FROM walk WHERE seg_type IN ('table', 'list')),
 {row_groups('rowed', 'key')},
 blocks AS (SELECT doc_id, spot, sub, content, seg_type, chain FROM flushed UNION ALL
  SELECT doc_id, para_pos, 1, content, seg_type, chain FROM walk WHERE seg_type = 'heading' UNION ALL
  SELECT doc_id, para_pos, 1 + n, g.content, seg_type, chain FROM grouped g JOIN walk ON key = doc_id * 100000 + para_pos UNION ALL
  SELECT key // 100000, key % 100000, 1 + n, content, 'paragraph', NULL FROM packed)"""


_spaced = f"""spaced AS (SELECT doc_id, replace({trim("replace(text, chr(13), '')")}, chr(10), chr(10) || chr(10)) AS text FROM documents), {paragraphs('spaced')},
 segs AS (SELECT *, {CLASSES} AS seg_type FROM paras), chained AS (SELECT *, '' AS chain FROM segs)"""
ORACLES["pack_paragraphs"] = f"""WITH RECURSIVE {packing(_spaced)}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY spot, sub) - 1)::INT AS piece, content, seg_type FROM blocks WHERE length(content) > 10"""


def chunked(documents: str) -> str:
    """WITH clause after md(doc_id, filename, text), up to numbered(doc_id, chunk_index, seg_type, text)."""
    return f"""WITH RECURSIVE {packing(segmented(documents))},
 spelled AS (SELECT b.doc_id, spot, sub, b.content, b.seg_type, coalesce(b.chain, c.chain, (SELECT max_by(chain, para_pos) FROM chained z WHERE z.doc_id = b.doc_id)) AS chain
   FROM blocks b LEFT JOIN chained c ON c.doc_id = b.doc_id AND c.para_pos = b.spot),
 numbered AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY spot, sub) - 1)::INT AS chunk_index, seg_type,
  CASE WHEN chain = '' THEN content ELSE '[' || chain || ']' || chr(10) || content END AS text FROM spelled WHERE length(content) > 10)"""


_chunked = chunked(MARKDOWN)
ORACLES["semantic_chunk"] = f"{_chunked} SELECT * FROM numbered"
_given = "coalesce(nullif(text, ''), '[空块]')"
ORACLES["new_content_only"] = f"""WITH known AS (SELECT {_given} AS t FROM conversations UNION SELECT {_given} FROM documents WHERE lang = 'en'),
 asked AS (SELECT DISTINCT {_given} AS t, coalesce(length(text), 0) AS n_chars FROM documents)
SELECT sha256(t) AS content, n_chars FROM asked WHERE t NOT IN (SELECT t FROM known)"""
ORACLES["ingest_documents"] = f"{_chunked} SELECT filename, chunk_index, 'text' AS type, n.text FROM numbered n JOIN md USING (doc_id)"
ORACLES["stream_ingest"] = f"{_chunked} SELECT filename, chunk_index, n.text FROM numbered n JOIN md USING (doc_id)"
ORACLES["number_chunks"] = f"""WITH {MARKDOWN}, {paragraphs('md', carry='filename')}, {PAGED},
 counts AS (SELECT filename, count(*) AS n FROM paras GROUP BY filename)
SELECT filename, page_number, (n + page_number - 1)::INT AS chunk_index FROM pages_ JOIN counts USING (filename)"""
# of the separators only the line break occurs in these texts
ORACLES["recursive_split"] = f"""
WITH RECURSIVE p AS (SELECT doc_id, [x for x in string_split(replace(text, chr(10), chr(1) || chr(10)), chr(1)) if x <> ''] AS l FROM documents WHERE length(text) > 1000),
 fold AS (SELECT doc_id, l, 1 AS i, []::VARCHAR[] AS win, []::VARCHAR[] AS out FROM p UNION ALL
  SELECT doc_id, l, i + 1, CASE WHEN length(l[i]) >= 2000 THEN [] WHEN len(win) > 0 AND coalesce(list_sum([length(w) for w in win]), 0) + length(l[i]) > 2000
     THEN list_append(win[list_min([j for j in range(1, len(win) + 2) if coalesce(list_sum([length(w) for w in win[j:]]), 0) <= least(150, 2000 - length(l[i]))]):], l[i])
     ELSE list_append(win, l[i]) END,
   CASE WHEN length(l[i]) >= 2000 THEN [{trim("array_to_string(win, '')")}, l[i]]
     WHEN len(win) > 0 AND coalesce(list_sum([length(w) for w in win]), 0) + length(l[i]) > 2000 THEN [{trim("array_to_string(win, '')")}] ELSE [] END
  FROM fold WHERE i <= len(l)),
 told AS (SELECT doc_id, i, generate_subscripts(out, 1) AS sub, unnest(out) AS content FROM fold UNION ALL
  SELECT doc_id, i + 1, 1, {trim("array_to_string(win, '')")} FROM fold WHERE i = len(l) + 1 UNION ALL
  SELECT doc_id, 1, 1, text FROM documents WHERE length(text) <= 1000)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, sub) - 1)::INT AS piece, content FROM told WHERE content <> ''"""
ORACLES["emit_page_chunks"] = f"""WITH {MARKDOWN}, {paragraphs('md', carry='filename')}, {PAGED},
 counts AS (SELECT filename, count(*) AS n FROM paras GROUP BY filename)
SELECT filename, para_pos::INT AS chunk_index, 'text' AS type, content AS text FROM paras UNION ALL
SELECT filename, (n + page_number - 1)::INT, 'page', text_hint FROM pages_ JOIN counts USING (filename)"""
_seen = f"""{PAGED}, seen AS (SELECT filename, page_number, {_title} || text_hint AS text FROM pages_),
 joined AS (SELECT filename, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_number) AS text FROM seen GROUP BY filename),
 md AS (SELECT doc_id, filename, {trim("replace(j.text, chr(13), '')")} AS text FROM joined j JOIN docs USING (filename))"""
ORACLES["chunk_pages"] = f"""{chunked(_seen)}, texts AS (SELECT filename, chunk_index, n.text FROM numbered n JOIN md USING (doc_id)),
 counts AS (SELECT filename, count(*) AS n FROM texts GROUP BY filename)
SELECT filename, chunk_index, 'text' AS type, text FROM texts UNION ALL
SELECT filename, (coalesce(n, 0) + page_number - 1)::INT, 'page', text FROM seen LEFT JOIN counts USING (filename)"""

# --- lexical search --------------------------------------------------------------------------------

POSTINGS = f"""docs AS ({DOCS}),
 normal AS (SELECT filename, chunk_index, {norm("filename || ' ' || filename || ' ' || text")} AS n FROM docs),
 tokened AS (SELECT filename, chunk_index, {tokens('n')} AS t FROM normal),
 lens AS (SELECT filename, chunk_index, greatest(len(t), 1)::INT AS doc_len FROM tokened),
 post AS (SELECT filename, chunk_index, term, count(*)::INT AS tf FROM (SELECT filename, chunk_index, unnest(t) AS term FROM tokened) GROUP BY ALL),
 stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM lens),
 dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def matches(question: str = "text", keywords: str = KEYWORDS) -> str:
    return f"""{POSTINGS}, {search_terms(question, question, keywords)},
 matched AS (SELECT question_id, filename, chunk_index, q.term, q.pos, tf, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5
   / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len)) AS weight
   FROM qterms q JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (filename, chunk_index) CROSS JOIN stats),
 scored AS (SELECT question_id, filename, chunk_index, sum(weight) AS score, string_agg(term, '|' ORDER BY pos) AS matched_terms FROM matched GROUP BY ALL),
 lexical AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, filename, chunk_index) - 1 AS rank FROM scored)"""


ORACLES["term_frequency"] = f"WITH {POSTINGS} SELECT filename, chunk_index, term, tf FROM post"
ORACLES["doc_length"] = f"WITH {POSTINGS} SELECT filename, chunk_index, doc_len FROM lens"
ORACLES["document_frequency"] = f"WITH {POSTINGS} SELECT term, df FROM dfs"
ORACLES["corpus_stats"] = f"WITH {POSTINGS} SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats"
ORACLES["bm25_match"] = f"""WITH {matches()}
SELECT question_id, term, count(*) AS n_chunks, sum(tf)::BIGINT AS sum_tf, round(sum(weight), 6) AS sum_weight FROM matched GROUP BY ALL"""
ORACLES["bm25_score"] = f"""WITH {matches()}
SELECT question_id, count(*) AS n_hits, round(max(score), 6) AS best, round(sum(score), 6) AS total FROM scored GROUP BY ALL"""
ORACLES["bm25_search"] = f"""WITH {matches()}
SELECT question_id, filename, chunk_index, rank::INT AS rank, round(score, 6) AS score, matched_terms FROM lexical WHERE rank < 10"""
ORACLES["rank_hits"] = f"""WITH {matches()}
SELECT question_id, filename, (row_number() OVER (PARTITION BY question_id ORDER BY round(score, 1) DESC, filename) - 1)::INT AS rank FROM lexical WHERE rank < 20"""
ORACLES["keyword_count_score"] = f"""WITH docs AS ({DOCS}),
 k AS (SELECT item_id AS question_id, {KEYWORDS} AS k FROM benchmark),
 kw AS (SELECT question_id, generate_subscripts(k, 1) AS pos, unnest(k) AS keyword FROM k),
 hit AS (SELECT question_id, filename, pos, keyword, (length(lower(text)) - length(replace(lower(text), lower(keyword), ''))) // length(lower(keyword)) AS n
   FROM kw JOIN docs ON contains(lower(text), lower(keyword))),
 s AS (SELECT question_id, filename, sum(n)::BIGINT AS score, string_agg(keyword, '|' ORDER BY pos) AS matched_keywords FROM hit GROUP BY ALL)
SELECT question_id, filename, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, filename) - 1)::INT AS rank, score, matched_keywords
FROM s QUALIFY rank < 5"""
def liked(words: str) -> str:
    return f"""docs AS ({DOCS}),
 words AS (SELECT item_id AS question_id, [w for w in string_split({norm('text', False)}, ' ') if length(w) >= 2]{words} AS w FROM benchmark),
 liked AS (SELECT question_id, filename, chunk_index, text, w FROM words JOIN docs ON len(w) > 0
   AND len([x for x in w if contains(text, x) OR contains(filename, x)]) = len(w))"""


ORACLES["like_filter"] = f"WITH {liked('[1:3]')} SELECT question_id, filename FROM liked"
ORACLES["like_search_score"] = f"""WITH {liked('')},
 s AS (SELECT question_id, filename, list_sum([(length(lower(text)) - length(replace(lower(text), x, ''))) // length(x) + CASE WHEN contains(lower(filename), x) THEN 3 ELSE 0 END
   for x in w])::BIGINT AS score FROM liked)
SELECT question_id, filename, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, filename) - 1)::INT AS rank, score FROM s WHERE score > 0 QUALIFY rank < 8"""

# --- vector search ---------------------------------------------------------------------------------

_square = "list_sum([x * x for x in v])"


def distance(a: str, b: str) -> str:
    return f"list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip({a}, {b})])"


KNN = f"""e AS {EMBEDDED},
 d AS (SELECT a.vec_id AS question_id, 'v' || b.vec_id AS filename, {distance('a.v', 'b.v')} AS distance FROM e a CROSS JOIN e b),
 near AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, filename) - 1 AS rank FROM d QUALIFY rank < 20)"""
ORACLES["vector_dimension"] = """
SELECT min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim, count(*) AS n_vectors FROM embeddings"""
ORACLES["similarity_from_distance"] = f"""
SELECT vec_id, round(1 / (1 + {_square} * label), 6) AS similarity FROM (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"""
ORACLES["knn_pairs"] = f"WITH {KNN} SELECT question_id, filename, rank::INT AS rank, round(distance, 6) AS distance FROM near"
ORACLES["similarity_filter"] = f"""WITH {KNN}
SELECT question_id, filename, rank::INT AS rank, round(1 / (1 + distance), 6) AS similarity FROM near WHERE 1 / (1 + distance) >= 0.35"""
ORACLES["vector_search"] = f"""WITH {KNN}
SELECT question_id, filename, 0 AS chunk_index, rank::INT AS rank, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity
FROM near WHERE 1 / (1 + distance) >= 0.35 AND rank < 10"""
ORACLES["vector_search_approx"] = f"""WITH {KNN}
SELECT question_id, filename, rank::INT AS rank, round(1 / (1 + distance), 6) AS similarity FROM near WHERE 1 / (1 + distance) >= 0.35 AND rank < 10"""
ORACLES["vector_search_recall"] = f"""WITH {KNN}
SELECT count(*) AS n_hits, true AS enough FROM near WHERE 1 / (1 + distance) >= 0.35 AND rank < 10"""
ORACLES["embed_chunks"] = "SELECT doc_id, 64 AS dimension, 1.0::DOUBLE AS length FROM documents"
ORACLES["count_skipped"] = """
SELECT count(vec_id) AS embedded, count(*) - count(vec_id) AS skipped FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""

# --- fusion, reranking, answers --------------------------------------------------------------------

FUSED = f"""{matches(keywords='[]::VARCHAR[]')}, e AS {EMBEDDED},
 vd AS (SELECT b.item_id AS question_id, source || '/' || doc_id AS filename, {distance('q.v', 's.v')} AS distance
   FROM benchmark b JOIN e q ON q.vec_id = b.item_id CROSS JOIN (SELECT doc_id, source, v FROM documents JOIN e ON vec_id = doc_id) s),
 vector AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, filename) - 1 AS rank FROM vd QUALIFY rank < 10),
 merged AS (SELECT coalesce(v.question_id, b.question_id) AS question_id, coalesce(v.filename, b.filename) AS filename,
    v.rank::INT AS vector_rank, b.rank::INT AS bm25_rank, coalesce(b.score, 0) AS bm25_score
   FROM (SELECT * FROM vector WHERE 1 / (1 + distance) >= 0.35) v FULL OUTER JOIN (SELECT * FROM lexical WHERE rank < 10) b
   ON v.question_id = b.question_id AND v.filename = b.filename),
 fused AS (SELECT *, coalesce(1.0::DOUBLE / (51 + vector_rank), 0) AS vector_score,
   coalesce(1.0::DOUBLE / (51 + vector_rank), 0) + coalesce(1.0::DOUBLE / (51 + bm25_rank), 0) AS rrf_score FROM merged),
 top12 AS (SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY rrf_score DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, filename) - 1)::INT AS fused_rank
   FROM fused QUALIFY fused_rank < 12)"""
ORACLES["rrf_merge"] = f"WITH {FUSED} SELECT question_id, filename, vector_rank, bm25_rank, round(bm25_score, 6) AS bm25_score FROM merged"
ORACLES["rrf_score"] = f"WITH {FUSED} SELECT question_id, filename, round(vector_score, 6) AS vector_score, round(rrf_score, 6) AS rrf_score FROM fused"
ORACLES["rrf_topk"] = f"WITH {FUSED} SELECT question_id, filename, fused_rank, round(rrf_score, 6) AS rrf_score FROM top12"
RERANKED = f"""{FUSED},
 pair AS (SELECT t.*, d.doc_id, d.text, {norm('b.text')} AS qn, {norm('d.text')} AS dn
   FROM top12 t JOIN docs d USING (filename) JOIN benchmark b ON b.item_id = t.question_id),
 lists AS (SELECT *, list_distinct({tokens('qn')}) AS qt, {tokens('dn')} AS dt FROM pair),
 reranked AS (SELECT *, coalesce(10.0::DOUBLE * len(list_intersect(qt, dt)) / nullif(len(qt), 0), 5) AS rerank_score FROM lists),
 final AS (SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, fused_rank) - 1)::INT AS final_rank
   FROM reranked WHERE rerank_score >= 3 QUALIFY final_rank < 6),
 typed AS (SELECT *, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'data:' || filename END AS image FROM final),
 counted AS (SELECT *, count(image) OVER (PARTITION BY question_id ORDER BY final_rank) AS image_no FROM typed),
 contexts AS (SELECT question_id, string_agg(CASE WHEN image IS NOT NULL THEN '[页面图' || image_no || ': ' || filename || ']' || chr(10) || '页面多模态解读: ' || text
   ELSE '[文档' || (final_rank + 1) || ': ' || filename || ']' || chr(10) || text END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY final_rank) AS context
   FROM counted GROUP BY question_id)"""
ORACLES["rerank"] = f"WITH {RERANKED} SELECT question_id, filename, fused_rank, round(rerank_score, 6) AS rerank_score FROM reranked"
ORACLES["rerank_filter"] = f"WITH {RERANKED} SELECT question_id, filename FROM reranked WHERE rerank_score >= 3"
ORACLES["final_topk"] = f"WITH {RERANKED} SELECT question_id, filename, final_rank, round(rerank_score, 6) AS rerank_score FROM final"
ORACLES["hybrid_search"] = f"""WITH {RERANKED}
SELECT question_id, filename, final_rank, round(rrf_score, 6) AS rrf_score, round(rerank_score, 6) AS rerank_score FROM final"""
ORACLES["build_context"] = f"""WITH {RERANKED}
SELECT item_id AS question_id, coalesce(context, '暂无相关文档') AS context FROM benchmark LEFT JOIN contexts ON question_id = item_id"""
ORACLES["collect_images"] = f"""WITH {RERANKED}
SELECT question_id, string_agg(image, '|' ORDER BY final_rank) AS images FROM typed WHERE image IS NOT NULL GROUP BY question_id"""
ORACLES["answer_sources"] = f"""WITH {RERANKED},
 f AS (SELECT question_id, string_split(filename, '/')[1] AS s, min(final_rank) AS r FROM final GROUP BY ALL)
SELECT question_id, string_agg(s, '|' ORDER BY r) AS sources FROM f GROUP BY question_id"""
ORACLES["generate_answers"] = f"""WITH {RERANKED},
 f AS (SELECT question_id, filename, min(final_rank) AS r FROM final GROUP BY ALL),
 s AS (SELECT question_id, string_agg(filename, '|' ORDER BY r) AS sources FROM f GROUP BY question_id)
SELECT item_id AS question_id, coalesce(context, '暂无相关文档') AS answer, coalesce(sources, '') AS sources
FROM benchmark LEFT JOIN contexts c ON c.question_id = item_id LEFT JOIN s ON s.question_id = item_id"""
ORACLES["rerank_documents"] = f"""WITH {matches()},
 pair AS (SELECT question_id, filename, rank, string_split(b.text, ' ') AS w, d.text AS t FROM lexical JOIN docs d USING (filename)
   JOIN benchmark b ON b.item_id = question_id WHERE rank < 10),
 s AS (SELECT *, 10.0::DOUBLE * len([x for x in w if contains(t, x)]) / len(w) AS score FROM pair)
SELECT question_id, filename, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) - 1)::INT AS final_rank, round(score, 6) AS rerank_score
FROM s WHERE score >= 3"""
ORACLES["extract_keywords"] = f"""
SELECT item_id AS question_id, array_to_string({KEYWORDS}, '|') AS keywords FROM (SELECT item_id, replace(text, '.', '、') AS text FROM benchmark)"""
ORACLES["rewrite_queries"] = """
SELECT item_id AS question_id, CASE WHEN length(text) > 150 THEN replace(text, 'the ', '') ELSE text END AS rewritten FROM benchmark"""
ORACLES["embed_questions"] = """
SELECT item_id AS question_id, length(text)::INT AS chars, (length(text) - length(replace(text, ' ', '')))::INT AS spaces FROM benchmark"""
ORACLES["answer_events"] = f"""WITH {RERANKED},
 f AS (SELECT question_id, filename, min(final_rank) AS r FROM final GROUP BY ALL),
 s AS (SELECT question_id, string_agg(filename, '|' ORDER BY r) AS sources FROM f GROUP BY question_id),
 p AS (SELECT question_id, string_agg(image, '|' ORDER BY final_rank) AS images FROM typed WHERE image IS NOT NULL GROUP BY question_id),
 told AS (SELECT question_id, 0 AS k, 'sources' AS type, NULL AS content, sources, '' AS images FROM s UNION ALL
  SELECT question_id, 1, 'images', NULL, '', images FROM p UNION ALL
  SELECT item_id, 2, 'content', coalesce(context, '暂无相关文档'), '', '' FROM benchmark LEFT JOIN contexts ON question_id = item_id UNION ALL
  SELECT item_id, 3, 'done', NULL, '', '' FROM benchmark)
SELECT question_id AS request_id, (row_number() OVER (PARTITION BY question_id ORDER BY k) - 1)::INT AS seq, type, content, sources, images FROM told"""
ORACLES["empty_corpus_reply"] = """
SELECT item_id AS question_id, '当前知识库为空，请先上传文档后再提问。' AS answer, 'empty' AS corpus FROM benchmark"""


def windowed(messages: str) -> str:
    return f"""{messages},
 told AS (SELECT conv_id, turn, role, {trim("regexp_replace(text, '(?s)\\[IMAGES_DATA\\].*?\\[/IMAGES_DATA\\]', '', 'g')")} AS text FROM msg),
 back AS (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER w AS run FROM told WHERE text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
 win AS (SELECT conv_id, turn, role, text FROM back WHERE n <= 4 AND run <= 1000),
 hist AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || text, chr(10) ORDER BY turn) AS history FROM win GROUP BY conv_id)"""


ORACLES["build_prompt"] = f"""WITH {RERANKED}, {windowed("msg AS (SELECT * FROM conversations)")}
SELECT question_id, 'Documents:' || chr(10) || context || chr(10) || 'History:' || chr(10) || coalesce(history, '无') || chr(10) || 'Answer.' AS prompt
FROM contexts LEFT JOIN hist ON conv_id = question_id"""

# --- stored chunks ---------------------------------------------------------------------------------

_stored = """stored AS (SELECT CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 'init' ELSE source END AS filename,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS chunk_index, CASE WHEN doc_id % 7 <> 0 THEN text END AS text,
  CASE doc_id % 3 WHEN 0 THEN 'page' ELSE 'text' END AS type FROM documents),
 scanned AS (SELECT filename, coalesce(chunk_index, 0)::INT AS chunk_index, '' AS source, type, coalesce(text, '') AS text, '' AS image
  FROM stored WHERE filename IS NOT NULL AND filename <> 'init')"""
ORACLES["scan_chunks"] = f"WITH {_stored} SELECT * FROM scanned"
ORACLES["valid_rows"] = """
SELECT source AS filename, CASE WHEN doc_id % 5 <> 0 THEN doc_id END::INT AS chunk_index, CASE WHEN doc_id % 7 <> 0 THEN text END AS text,
  CASE doc_id % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'video' END AS type FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 19 <> 0"""
ORACLES["count_rows"] = f"WITH {_stored} SELECT count(*) AS n_rows FROM stored WHERE filename IS NOT NULL"
ORACLES["list_documents"] = f"WITH {_stored} SELECT filename, count(*) AS chunks FROM scanned GROUP BY filename"
ORACLES["list_vectors"] = f"""
SELECT source || '/' || doc_id AS filename, 0 AS chunk_index, text, len(embedding)::INT AS vector_dimension FROM documents JOIN embeddings ON vec_id = doc_id"""
ORACLES["filename_filter"] = f"SELECT filename, chunk_index FROM ({DOCS}) WHERE contains(lower(filename), 'src1')"
ORACLES["page_results"] = f"""
SELECT filename, doc_id, ((row_number() OVER (ORDER BY filename) - 1) // 20 + 1)::INT AS page_no, ceil(count(*) OVER () / 20)::INT AS total_pages FROM ({DOCS})"""
ORACLES["delete_document"] = """
WITH names AS (SELECT DISTINCT source AS filename FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT 'unknown.md')
SELECT source AS filename, count(*) AS rows, 'kept' AS state FROM documents WHERE source NOT IN (SELECT filename FROM names) GROUP BY source UNION ALL
SELECT filename, count(doc_id), 'deleted' FROM names LEFT JOIN documents ON source = filename GROUP BY filename"""
ORACLES["append_chunks"] = """
SELECT source || '-' || lang AS filename, CASE lang WHEN 'en' THEN count(*) ELSE 2 * count(*) END AS chunks FROM documents GROUP BY source, lang"""
ORACLES["delete_all"] = "SELECT 0::BIGINT AS left_over, count(*) AS removed FROM documents JOIN embeddings ON vec_id = doc_id"
ORACLES["migrate_vectors"] = """
SELECT 32 AS dimension, (SELECT count(*) FROM documents) + (SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id) AS n_rows"""

# --- conversations ---------------------------------------------------------------------------------

_messages = """msg AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 5 + turn = 3 THEN '[IMAGES_DATA]["x"][/IMAGES_DATA] ' || chr(10) ELSE text END AS text
  FROM conversations)"""
ORACLES["history_window"] = f"WITH {windowed(_messages)} SELECT conv_id, turn, role, text FROM win"
ORACLES["format_history"] = f"WITH {windowed(_messages)} SELECT conv_id, history FROM hist"
ORACLES["conversation_title"] = """
WITH f AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN t IS NULL THEN '新对话' WHEN length(t) >= 15 THEN substring(t, 1, 15) || '...' ELSE t END AS title FROM f"""
_tiers = ", ".join(f"({i}, {c}, {m}, {n})" for i, (c, m, n) in enumerate(SMALL_TIERS))
ORACLES["non_blank_messages"] = f"WITH {windowed(_messages)} SELECT conv_id, turn, text FROM told WHERE text <> ''"
ORACLES["list_conversations"] = """
WITH f AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS t, count(*) AS n_messages, max(turn) AS updated FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN t IS NULL THEN '新对话' WHEN length(t) >= 15 THEN substring(t, 1, 15) || '...' ELSE t END AS title, n_messages, updated FROM f"""
ORACLES["compact_conversations"] = f"""
WITH {_messages}, tiers(tier, convs, msgs, chars) AS (VALUES {_tiers}),
 told AS (SELECT conv_id, turn, role, {trim("regexp_replace(text, '(?s)\\[IMAGES_DATA\\].*?\\[/IMAGES_DATA\\]', '', 'g')")} AS text,
   dense_rank() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id DESC) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS m FROM msg),
 tried AS (SELECT conv_id % 3 AS owner, conv_id, turn, role, CASE WHEN length(text) > chars THEN substring(text, 1, chars) || {lit(TRUNCATION_NOTICE)} ELSE text END AS text, tier::INT AS tier
   FROM told JOIN tiers ON c <= convs AND m <= msgs),
 fits AS (SELECT owner, tier FROM tried GROUP BY owner, tier HAVING sum(length(text)) <= {QUOTA})
SELECT tried.* FROM tried JOIN (SELECT owner, min(tier) AS tier FROM fits GROUP BY owner) USING (owner, tier)"""
ORACLES["delete_messages"] = """
SELECT conv_id, turn, role FROM conversations WHERE NOT (role = 'system' OR turn = 1)
  AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE length(text) > 1500)"""
ORACLES["fold_answer_events"] = """
SELECT conv_id || '-' || turn AS request_id, CASE WHEN role = 'system' THEN '抱歉，出现错误: timeout' ELSE text || ' ' END AS content,
  role || '.md|b.md' AS sources, 'img' || turn AS images, role <> 'system' AS done FROM conversations"""

# --- streams ---------------------------------------------------------------------------------------

ORACLES["stream_answers"] = f"""WITH {matches(keywords='[]::VARCHAR[]')}
SELECT question_id, filename, rank::INT AS rank, round(score, 6) AS score FROM lexical WHERE rank < 10"""
ORACLES["stream_fold_events"] = """
SELECT conv_id || '-' || turn AS request_id, CASE WHEN role = 'system' THEN '抱歉，出现错误: timeout' ELSE text || ' ' END AS content,
  role || '.md|b.md' AS sources, 'img' || turn AS images FROM conversations"""
