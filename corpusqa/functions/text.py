"""Text normalisation, tokens, search terms and small message clean-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
# White space as the web platform defines it (tab … byte order mark).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
CJK = "一-龥"

TRUNCATION_NOTICE = "\n\n[内容已为本地存储截断]"
DEFAULT_TITLE = "新对话"
TITLE_CHARS = 15
DEFAULT_SCORE = 5.0
PAGE_HEADING = ("# ", " - 第 ", " 页多模态解读\n\n")
PAGE_FALLBACK = ("【页面摘要】\n", "\n\n【图表/表格/截图解读】\n视觉模型调用失败。\n\n【关键数据】\n请参考页面文本候选。")
IMAGE_BLOCK = "[IMAGES_DATA]"
PAGE_FAILURE_NOTICE = "[页面视觉解读失败，且没有可用文本]"
# -----------------------------------------------------------------------------

WS = f"[{WHITE_SPACE}]"
_IMAGES_BLOCK = r"(?s)\[IMAGES_DATA\].*?\[/IMAGES_DATA\]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utrim(text: Column) -> Column:
    """Strip every kind of Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalize_search_text(text: Column, strip_images: bool = True) -> Column:
    """Lower case; anything but letters and digits becomes one space.

    ``strip_images=False`` is the variant used by the substring search of the store.
    """
    text = F.lower(text)
    if strip_images:
        text = F.regexp_replace(text, r"(?s)\[images_data\].*?\[/images_data\]", " ")
    return F.btrim(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{CJK}]+", " "))


def normalize_ingest_text(text: Column) -> Column:
    """Delete carriage returns, then trim."""
    return utrim(F.replace(text, F.lit("\r"), F.lit("")))


def strip_images_data(text: Column) -> Column:
    """Remove embedded image blocks, then trim."""
    return utrim(F.regexp_replace(text, _IMAGES_BLOCK, ""))


def extract_images_data(text: Column, role: Column, images: Column | None = None) -> Column:
    """``struct(text, images)``: the first image block of a non-user message moved to a list.

    A message that already has images, a block holding a line break, or one that is not a JSON
    array of strings leaves both unchanged.
    """
    images = F.coalesce(images if images is not None else F.lit(None), F.array().cast("array<string>"))
    block = r"\[IMAGES_DATA\]([^\n\r\u2028\u2029]*?)\[/IMAGES_DATA\]"
    found = F.from_json(F.regexp_extract(text, block, 1), "array<string>")
    rest = F.regexp_replace(text, rf"(?s)\A(.*?){block}(.*)\z", "$1$3")
    usable = (role != "user") & (F.size(images) == 0) & text.rlike(block) & found.isNotNull()
    return F.struct(
        F.when(usable, rest).otherwise(text).alias("text"),
        F.when(usable, found).otherwise(images).alias("images"),
    )


def repair_filename(name: Column) -> Column:
    """Reread a name whose UTF-8 bytes were taken for Latin-1; other names are left alone."""
    latin1 = name.rlike(r"\A[\x00-\xFF]*\z")
    # the guard is repeated inside because encode() raises on characters beyond Latin-1
    safe = F.when(latin1, name).otherwise(F.lit(""))
    return F.when(latin1, F.make_valid_utf8(F.encode(safe, "ISO-8859-1").cast("string"))).otherwise(name)


def file_extension(name: Column) -> Column:
    """Lower-cased extension with its dot; a leading dot alone is no extension."""
    return F.lower(F.regexp_extract(name, r"[^/\\](\.[^./\\]*)\z", 1))


def unique_terms(terms: Column) -> Column:
    """Normalise each term, drop blanks, keep first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(terms, lambda t: normalize_search_text(t)), lambda t: t != ""))


def _ngrams(term: Column, n: int) -> Column:
    length = F.length(term)
    starts = F.when(length >= n, F.sequence(F.lit(1), length - (n - 1)))
    return F.coalesce(F.transform(starts, lambda i: F.substring(term, i, F.lit(n))), F.array().cast("array<string>"))


def tokenize(text: Column, strip_images: bool = True) -> Column:
    """Split normalised text on spaces; a segment of Chinese characters adds its 2- and 3-grams."""

    def segment_tokens(segment: Column) -> Column:
        return F.when(
            segment.rlike(rf"\A[{CJK}]+\z"), F.concat(F.array(segment), _ngrams(segment, 2), _ngrams(segment, 3))
        ).otherwise(F.array(segment))

    def split_tokens(normal: Column) -> Column:
        plain = F.split(normal, " ")
        return (
            F.when(normal == "", F.array().cast("array<string>"))
            .when(normal.rlike(f"[{CJK}]"), F.flatten(F.transform(plain, segment_tokens)))
            .otherwise(plain)
        )

    return let(normalize_search_text(text, strip_images), split_tokens)


def build_search_terms(question: Column, rewritten: Column, keywords: Column) -> Column:
    """Terms a question is searched with: keywords, whole sentences, their words, short CJK n-grams."""
    breaks = rf"[{WHITE_SPACE},，。！？、；：/]+"
    base = F.concat(
        F.coalesce(keywords, F.array().cast("array<string>")),
        F.array(question, rewritten),
        F.split(question, breaks),
        F.split(rewritten, breaks),
    )

    def derive(term: Column) -> Column:
        return F.when(
            term.rlike(rf"\A[{CJK}]{{4,8}}\z"), F.concat(F.array(term), _ngrams(term, 2), _ngrams(term, 3))
        ).otherwise(F.array(term))

    derived = F.flatten(F.transform(unique_terms(base), derive))
    return F.filter(F.array_distinct(derived), lambda t: F.length(t) >= 2)


def store_search_terms(query: Column, most: int | None = None) -> Column:
    """Words of a substring query of at least two characters; all of them, or the first ``most``."""
    words = F.split(normalize_search_text(query, strip_images=False), " ")
    long = F.filter(words, lambda t: F.length(t) >= 2)
    return long if most is None else F.slice(long, 1, most)


def count_occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` occurs in ``text`` without overlap; 0 for blank or missing input."""
    removed = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.coalesce(F.when(F.length(term) > 0, (removed / F.length(term)).cast("bigint")), F.lit(0).cast("bigint"))


def parse_keyword_list(reply: Column) -> Column:
    """A model's comma list as an array; blanks dropped."""
    return F.filter(F.transform(F.split(reply, "[,，、]"), lambda t: utrim(t)), lambda t: t != "")


def parse_score(reply: Column) -> Column:
    """Leading number of a model's reply clamped to 0..10; 5 when there is none."""
    number = rf"\A{WS}*([+-]?(?:Infinity|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?))"
    value = F.regexp_extract(reply, number, 1).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(value, F.lit(DEFAULT_SCORE))))


def similarity_from_distance(distance: Column) -> Column:
    return 1 / (1 + distance)


def truncate_text(text: Column, most: int) -> Column:
    """Prefix handed to a model call (a property of the call, not of the stored text)."""
    return F.substring(text, 1, most)


def truncate_with_notice(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATION_NOTICE))).otherwise(text)


def strip_code_fence(text: Column) -> Column:
    """Drop the code fence a model wrapped around its whole reply."""
    return utrim(F.regexp_replace(F.regexp_replace(text, r"\A```(markdown)?", ""), r"```\z", ""))


def title_from_text(text: Column) -> Column:
    """Conversation title from the first user message (null when there is none)."""
    head = F.substring(text, 1, TITLE_CHARS)
    title = F.when(F.length(head) == TITLE_CHARS, F.concat(head, F.lit("..."))).otherwise(head)
    return F.coalesce(title, F.lit(DEFAULT_TITLE))


def page_heading_text(filename: Column, page_number: Column, text: Column, text_hint: Column | None = None) -> Column:
    """Heading line plus interpretation of a page; a null interpretation falls back to the text hint."""
    heading = F.concat(F.lit(PAGE_HEADING[0]), filename, F.lit(PAGE_HEADING[1]), page_number.cast("string"), F.lit(PAGE_HEADING[2]))
    hint = F.lit(None).cast("string") if text_hint is None else text_hint
    fallback = F.concat(
        F.lit(PAGE_FALLBACK[0]),
        F.coalesce(F.when(hint != "", hint), F.lit(PAGE_FAILURE_NOTICE)),
        F.lit(PAGE_FALLBACK[1]),
    )
    return F.concat(heading, F.coalesce(text, fallback))


def contains_all(terms: Column, *haystacks: Column) -> Column:
    """True when every term occurs in at least one of the haystacks (case-sensitive)."""
    return F.forall(terms, lambda t: reduce(lambda a, b: a | b, [F.contains(h, t) for h in haystacks]))
