"""Personal data in texts, with DataFrame functions only: patterns propose spans, checksums confirm them, context words adjust scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which spans are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "card_in_run", "phone_in_run")
BASE = KINDS[:4]

# The patterns match what their plain forms match (see README), written so that no run of characters is read
# again from each of its places and no group is repeated by recursion: possessive quantifiers, and a look-behind that lets a
# match begin only where a run begins or where the match before it ended (\G).
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
_CARD = r"(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![\w+.@/-])\(?0[0-9]{1,4}\)?[\x20/.-]?[0-9]{2,5}(?:[\x20.-]?[0-9]{2,5}){0,3}(?![\w@])",
    # numbers that a longer run of digits around them keeps from being base matches
    "card_in_run": rf"(?<=[0-9][\x20-]){_CARD}(?![\x20-]?[0-9])|(?<![0-9])(?<![0-9][\x20-]){_CARD}(?=[\x20-][0-9])",
    "phone_in_run": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?=[\x20(.-]+[0-9])",
}
_ADDRESS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "phone_in_run": "+"}  # a text without this sign has no match

CONTEXT = 32  # characters before a span that are searched for context words
CONTEXT_WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel)",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|direcci)",
    "card": r"(?i)\b(?:card|visa|master|credit|karte|carte|tarjeta)",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile?|handy|anruf|appel|llam)",
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)",
    "card_in_run": r"(?i)\b(?:card|visa|master|credit|karte|carte|tarjeta)",
    "phone_in_run": r"(?i)\b(?:tel|phone|call|fax|mobile?|handy|anruf|appel|llam)",
    "local_phone": r"(?i)\b(?:tel|phone|call|fax|mobile?|handy|anruf|appel|llam)",
}
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.3, "card_in_run": 0.7, "phone_in_run": 0.6}
BONUS = 0.2
BLOCK = 128
LETTERS = 512
LEAST = 0.5  # spans with a lower score are dropped; those of the base kinds always have more


def running(values: Column, combine, start: int = 0) -> Column:
    """For each number of an array, what ``combine`` makes of those before it.

    Two levels, blocks and numbers within a block: a growing array is copied at each step, which would otherwise
    take time with the square of the array's size.
    """
    none = F.array().cast("array<int>")

    def scan(part: Column, head: Column) -> Column:
        state = F.struct(head.alias("at"), none.alias("out"))
        step = lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, state, step, lambda acc: acc["out"])

    last = ((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    heads = scan(F.transform(blocks, lambda part: F.aggregate(part, F.lit(start), combine)), F.lit(start))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(blocks, heads, scan))).otherwise(none)


def blocks_of(text: Column) -> Column:
    """The text in blocks of ``LETTERS`` code points, so that a place deep in it is reached without passing over all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{LETTERS}}}"), F.lit(0))


def cut(blocks: Column, begin: Column, end: Column) -> Column:
    """The text from ``begin`` to ``end``, from its blocks."""
    first = (begin / LETTERS).cast("int")
    last = ((end - 1) / LETTERS).cast("int")
    joined = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > begin, F.substring(joined, begin - first * LETTERS + 1, end - begin)).otherwise(F.lit(""))


def with_matches(frame: DataFrame, text: str, kinds: tuple[str, ...]) -> DataFrame:
    """Adds ``_<kind>``: array<struct<begin, end, match>> of the leftmost non-overlapping matches.

    Places count code points, ends are exclusive. The text between matches is split off only where there are any.
    """
    names = [c for c in frame.columns if c not in kinds]
    none = F.array().cast("array<string>")
    found = [
        F.when(F.col(text).contains(_NEEDS[k]) if k in _NEEDS else F.lit(True), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"_found_{k}")
        for k in kinds
    ]
    frame = frame.select(*names, *found)
    gaps = [F.when(F.size(f"_found_{k}") > 0, F.transform(F.split(text, PATTERNS[k], -1), lambda g: F.length(g))).otherwise(F.array().cast("array<int>")).alias(f"_gaps_{k}") for k in kinds]
    frame = frame.select(*names, *[f"_found_{k}" for k in kinds], *gaps)
    steps = [F.zip_with(F.slice(f"_gaps_{k}", F.lit(1), F.size(f"_found_{k}")), F.col(f"_found_{k}"), lambda g, m: g + F.length(m)).alias(f"_steps_{k}") for k in kinds]
    frame = frame.select(*names, *[f"_found_{k}" for k in kinds], *steps)
    starts = [running(F.col(f"_steps_{k}"), lambda a, b: a + b).alias(f"_starts_{k}") for k in kinds]
    frame = frame.select(*names, *[f"_{what}_{k}" for k in kinds for what in ("found", "steps")], *starts)

    def span(at: Column, both: Column) -> Column:
        end = at + both["step"]
        return F.struct((end - F.length(both["match"])).alias("begin"), end.alias("end"), both["match"].alias("match"))

    spans = [
        F.zip_with(F.col(f"_starts_{k}"), F.arrays_zip(F.col(f"_steps_{k}").alias("step"), F.col(f"_found_{k}").alias("match")), span).alias(f"_{k}") for k in kinds
    ]
    return frame.select(*names, *spans)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum: every second digit from the right is doubled."""
    size = F.length(number)

    def step(total: Column, place: Column) -> Column:
        digit = F.substring(number, place, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when((size - place) % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 modulo 97: its first four signs go to the end, letters count from 10."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))

    def step(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code > 57, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, sign: F.when(sign == "", rest).otherwise(step(rest, sign))) == 1


def confirmed(kind: str, match: Column) -> Column:
    number = digits(match)
    size = F.length(number)
    if kind == "ip":
        return match.rlike(_ADDRESS)
    if kind in ("card", "card_in_run"):
        return F.when(size.between(13, 19), luhn(number)).otherwise(False)
    if kind in ("phone", "phone_in_run"):
        return size.between(9, 15)
    if kind == "iban":
        account = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(account).between(15, 34), mod97(account)).otherwise(False)
    if kind == "local_phone":
        return size.between(7, 13)
    return F.lit(True)


def _confirmed_spans(kind: str) -> Column:
    def scored(s: Column) -> Column:
        start = F.greatest(s["begin"] - CONTEXT, F.lit(0))
        near = cut(F.col("_blocks"), start, s["begin"]).rlike(CONTEXT_WORDS[kind])
        score = F.lit(SCORES[kind]) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

    found = F.transform(F.filter(f"_{kind}", lambda s: confirmed(kind, s["match"])), scored)
    return found if kind in BASE else F.filter(found, lambda s: s["score"] >= LEAST)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, pii array<struct<kind, begin, end, score>>), one row per row of ``docs``, in the order of kinds, then places.

    The patterns of all kinds propose spans; the four parts of an address are at most 255, card numbers have 13 to 19 digits
    and pass Luhn, phone numbers have 9 to 15 digits, IBANs pass mod 97. A context word within the ``CONTEXT``
    characters before a span raises its score: a phone number in national form counts only with one.
    Spans of the base kinds are never dropped for their score.

    Null and empty texts have no spans. A text is read once per kind, by patterns that need time in proportion to its
    length. Repeated rows give repeated results, null ids pass through, no rows give none, further columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return with_pii(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")))


def with_pii(frame: DataFrame) -> DataFrame:
    """``frame`` has a column ``text`` without nulls and none whose name begins with an underscore and a kind; adds ``pii``."""
    names = frame.columns
    frame = with_matches(frame, "text", KINDS)
    proposed = reduce(lambda a, b: a | b, [F.size(f"_{kind}") > 0 for kind in KINDS])
    frame = frame.withColumn("_blocks", F.when(proposed, blocks_of(F.col("text"))))
    return frame.select(*names, F.concat(*[_confirmed_spans(kind) for kind in KINDS]).alias("pii"))


def mask_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, with all their columns, personal data in their texts masked; ``length_col``, if there is
    one, gets the length of the new text. Null texts stay null; repeated rows give repeated results, no rows give none; columns may have any names."""
    text = F.col(text_col).cast("string")
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    frame = with_masked(with_pii(frame), "text", "pii")
    new = F.when(F.col(f"row.`{text_col}`").isNotNull(), F.col("text"))
    changed = {text_col: new, length_col: F.when(new.isNotNull(), F.length("text")).otherwise(F.col(f"row.`{length_col}`"))} if length_col in docs.columns else {text_col: new}
    return frame.select(*[(changed[f.name].cast(f.dataType) if f.name in changed else F.col(f"row.`{f.name}`")).alias(f.name) for f in docs.schema])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def with_masked(frame: DataFrame, text: str, spans: str) -> DataFrame:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named after the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    rest = [c for c in frame.columns if c not in (text, spans)]
    frame = frame.select(*rest, text, ordered.alias("_ordered"), F.when(F.size(spans) > 0, blocks_of(F.col(text))).alias("_blocks"))
    frame = frame.withColumn("_reached", running(F.transform("_ordered", lambda s: -s["back"]), lambda a, b: F.greatest(a, b)))

    def piece(s: Column, at: Column) -> Column:
        return F.when(s["begin"] >= at, F.concat(cut(F.col("_blocks"), at, s["begin"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))

    pieces = F.array_join(F.zip_with("_ordered", "_reached", piece), "")
    reached = F.aggregate("_ordered", F.lit(0), lambda at, s: F.greatest(at, -s["back"]))
    whole = F.concat(pieces, F.substring(F.col(text), reached + 1, F.length(text)))
    return frame.select(*rest, F.when(F.size("_ordered") > 0, whole).otherwise(F.col(text)).alias(text))
