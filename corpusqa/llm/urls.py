"""Allow and block rules for URLs, with DataFrame functions only: host suffixes and path prefixes meet the rules by hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.session import materialise

PREFIX = 8  # hexadecimal digits of a digest that are joined on; the whole digest confirms
SENT_RULES = 1_000_000  # more rules than this are joined by a shuffle and not sent to every task
DEFAULT = "allow"  # the verdict where no rule fits

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    after = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^(?s)([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^(?s)[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _key(host: Column, path: Column) -> Column:
    # the length of the host tells apart what only looks alike when put together
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def expressions(hosts: str, paths: str, labels: list[int], lengths: list[int]) -> Column:
    """array<struct<host, path>>: every suffix of ``labels`` host labels with every prefix of ``lengths`` path characters.

    Only numbers of labels and lengths that some rule has are expanded: no other expression can equal a rule.
    """
    n_labels = F.length(hosts) - F.length(F.replace(F.col(hosts), F.lit("."), F.lit(""))) + 1
    found = []
    for n in labels:
        for size in lengths:
            fits = (n_labels >= n) & (F.length(paths) >= size)
            one = F.struct(F.substring_index(hosts, ".", -n).alias("host"), F.substring(F.col(paths), 1, size).alias("path"))
            found.append(F.when(fits, one))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<host:string,path:string>>")


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, sent: int = SENT_RULES
) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``.

    ``rules`` (host, path, verdict): a rule fits its host and all subdomains, for URLs whose path starts with the rule's.
    Of the rules that fit, the longest (host and path together) decides; of equally long ones that with the longer host; a rule
    given with both verdicts blocks. ``rule`` is host and path put together, null where none fits; the verdict is then ``default``.

    Each different host and path is expanded once, whatever the number of its pages; expressions meet the rules on a
    prefix of their SHA-256 digest, then whole digests, host and path are compared. A null URL or one without ``://`` has an empty host
    and path, which no rule with a host fits. Rules with a null in a column, with an empty host or without a verdict of
    allow or block are passed over; repeated rules count once. Null ids pass through, repeated pages give repeated
    results, no pages give none; without rules every page has the default. Further columns are not read.
    """
    known = rules.select(F.col("host").cast("string"), F.col("path").cast("string"), F.col("verdict").cast("string"))
    known = known.where((F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block"))
    known = known.groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    digest = _key(F.col("host"), F.col("path"))
    known = materialise(known.select("*", digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("short")), "url-rules")
    shape = known.agg(
        F.count("*").alias("n"),
        F.collect_set(F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()

    host, path = parts(F.col(url_col))
    read = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not shape["n"]:
        return read.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    distinct = read.select("host", "path").distinct().select("host", "path", F.explode(expressions("host", "path", sorted(shape["labels"]), sorted(shape["lengths"]))).alias("e"))
    digest = _key(F.col("e.host"), F.col("e.path"))
    looked = distinct.select("host", "path", F.col("e.host").alias("e_host"), F.col("e.path").alias("e_path"), digest.alias("e_digest"), F.substring(digest, 1, PREFIX).alias("short"))
    known = known.select("short", "digest", F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    met = looked.join(F.broadcast(known) if shape["n"] <= sent else known, "short")
    met = met.where((F.col("e_digest") == F.col("digest")) & (F.col("e_host") == F.col("r_host")) & (F.col("e_path") == F.col("r_path")))
    order = F.struct(F.length(F.concat("r_host", "r_path")).alias("size"), F.length("r_host").alias("host_size"), "r_verdict", F.concat("r_host", "r_path").alias("rule"))
    best = met.groupBy("host", "path").agg(F.max(order).alias("best"))
    joined = read.join(best, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def stated_rules(spark) -> DataFrame:
    return reduce(
        lambda a, b: a.unionByName(b),
        [spark.range(1).select(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES],
    )
