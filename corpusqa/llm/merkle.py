"""Merkle manifest of a table of documents: ranks are grouped away digit by digit into nested structs, which a transform unfolds into proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.functions.text import let
from corpusqa.operators.ranking import number_rows
from corpusqa.session import materialise

ARITY = 3
DIGITS = 6  # levels in a block: 729 nodes are nested in one row
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<left:string,right:string>>"


def spelled(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*inputs: Column) -> Column:
    """Lower-case hex SHA-256 of the inputs one after the other."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row's fields, with another text in place of its own if one is given."""
    return digest(*[spelled(text if name == "text" and text is not None else F.col(name)) for name in FIELDS])


def _siblings(kids: Column, at: Column) -> Column:
    """The step of one child: the digests left and right of it; no step for a node that stands alone in its whole tree."""
    digests = F.transform(kids, lambda kid: kid["digest"])
    left, right = F.array_join(F.slice(digests, 1, at), ""), F.array_join(F.slice(digests, at + 2, ARITY), "")
    return F.array(F.struct(left.alias("left"), right.alias("right")))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, rank, digest, nested): blocks of 3 ** DIGITS nodes of consecutive ``rank``, one row each.

    ``nodes(tree, rank, digest, payload)``. One exchange deals the blocks out; the digit columns are then grouped away one after the other
    within that partitioning. A first group with a single child is all there is of its tree at that level, so the child goes up as it is.
    """
    size = ARITY**DIGITS
    digit = lambda n: F.floor(F.col("rank") / ARITY**n) % ARITY
    rows = nodes.select(
        "tree",
        F.floor(F.col("rank") / size).alias("block"),
        *[digit(n).cast("int").alias(f"d{n}") for n in range(DIGITS)],
        F.struct(F.col("digest"), F.col("payload")).alias("nested"),
    ).repartition("tree", "block")
    for n in range(DIGITS):
        higher = [f"d{i}" for i in range(n + 1, DIGITS)]
        first = (F.col("block") == 0) & (F.lit(True) if not higher else F.greatest(F.lit(0), *map(F.col, higher)) == 0)
        kids = F.transform("kids", lambda kid: kid["nested"])
        grouped = rows.groupBy("tree", "block", *higher).agg(F.sort_array(F.collect_list(F.struct(F.col(f"d{n}"), F.col("nested")))).alias("kids"))
        alone = first & (F.size("kids") == 1)
        own = digest(F.array_join(F.transform("kids", lambda kid: kid["nested"]["digest"]), ""))
        up = F.when(alone, F.col("kids")[0]["nested"]["digest"]).otherwise(own)
        rows = grouped.select("tree", "block", *higher, F.struct(up.alias("digest"), alone.alias("alone"), kids.alias("kids")).alias("nested"))
    return rows.select("tree", F.col("block").alias("rank"), F.col("nested")["digest"].alias("digest"), "nested")


def _unfolded(node: Column, levels: int, path: Column) -> Column:
    """``array<struct<digest, payload, path>>`` of a nested node; ``path`` holds the steps above it, the lowest first."""
    if levels == 0:
        return F.array(F.struct(node["digest"].alias("digest"), node["payload"].alias("payload"), path.alias("path")))

    def below(kid: Column, at: Column) -> Column:
        steps = F.when(node["alone"], path).otherwise(F.concat(_siblings(node["kids"], at), path))
        return let(steps, lambda held: _unfolded(kid, levels - 1, held))

    return F.flatten(F.transform(node["kids"], below))


def _tower(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the nodes, blocks of those blocks, and so on up to one block per tree; each written."""
    levels = [materialise(_blocks(nodes), "blocks")]
    while (levels[-1].agg(F.max("rank")).first()[0] or 0) > 0:
        upper = levels[-1].select("tree", "rank", "digest", F.struct(F.col("rank").alias("rank")).alias("payload"))
        levels.append(materialise(_blocks(upper), "blocks"))
    return levels


def _descend(levels: list[DataFrame], tops: DataFrame, *carried: str) -> DataFrame:
    """(tree, digest, payload, path, carried…) of every lowest node; ``tops(tree, path, carried…)`` gives what is above each tree.

    Inside a block proofs come from the nested structs alone. A block meets the path above it by its number: one row each on both sides.
    """
    above = tops.withColumn("rank", F.lit(0).cast("bigint"))
    for n, blocks in reversed(list(enumerate(levels))):
        met = blocks.join(above, ["tree", "rank"])
        below = met.select("tree", *carried, F.explode(_unfolded(F.col("nested"), DIGITS, F.col("path"))).alias("node"))
        if n == 0:
            return below.select("tree", *carried, "node.*")
        above = below.select("tree", *carried, F.col("node.payload.rank").alias("rank"), F.col("node.path").alias("path"))
    raise AssertionError("a tower has a level")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda held, step: digest(step["left"], held, step["right"]))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path, folded_root, verified): one row per row of ``docs(doc_id, source, lang, n_chars, text)``.

    A leaf is the digest of a row's fields. The leaves of a source by ascending doc_id are the lowest nodes of its tree: while there are several,
    every three consecutive ones become their digest. What remains is the source's subroot; the subroots, by source, are the lowest nodes of the
    tree of the root. ``path array<struct<left, right>>`` holds the sibling digests on each level from leaf to root. ``folded_root`` is worked out
    anew from the path and the leaf of the row with ``tampered`` (a column: another text) in place of its text where that is not null.

    Null sources form a tree of their own, the first; an empty source is another. Null ids come first. Rows with equal ids go by their leaf; repeated rows are leaves of their
    own, which of them comes first makes no difference to the table of results. No rows give none; further columns are not read. Texts of any length are hashed whole;
    what is shuffled per row are ids, sources and digests.

    Ranks come from a range-partitioned sort, so a source may hold any share of the rows; 3 ** DIGITS nodes lie in a row, and the block digests are dealt
    with likewise, so no task holds a whole source.
    """
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_digest(tampered))
    # a null source sorts before all, an empty one next
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), other.alias("tampered"))
    leaves = materialise(leaves, "leaves")
    ranked = number_rows(leaves, ["doc_id", "digest"], ["tree"], "rank")
    nodes = ranked.select("tree", "rank", "digest", F.struct(F.col("doc_id"), F.col("tampered")).alias("payload"))
    sources = _tower(nodes)
    subroots = number_rows(sources[-1].select("tree", "digest"), ["tree"], (), "rank")
    whole = subroots.select(F.lit("").alias("tree"), "rank", "digest", F.struct(F.col("tree").alias("source_tree")).alias("payload"))
    top = _tower(whole)
    start = top[-1].select("tree", F.col("digest").alias("root"), F.array().cast(_STEPS).alias("path"))
    tops = _descend(top, start, "root").select(F.col("payload.source_tree").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    found = _descend(sources, tops, "subroot", "root")
    folded = fold(F.coalesce(F.col("payload")["tampered"], F.col("digest")), F.col("path"))
    return found.select(
        F.col("payload.doc_id").alias("doc_id"),
        F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("source"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "path",
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
