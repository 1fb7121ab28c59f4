"""Connected components of a graph given as links, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.session import materialise


def local_roots(a: np.ndarray, b: np.ndarray, size: int, roots: np.ndarray | None = None) -> np.ndarray:
    """The smallest position reachable from each of ``size`` positions by the links ``a[i]`` - ``b[i]``.

    ``roots`` continues an earlier result, so links can be given in blocks.
    """
    roots = np.arange(size) if roots is None else roots
    while True:
        x, y = roots[a], roots[b]
        apart = x != y
        if not apart.any():
            return roots
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = roots[roots]
            if (further == roots).all():
                break
            roots = further


def spanning(a: np.ndarray, b: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The places of those of the links ``a[i]`` - ``b[i]`` that connect what ``roots`` (changed in place) held apart, none too many.

    Each round every root takes one link to a smaller root, as in Boruvka's algorithm.
    """
    kept, at = [np.zeros(0, dtype=np.int64)], np.arange(len(a))
    while True:
        x, y = roots[a[at]], roots[b[at]]
        apart = x != y
        if not apart.any():
            return np.concatenate(kept)
        at, x, y = at[apart], x[apart], y[apart]
        high, low = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((low, high))
        chosen = order[np.append(True, high[order][1:] != high[order][:-1])]
        kept.append(at[chosen])
        roots[high[chosen]] = low[chosen]
        while True:
            further = roots[roots]
            if (further == roots).all():
                break
            roots[:] = further


def connected_components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node long, root long), root being the smallest node of the component.

    Nodes without a link, links of a node with itself and nulls give no row; repeated links change nothing.
    Each round is two joins on nodes with pre-aggregated minima. Its links are written to the shared folder, so
    that a lost executor repeats one round at most. The number of rounds grows with the logarithm of a component's size.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    pairs = materialise(pairs, "links")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        pairs = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        joined = pairs.join(least, "u")
        pairs = materialise(
            joined.select("u", F.col("m").alias("v"))
            .unionByName(joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "links",
        )
        state = pairs.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
