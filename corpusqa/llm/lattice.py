"""Near-duplicate vectors by E8 lattice hashing: random projections decoded to lattice cells, neighbouring cells probed, cosine verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusqa.llm.components import connected_components, local_roots
from corpusqa.session import materialise

COSINE = 0.98
TABLES = 3  # independent projections
PROBES = 8  # neighbouring cells that a vector visits in each table
SCALE = 2.475  # mean length of a unit vector once it is projected to 8 dimensions; cells are about one wide
BLOCK = 2048  # members of a cell that are compared at a time
WAITING = 1 << 17  # pairs of a task that are looked at together
BUNDLE = 8192  # members of small cells that one call takes together


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    halves = [np.array(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + halves)


NEIGHBOURS = _neighbours()


def decode(points: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of each row: the nearer of its nearest points in D8 and in D8 moved by a half."""
    near, moved = _decode_d8(points), _decode_d8(points - 0.5) + 0.5
    first = ((points - near) ** 2).sum(axis=1) <= ((points - moved) ** 2).sum(axis=1)
    return np.where(first[:, None], near, moved)


def _decode_d8(points: np.ndarray) -> np.ndarray:
    """Rounded coordinates; where their sum is odd, the one that was rounded furthest goes the other way."""
    near = np.rint(points)
    rest = points - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(rest[odd]).argmax(axis=1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def projection(dimension: int, tables: int = TABLES, scale: float = SCALE) -> np.ndarray:
    """dimension x (8 * tables): orthogonal directions for each table, the same at every run."""
    draw = np.random.default_rng(dimension)
    parts = [np.linalg.qr(draw.normal(size=(max(dimension, 8), 8)))[0][:dimension] for _ in range(tables)]
    return np.concatenate(parts, axis=1) * scale * np.sqrt(max(dimension, 8) / 8)


def cells(units: np.ndarray, directions: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """rows x tables x (1 + probes): the packed home cell of each unit vector, then the neighbouring cells nearest to it.

    Sums go dimension by dimension, so that a vector has the same cells in whichever batch it comes.
    """
    placed = np.zeros((len(units), directions.shape[1]))
    for d in range(units.shape[1]):
        placed += units[:, d : d + 1] * directions[d]
    tables = directions.shape[1] // 8
    out = np.empty((len(units), tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        points = placed[:, 8 * t : 8 * t + 8]
        home = decode(points)
        rest = points - home
        closeness = np.zeros((len(units), len(NEIGHBOURS)))
        for k in range(8):
            closeness += rest[:, k : k + 1] * NEIGHBOURS[:, k]
        order = np.argsort(-closeness, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = _packed(home)
        for p in range(probes):
            out[:, t, 1 + p] = _packed(home + NEIGHBOURS[order[:, p]])
    return out


def _packed(points: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((2 * points).astype(np.int8)).view(np.int64).ravel()


def unit_rows(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # lengths of very large and very small vectors stay finite
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _links_of(frame: pd.DataFrame, directions: np.ndarray, least: float) -> pd.DataFrame:
    """What the pairs of some cells add: for each node, vectors linked and the smallest node it reaches there.

    A pair that meets in several cells counts in the first table where it meets, and there in its common home or else in the
    home of its smaller node.
    """
    frame = frame.sort_values(["table", "cell", "visits", "node"], kind="stable").reset_index(drop=True)
    nodes, weights = frame["node"].to_numpy(), frame["copies"].to_numpy()
    units = unit_rows(frame["vector"])
    visits, table, alone = frame["visits"].to_numpy(), frame["table"].to_numpy(), frame["alone"].to_numpy()
    key = frame[["table", "cell"]].to_numpy()
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
    codes, have = np.zeros((len(frame), directions.shape[1] // 8, 1 + PROBES), dtype=np.int64), np.zeros(len(frame), dtype=bool)
    pairs, waiting, a_all, b_all = [], 0, [], []

    def counted_here() -> None:
        """Of the pairs that wait, keep those that count in their cell; cells are worked out for members of pairs only, many at a time."""
        new = np.zeros(len(frame), dtype=bool)
        for i, j, _, _ in pairs:
            new[i] = new[j] = True
        new = np.flatnonzero(new & ~have)
        codes[new], have[new] = cells(units[new], directions), True
        for i, j, t, visit in pairs:
            first = np.ones(len(i), dtype=bool)
            for earlier in range(t):
                first &= ~_meet(codes[i, earlier], codes[j, earlier])
            apart = codes[i, t, 0] != codes[j, t, 0]
            both = (codes[i, t, 1:] == codes[j, t, :1]).any(axis=1) & (codes[j, t, 1:] == codes[i, t, :1]).any(axis=1)
            here = nodes[i] < nodes[j] if visit else True
            first &= ~(apart & both) | here
            a_all.append(i[first])
            b_all.append(j[first])
        pairs.clear()

    for lo, hi in zip(starts, np.append(starts[1:], len(frame))):
        middle = lo + int((~visits[lo:hi]).sum())
        if middle == lo or hi - lo < 2:
            continue
        sides = [(lo, middle, middle, hi)] if middle < hi else []
        if alone[lo] and middle - lo > 1:
            sides.append((lo, middle, lo, middle))
        for a0, a1, b0, b1 in sides:
            i, j = np.nonzero(units[a0:a1] @ units[b0:b1].T >= least - 1e-9)
            i, j = i + a0, j + b0
            keep = (i < j) if a0 == b0 else nodes[i] != nodes[j]
            i, j = i[keep], j[keep]
            for at in range(0, len(i), WAITING):
                some_i, some_j = i[at : at + WAITING], j[at : at + WAITING]
                exact = (units[some_i] * units[some_j]).sum(axis=1) >= least
                pairs.append((some_i[exact], some_j[exact], int(table[lo]), a0 != b0))
                waiting += int(exact.sum())
                if waiting >= WAITING:
                    counted_here()
                    waiting = 0
    if waiting:
        counted_here()
    if not a_all:
        return pd.DataFrame({"node": [], "linked": [], "root": []}).astype("int64")
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    names, at = np.unique(nodes, return_inverse=True)
    linked = np.zeros(len(names), dtype=np.int64)
    np.add.at(linked, at[a], weights[b])
    np.add.at(linked, at[b], weights[a])
    roots = local_roots(at[a], at[b], len(names))
    some = linked > 0
    return pd.DataFrame({"node": names[some], "linked": linked[some], "root": names[roots[some]]})


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two vectors share a cell that is home to one of them, by their cells in one table."""
    return (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)


def link_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK, bundle: int = BUNDLE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors of equal, not null label and equal length are linked if their cosine, in double precision, is at least ``cosine``.
    n_links counts the other rows linked directly, component_id is the smallest id reachable, kept says that a row's
    own id is that one. Equal vectors of a label are one node with a weight, whatever their number. Each node lives in
    one cell of every table and visits the ``PROBES`` nearest neighbouring cells; only visits to cells that are home to some
    node are followed. Cells of more than ``block`` members are compared block by block in different tasks. Tasks return sums
    and a spanning forest, never pairs. For a pair right at the threshold the chance of meeting in no cell is about
    three in a million (see README); no pair below it is linked.

    Vectors that are null, empty, zero or hold a null or a non-finite component, and those without a label, link with
    nothing: n_links 0, their own component, kept. A row with a null id counts as a vector, has its group's component (null
    if there is none) and is not kept. Repeated rows are vectors of their own, linked with each other. Vectors may be
    of any length; those of different lengths are not compared. No rows give none; further columns are not read.
    """
    # single numbers stay single on their way; cosines are worked out in double precision
    single = isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), T.FloatType)
    numbers = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), numbers.alias("vector"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("vector", F.when(F.col("label").isNotNull() & _usable(F.col("vector")), F.col("vector")))
    groups = rows.where(F.col("vector").isNotNull()).groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    # numbered before it is written; only the written numbers are used
    groups = materialise(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = sorted(r[0] for r in groups.select(F.size("vector")).distinct().collect())
    directions = {n: projection(n) for n in sizes}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, labels, all_vectors = np.asarray(batch.column(0)), batch.column(1), batch.column(2)
            lengths = np.asarray(all_vectors.value_lengths())
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                codes = cells(unit_rows(all_vectors.take(pa.array(at)).to_pylist()), directions[int(n)])
                tables, each = codes.shape[1:]
                yield pa.RecordBatch.from_arrays(
                    [
                        labels.take(pa.array(np.repeat(at, tables * each))),
                        pa.array(np.full(codes.size, n, dtype=np.int32)),
                        pa.array(np.repeat(nodes[at], tables * each)),
                        pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), len(at))),
                        pa.array(codes.ravel()),
                        pa.array(np.tile(np.arange(each) > 0, len(at) * tables)),
                    ],
                    names=["label", "n", "node", "table", "cell", "visits"],
                )

    placed = groups.select("node", "label", "vector").mapInArrow(place, "label string, n int, node long, table int, cell long, visits boolean")
    named = materialise(placed, "cells")
    where = ["label", "n", "table", "cell"]
    shape = named.groupBy(*where).agg(F.count_if(~F.col("visits")).alias("homes"), F.count_if("visits").alias("guests"))
    shape = shape.where((F.col("homes") > 0) & (F.col("homes") + F.col("guests") > 1))
    members = named.join(shape, where)
    total = max(1, members.count())

    blocks = lambda of: F.ceil(F.col(of) / block).cast("int")
    small = (F.col("homes") <= block) & (F.col("guests") <= block)
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("visits"), blocks("guests")).otherwise(blocks("homes")).cast("long")).cast("int")
    members = members.select("*", small.alias("small"), blocks("homes").alias("nh"), blocks("guests").alias("ng"), mine.alias("mine"))
    bundles = F.pmod(F.xxhash64("table", "cell"), F.lit(-(-total // bundle)))
    apart = F.xxhash64("label", "table", "cell")

    def task(kind: str, a: Column, b: Column, second: Column, alone: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), second.alias("second"), alone.alias("alone"))

    none, yes, no = F.lit(0), F.lit(True), F.lit(False)
    each = lambda n: F.sequence(none, n - 1)
    home_home = F.transform(each(F.col("nh")), lambda k: task("homes", F.least(k, "mine"), F.greatest(k, "mine"), k < F.col("mine"), k == F.col("mine")))
    home_guest = F.when(F.col("ng") > 0, F.transform(each(F.col("ng")), lambda k: task("guests", F.col("mine"), k, no, no))).otherwise(F.array())
    guest_home = F.transform(each(F.col("nh")), lambda k: task("guests", k, F.col("mine"), yes, no))
    tasks = F.when(F.col("small"), F.array(task("cells", none, none, F.col("visits"), yes))).otherwise(F.when(F.col("visits"), guest_home).otherwise(F.concat(home_home, home_guest)))
    dealt = members.select("label", "n", "table", "cell", "node", F.when(F.col("small"), bundles).otherwise(apart).alias("part"), F.explode(tasks).alias("t"))
    dealt = dealt.select("label", "n", "table", "cell", "node", "part", "t.kind", "t.a", "t.b", F.col("t.second").alias("visits"), "t.alone")
    dealt = dealt.join(groups.select("node", "vector", "copies"), "node")

    def links(key, frame: pd.DataFrame) -> pd.DataFrame:
        return _links_of(frame, directions[int(key[1])], cosine)

    grouped = dealt.groupBy("label", "n", "part", "kind", "a", "b")
    found = materialise(grouped.applyInPandas(links, "node long, linked long, root long"), "links")
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    placed = groups.join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(least, "root").select("label", "vector", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    component = F.coalesce("component_id", "vec_id")
    return rows.join(placed, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
