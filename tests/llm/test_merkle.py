import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusqa.llm import merkle
from corpusqa.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(row, text):
    spelled = [None if v is None else str(v) for v in (*row[:4], text)]
    return H(*["-" if v is None else f"{len(v.encode())}:{v}" for v in spelled])


def climb(nodes):
    """(top, for every node its siblings level by level as (left, right))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = place - place % 3
            paths[k].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 3])))
            at[k] = place // 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    """The contract's rows, by walking lists."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    root, above = climb([below[s][0] for s in order]) if order else (None, [])
    out = []
    for s, upper in zip(order, above):
        for (_, _, own, row), path in zip(sorted(trees[s], key=lambda x: x[:3]), below[s][1]):
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            held = leaf(row, row[4].replace("\n", "")) if even and row[4] is not None else own
            for left, right in [*path, *upper]:
                held = H(left, held, right)
            out.append((row[0], own, below[s][0], root, H(*[x for step in [*path, *upper] for x in step]), held, held == root))
    return sorted(out, key=repr)


def found(frame):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    made = merkle.manifest(frame, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))))
    made = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"), "folded_root", "verified")
    return sorted(map(tuple, made.collect()), key=repr)


def rows_of(sizes):
    r, rows = random.Random(3), []
    for source, n in sizes.items():
        for _ in range(n):
            text = r.choice([None, "", "a\nb", "é\n\n", "plain", "x" * 50])
            rows.append((r.choice([None, *range(10_000)]), source, r.choice([None, "en", ""]), r.choice([None, 7]), text))
    return rows


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_against_lists(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    sizes = {None: 4, "": 1, "a": 9, "b": 10, "é": 2, "z": 3, "hot": 60, "x": 28}
    rows = rows_of(sizes)
    rows += rows[:5] + [(5, "a", "en", 1, "tie"), (5, "a", "en", 1, "another"), (5, "a", "en", 1, "another")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


@pytest.mark.parametrize("sizes", [{"one": 1}, {"one": 27}, {"a": 1, "b": 1}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_shapes(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "DIGITS", 2)
    rows = rows_of(sizes)
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_tables_without_rows_and_with_more_columns(spark):
    rows = [(1, "a", "en", 3, "a\nb"), (2, "a", "en", 900_000, "long\n" * 500_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    more = [F.lit(1).alias(c) for c in ("rank", "tree", "digest", "block", "d0", "leaf", "path", "a.b")]
    assert found(frame.select("*", *more)) == plain(rows)
    empty = merkle.manifest(frame.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "source", "leaf", "subroot", "root", "path", "folded_root", "verified"]


def test_manifest_without_tampering_verifies(spark):
    rows = rows_of({None: 3, "": 2, "a": 40})
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(made) == 45 and all(r.verified for r in made)
    assert sorted({(r.source is None, r.source or "") for r in made}) == [(False, ""), (False, "a"), (True, "")]


def test_query_against_lists(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, folder).collect()), key=repr) == plain(rows)
