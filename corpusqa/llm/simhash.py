"""Near-duplicate documents by SimHash fingerprints, linked by a self-join over a binary trie."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusqa.llm.components import connected_components, spanning
from corpusqa.session import materialise

SEED = 42
SHINGLE = 3
BITS = 2
SUBTREE = 131_072  # most fingerprints of a subtree that one task takes as its own
SHALLOWEST = 6  # bits of the prefixes that deal subtrees out, at least
SENT_KEYS = 2_000_000  # more keys of documents than this are joined by a shuffle and not sent to every task
STEP = 4  # bits by which the subtrees of crowded prefixes are split further

_PIECE = 1 << 22
_PAIRS = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _hashed_shingles(text: bytes | None, shingle: int) -> Iterator[list[int]]:
    """XXH64 of every word shingle of UTF-8 text, in blocks; the text is read in pieces, so that memory stays bounded."""
    carried, found, at = [], False, 0
    text = text or b""
    while at < len(text):
        end = at + _PIECE
        gap = _SPACE.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        words = carried + text[at:end].lower().split()
        at = end
        if len(words) >= shingle:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            starts = np.concatenate(([0], np.cumsum(lengths)))
            hashed = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:-shingle].tolist(), (starts[shingle:] - 1).tolist())]
            for i in range(0, len(hashed), 1 << 16):
                yield hashed[i : i + (1 << 16)]
            found = True
            words = words[-(shingle - 1) :] if shingle > 1 else []
        carried = words
    if not found and carried:
        yield [xxhash.xxh64_intdigest(b" ".join(carried), SEED)]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 text as an unsigned number."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashed in _hashed_shingles(text, shingle):
        ones += _set_bits(np.array(hashed, dtype=np.uint64).astype(">u8"))
        total += len(hashed)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _set_bits(values: np.ndarray) -> np.ndarray:
    """How many of the values have each bit set, in the order in which their bytes lie."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255  # so many sums at a time fit in a byte
    ones = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return ones + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp long) for every row: one narrow pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return chosen.mapInArrow(run, "doc_id long, text_hash long, fp long")


def trie_links(ours: np.ndarray, theirs: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of fingerprints that differ in at most ``bits`` bits, in blocks.

    Both arrays are sorted and unsigned, without repeats. ``theirs`` None: the pairs within ``ours``, each once.
    A node of the trie is the run of fingerprints that share a prefix. Pairs of nodes go down together, bit by bit;
    a pair whose prefixes differ in more bits than allowed is dropped with everything below it. Large sets of pairs are
    worked off in blocks, depth first.
    """
    alone = theirs is None
    theirs = ours if alone else theirs
    if not len(ours) or not len(theirs):
        return
    todo = [(0, np.array([[0, len(ours), 0, len(theirs), 0]], dtype=np.int64))]
    while todo:
        depth, pairs = todo.pop()
        if len(pairs) > _PAIRS:
            todo += [(depth, pairs[i : i + _PAIRS]) for i in range(0, len(pairs), _PAIRS)]
            continue
        a0, a1, b0, b1, errors = pairs.T
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(ours[i] ^ theirs[j]) <= bits
            near &= (i != j) if alone else True
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, errors = (x[~single] for x in (a0, a1, b0, b1, errors))
        if not len(a0) or depth == 64:
            continue
        am, bm = _split(ours, a0, a1, depth), _split(theirs, b0, b1, depth)
        same = (a0 == b0) & (a1 == b1) if alone else np.zeros(len(a0), dtype=bool)
        children = [
            np.stack([a0, am, b0, bm, errors], axis=1),
            np.stack([am, a1, bm, b1, errors], axis=1),
            np.stack([a0, am, bm, b1, errors + 1], axis=1),
            np.stack([am, a1, b0, bm, errors + 1], axis=1)[~same],
        ]
        pairs = np.concatenate(children)
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= bits)]
        if len(pairs):
            todo.append((depth + 1, pairs))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where, in each run that shares ``depth`` bits, the next bit becomes one."""
    bit = np.uint64(1 << (63 - depth))
    above = ~np.uint64((1 << (64 - depth)) - 1)
    return np.clip(np.searchsorted(values, (values[lo] & above) | bit), lo, hi)


def linked_fingerprints(fps: DataFrame, bits: int = BITS, subtree: int = SUBTREE, shallowest: int = SHALLOWEST) -> DataFrame:
    """fps(fp long, distinct) -> links(a, b), pairs within ``bits`` bits, that connect all such fingerprints.

    The top of the trie is dealt out: a task owns the subtree below a prefix and is visited by the fingerprints of
    all later subtrees whose prefix differs in at most ``bits`` bits, which are the node pairs that a traversal from the root
    reaches there. Prefixes are as long as the number of fingerprints asks for; where one still holds more than
    ``subtree`` (a crowd of near copies), its fingerprints are dealt out by longer prefixes. A task returns a spanning
    forest of the pairs that it found and not all of them. Each fingerprint travels to about C(prefix bits, ``bits``) / 2 tasks.
    """
    count = fps.count()
    depth = max(shallowest, math.ceil(math.log2(max(count, 1) / subtree)) if count > subtree else 0)
    rest, settled = fps, []
    while True:
        held = rest.withColumn("node", _prefix(depth))
        crowded = None
        if depth < 64:
            crowded = materialise(held.groupBy("node").count().where(F.col("count") > subtree).select("node"), "crowded")
            if crowded.isEmpty():
                crowded = None
        settled.append((depth, held if crowded is None else held.join(crowded, "node", "left_anti")))
        if crowded is None:
            break
        rest, depth = held.join(crowded, "node", "left_semi").select("fp"), min(64, depth + STEP)
    parts = []
    for depth, held in settled:
        parts.append(held.select(F.lit(depth).alias("depth"), "node", "fp", F.lit(False).alias("visits")))
        for other, owners in settled:
            if other > depth:
                continue
            flips = F.explode(F.array(*[F.lit(m) for m in _flips(other, bits) if m or other < depth]))
            visits = held.select("fp", _prefix(other).alias("own"), flips.alias("flip"))
            visits = visits.select(F.lit(other).alias("depth"), F.col("own").bitwiseXOR(F.col("flip")).alias("node"), "fp", F.lit(True).alias("visits"), "own")
            if other == depth:
                visits = visits.where(_less("own", "node"))
            if len(settled) > 1:
                visits = visits.join(owners.select("node").distinct(), "node", "left_semi")
            parts.append(visits.select("depth", "node", "fp", "visits"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)

    def join(frame):
        import pandas as pd

        values, visits = frame["fp"].to_numpy(), frame["visits"].to_numpy()
        ours = np.sort(values[~visits].view(np.uint64))
        theirs = np.sort(values[visits].view(np.uint64))
        everyone = np.concatenate([ours, theirs])
        roots = np.arange(len(everyone))
        links = [np.zeros((2, 0), dtype=np.int64)]
        for other, shift in ((None, 0), (theirs, len(ours))):
            for i, j in trie_links(ours, other, bits):
                pairs = np.stack([i, j + shift])
                links.append(pairs[:, spanning(*pairs, roots)])
        i, j = np.concatenate(links, axis=1)
        return pd.DataFrame({"a": everyone[i].view(np.int64), "b": everyone[j].view(np.int64)})

    return rows.groupBy("depth", "node").applyInPandas(join, "a long, b long")


def _prefix(depth: int):
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def _less(a: str, b: str):
    """Unsigned comparison."""
    least = F.lit(-(1 << 63))
    return F.col(a).bitwiseXOR(least) < F.col(b).bitwiseXOR(least)


def _flips(depth: int, bits: int) -> list[int]:
    import itertools

    masks = [sum(1 << k for k in chosen) for n in range(min(bits, depth) + 1) for chosen in itertools.combinations(range(depth), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, subtree: int = SUBTREE,
    shallowest: int = SHALLOWEST,
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    Texts are lower-cased in A-Z only and cut into words at ASCII white space; the fingerprint has a bit set where
    more than half of the XXH64 hashes of all word shingles, repeats included, have it. Documents whose fingerprints differ
    in at most ``bits`` bits are linked, and a component is what links reach; its id is its smallest doc_id.

    Equal fingerprints are one node of the graph, so copies cost nothing beyond their own row. Null and empty texts, and
    those of white space only, have fingerprint zero, linked like any other. Texts of fewer words than a shingle are one
    shingle. Repeated rows give repeated results; a row with a null doc_id gets its group's component like
    any other row, and null if all ids of the group are null. No rows give no rows; further columns are not read.
    """
    found = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = fingerprint_groups(found, bits, subtree, shallowest).select("fp", "component_id")
    return found.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_groups(found: DataFrame, bits: int = BITS, subtree: int = SUBTREE, shallowest: int = SHALLOWEST) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of ``found`` (doc_id, fp)."""
    firsts = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(linked_fingerprints(firsts.select("fp"), bits, subtree, shallowest))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT_KEYS) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group of near duplicates.

    Texts are near duplicates from a similarity (Jaccard) of 0.8 of the sets of their five-word shingles on, and no others are; a
    group is what such pairs reach. The row with the smallest id stays (rows without one only if the whole group has none);
    of rows with that id the one whose text has the smaller hash, and one of rows equal in both. Null, empty and blank texts are one
    group. Columns may have any names, further ones are kept. The keys of the rows that go are written and counted: up to ``sent`` of them are sent to every task, more are
    met by a shuffle of the documents. No rows give none.
    """
    from corpusqa.llm.jaccard import similar_groups, sketches

    found = materialise(sketches(docs, id_col, text_col), "sketched")
    groups = similar_groups(docs, found, text_col, sent)
    grouped = found.join(groups, "text_hash", "left").select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))
    counted = grouped.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    first = counted.groupBy("root").agg(F.min(place).alias("first"))
    judged = counted.join(first, "root").select("doc_id", "text_hash", "rows", place.eqNullSafe(F.col("first")).alias("stays"))
    judged = materialise(judged.where(~F.col("stays") | (F.col("rows") > 1)), "judged")
    gone, repeated = judged.where(~F.col("stays")), judged.where(F.col("stays"))
    kept = _met(docs, gone, id_col, text_col, "left_anti", sent)
    if repeated.isEmpty():
        return kept
    twice = _met(kept, repeated, id_col, text_col, "left_semi", sent)
    number = F.row_number().over(Window.partitionBy(F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))).orderBy(F.lit(0)))
    once = twice.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), number.alias("number")).where("number = 1").select("row.*")
    return _met(kept, repeated, id_col, text_col, "left_anti", sent).unionByName(once)


def _met(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str, sent: int) -> DataFrame:
    """Rows of ``docs`` that have (left_semi) or lack (left_anti) a key; columns of the same name on both sides are told apart."""
    same = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(F.col(f"d.`{text_col}`").cast("string")) == F.col("k.text_hash"))
    keys = keys.select("doc_id", "text_hash")
    return docs.alias("d").join((F.broadcast(keys) if keys.count() <= sent else keys).alias("k"), same, how)
