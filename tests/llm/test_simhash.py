import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusqa.llm.components import connected_components
from corpusqa.llm import simhash
from corpusqa.llm.components import local_roots, spanning
from corpusqa.llm.simhash import fingerprint, keep_one_of_each_group, linked_fingerprints, simhash_components, trie_links

from test_jaccard import plain_groups


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashed = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(ids, fps, bits=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return {i: min((ids[k] for k in range(len(ids)) if find(k) == find(n) and ids[k] is not None), default=None) for n, i in enumerate(ids)}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÉ \t\n x\U0001f600", max_size=60))
def test_fingerprint_is_the_plain_one(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_reads_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(3).choices("alpha beta gamma delta eps".split(), k=3000))
    whole = fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_PIECE", 64)
    assert fingerprint(text.encode()) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_trie_finds_all_pairs(bits):
    r = random.Random(bits)
    base = [r.getrandbits(64) for _ in range(30)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(12)} | {0, 2**64 - 1}
    x = np.array(sorted(values), dtype=np.uint64)
    found = {tuple(sorted((int(x[i]), int(x[j])))) for a, b in trie_links(x, None, bits) for i, j in zip(a, b)}
    wanted = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= bits}
    assert found == wanted
    y = np.array(sorted(values)[::3], dtype=np.uint64)
    across = {(int(x[i]), int(y[j])) for a, b in trie_links(x, y, bits) for i, j in zip(a, b)}
    assert across == {(a, int(b)) for a in values for b in y if (a ^ int(b)).bit_count() <= bits}


@pytest.mark.parametrize("subtree, shallowest", [(1 << 17, 6), (30, 2)])
def test_dealt_out_subtrees_link_everything(spark, subtree, shallowest):
    """Small subtrees make the crowded prefixes split several times."""
    r = random.Random(7)
    crowd = r.getrandbits(64)
    values = {crowd ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for _ in range(150)} | {r.getrandbits(64) for _ in range(100)}
    ids = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in ids], "fp long")
    found = {n % (1 << 64): root % (1 << 64) for n, root in connected_components(linked_fingerprints(frame, 2, subtree, shallowest)).collect()}
    groups = lambda of: sorted(sorted(x for x in ids if of[x] == g) for g in set(of.values()))
    assert groups({v: found.get(v, v) for v in ids}) == groups(plain_components(ids, ids))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (5, 4)]
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_documents(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    text = " ".join(r.choices(words, k=200))
    rows = [(9, text), (4, text + " end"), (5, text.upper().replace(" ", "\n\t")), (1, " ".join(r.choices(words, k=200)))]
    rows += [(20, None), (21, ""), (22, " \n "), (30, "two words"), (31, "Two  Words"), (30, "two words"), (None, "alone here now"), (None, text), (40, "long " * 300_000)]
    docs = spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], "doc_id long, text string, fp string, component_id string")
    found = simhash_components(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    by_row = sorted((i or 0, f, c or 0) for i, f, c in found.collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    numbered = plain_components(list(range(len(rows))), fps)
    wanted = []
    for n, (i, _) in enumerate(rows):
        same = [rows[k][0] for k in range(len(rows)) if numbered[k] == numbered[n] and rows[k][0] is not None]
        wanted.append((i or 0, f"{fps[n]:016x}", min(same, default=0)))
    assert by_row == sorted(wanted)
    assert found.where("doc_id in (4, 5, 9)").select("component_id").distinct().count() == 1


def test_no_rows(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_plain_loops(spark):
    from corpusqa.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    wanted = plain_components([d.doc_id for d in docs], fps)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash_dedup"](spark, folder).collect()}
    assert found == {d.doc_id: (f"{fp:016x}", wanted[d.doc_id]) for d, fp in zip(docs, fps)}


def edited(words, n, r):
    places = set(r.sample(range(len(words)), n))
    return [f"changed{r.random()}" if k in places else w for k, w in enumerate(words)]


def test_near_copies_go_and_others_stay(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for group in range(12):
        words = r.choices(vocabulary, k=300)
        rows += [(100 * group + k, " ".join(edited(words, 3 if k else 0, r))) for k in range(8)]  # similarity of at least 0.9 to the first
    rows += [(5000 + i, " ".join(r.choices(vocabulary, k=200))) for i in range(40)]
    half = r.choices(vocabulary, k=150)
    rows += [(6000 + i, " ".join(half + r.choices(vocabulary, k=250))) for i in range(5)]  # a shared passage is no copy
    rows += [(7000, None), (7001, ""), (7002, "  "), (None, rows[0][1]), (5000, rows[96][1])]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, signature string, node int")
    kept = keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = sorted(x.doc_id for x in kept.collect())
    assert ids == sorted([100 * g for g in range(12)] + [5000 + i for i in range(40)] + [6000 + i for i in range(5)] + [7000])
    groups = plain_groups([t for _, t in rows])
    assert len(set(groups)) == len(ids)
    assert keep_one_of_each_group(docs, sent=0).count() == len(ids) and keep_one_of_each_group(docs.limit(0)).count() == 0


def test_spanning_links_connect_what_all_links_do():
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 200, size=(2, 400))
    roots = np.arange(200)
    kept = spanning(a, b, roots)
    wanted = local_roots(a, b, 200)
    assert (local_roots(a[kept], b[kept], 200) == wanted).all() and len(kept) == 200 - len(np.unique(wanted))


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(random.Random(3).choices("alpha beta gamma delta eps".split(), k=3000)).encode()
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 64)
    assert fingerprint(text) == whole and fingerprint(b"") == fingerprint(None) == 0
