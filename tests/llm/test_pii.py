import hashlib
import re

import pytest

from corpusqa.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain(text):
    spans = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(number) <= 19 and luhn(number)):
                continue
            if kind == "phone" and not 9 <= len(number) <= 15:
                continue
            spans.append((kind, m.start(), m.end()))
    return spans


TEXTS = [
    None, "", " ", "a@b.c%d@e.f", "a@b.c.d@e.f@g.h", "x.y_z@m-1.co.uk, é\U0001f600 q@r.s", "@a.b a@b a@.b.c a@b..c", "a%@b.c-@d.e.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.0003.255 1.2.3", "0.0.0.0000 99999999999999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "4111111111111111 5500005555555559 00000000000000000000 0000000000000", "+1 (456) 555-2186 4111 1111 1111 1111 +49 30 1234", "+12 +1-- +1 2", "+1 (((2 +123456789012345678",
    "call 030 1234567, or 0171/555 66 77; id 0171 5556677", "my IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 not GB82WEST12345698765433",
    "\U0001f600\U0001f600 a@b.cd \U0001f600 4111111111111111", "1-2-3-4-5-6-7-8-9-0-1-2-3 1 - 2", "a" * 50 + "@" + "b" * 30 + ".c" * 40, "a@b.c" * 9, "ip 1.1.1.1" * 300,
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "clash", 0) for i, t in enumerate(TEXTS)] + [(None, "a@b.cd", "x", 1), (3, TEXTS[3], "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string, _email int")
    return pii.find_pii(docs).collect()


def test_base_spans_are_the_plain_ones(found):
    assert len(found) == len(TEXTS) + 2
    for row in found:
        text = TEXTS[row.doc_id] if row.doc_id is not None else "a@b.cd"
        assert [(s.kind, s.begin, s.end) for s in row.pii if s.kind in pii.BASE] == plain(text), text


def test_added_kinds(found):
    by_id = {r.doc_id: [(TEXTS[r.doc_id][s.begin : s.end], s.kind, s.score) for s in r.pii] for r in found if r.doc_id is not None and TEXTS[r.doc_id]}
    accounts = by_id[next(i for i, t in enumerate(TEXTS) if t and "IBAN" in t)]
    assert [(m, k) for m, k, _ in accounts] == [("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban")]
    assert accounts[0][2] == 1.0 and accounts[1][2] == 0.8
    phones = by_id[next(i for i, t in enumerate(TEXTS) if t and "030" in t)]
    assert [(m, k) for m, k, _ in phones] == [("030 1234567", "local_phone"), ("0171/555 66 77", "local_phone"), ("0171 5556677", "local_phone")][: len(phones)] and phones


def test_masking(spark):
    both = spark.createDataFrame([(1, "tel +1 (456) 555-2186 4111 1111 1111 1111, 5 4111111111111111")], "doc_id long, text string")
    row = pii.find_pii(both).first()
    assert [(row.text[s.begin : s.end], s.kind) for s in row.pii] == [
        ("4111 1111 1111 1111", "card_in_run"), ("4111111111111111", "card_in_run"), ("+1 (456) 555-2186", "phone_in_run")
    ]
    docs = spark.createDataFrame([(1, "to é a@b.cd, +1 (456) 555-2186 end"), (2, "none"), (3, None), (4, "+4111111111111111 x"), (5, "a@b.cd " * 400)], "doc_id long, text string")
    out = dict(pii.with_masked(pii.find_pii(docs), "text", "pii").select("doc_id", "text").collect())
    assert out[1] == "to é [EMAIL], [PHONE] end" and out[2] == "none" and out[3] == ""
    assert out[4] == "+[CARD] x" and out[5] == "[EMAIL] " * 400


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000, "a." * 400_000 + "@", "+1" + "(" * 1_000_000, "1 " * 400_000, "a@b.c " * 20_000, "1." * 50_000])
def test_long_texts_take_little_time(spark, text):
    import time

    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    row = pii.find_pii(docs).select(pii.listed(pii.base_spans(pii.F.col("pii"))).alias("spans")).first()
    assert time.time() - start < 30
    assert row.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text)) if len(text) < 700_000 and not text.startswith("a.") else row.spans == ""


def test_query_against_plain_loops(spark):
    from corpusqa.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    wanted = {}
    for d in docs:
        spans = plain(d.text)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        wanted[d.doc_id] = tuple(sum(k == kind for k, *_ in spans) for kind in pii.BASE) + (hashlib.sha256(text.encode()).hexdigest(),)
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in QUERIES["op8_pii"](spark, folder).collect()}
    assert got == wanted


def test_no_rows(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
