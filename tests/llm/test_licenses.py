import random
import re

import numpy as np
import pytest

from corpusqa.llm import licenses as L


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def runs(sequence, n):
    return [tuple(sequence[i : i + n]) for i in range(len(sequence) - n + 1)]


def shares(text, notice, wider):
    """The best share of a notice's runs of words in any stretch of a text: as long as the notice, or ``wider`` times."""
    wanted = words(notice)
    n = min(5, len(wanted))
    have, wanted = runs(words(text), n), set(runs(wanted, n))
    reach = round(wider * len(wanted)) + (3 if wider > 1 else 0)
    near = [i for i, x in enumerate(have) if x in wanted]
    return max((len(wanted.intersection(have[i : i + reach])) / len(wanted) for i in near), default=0.0)


def texts():
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    out = [None, "", "a b", "Released under the MIT License", L.TEMPLATES[0][1], "// SPDX-License-Identifier: MIT", "SPDX License Identifier"]
    for _ in range(120):
        body = r.choices(vocabulary, k=r.randint(0, 300))
        notice = r.choice(L.TEMPLATES)[1].split()
        if r.random() < 0.4 and len(notice) > 12:
            notice[r.randrange(len(notice))] = "changed"
        if r.random() < 0.2 and len(notice) > 30:
            del notice[r.randrange(len(notice) // 2) :]
        at = r.randint(0, len(body))
        out.append(" ".join(body[:at] + notice + body[at:]))
    return out


def test_against_runs_of_words(spark):
    """What stands whole or nearly whole in one stretch is found, and nothing else."""
    assert len(L.TEMPLATES) >= 100
    rows = list(enumerate(texts())) + [(None, L.TEMPLATES[4][1]), (4, L.TEMPLATES[0][1])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, license string")
    found = {(r.doc_id, r.template): r.containment for r in L.find_licenses(docs).collect()}
    surely, possibly = set(), set()
    for i, t in rows:
        for k, (_, notice) in enumerate(L.TEMPLATES):
            if (share := shares(t, notice, 3)) >= L.CONTAINMENT:
                possibly.add((i, k))
                assert found.get((i, k), 0) <= share + 1e-9
            if (share := shares(t, notice, 1)) >= L.CONTAINMENT:
                surely.add((i, k))
                assert found[i, k] >= share - 1e-9
    assert surely <= found.keys() <= possibly and len(surely) > 150
    assert L.find_licenses(docs.limit(0)).count() == 0


def test_every_template_is_found_wherever_it_stands():
    groups = L.groups_of(L.TEMPLATES)
    for number, (_, text) in enumerate(L.TEMPLATES):
        for shift in range(0, 70, 7):
            hashed = L.word_hashes([f"x{i}" for i in range(shift)] + words(text) + ["y"] * 9, {})
            found = {k: (share, first, n) for k, _, share, first, n in L.places_in(hashed, groups)}
            assert found[number][:2] == (1.0, shift) or len(set(runs(words(text), 5))) < len(runs(words(text), 5))


def test_more_templates_change_nothing():
    """Thousands of other templates in the table: the same places."""
    r = random.Random(4)
    others = [("other", " ".join(r.choices([f"w{i}" for i in range(3000)], k=r.choice([2, 4, 9, 40])))) for _ in range(3000)]
    few, many = L.groups_of(L.TEMPLATES), L.groups_of([*L.TEMPLATES, *others])
    for text in texts()[:40]:
        hashed = L.word_hashes(words(text), {})
        assert L.places_in(hashed, few) == [p for p in L.places_in(hashed, many) if p[1] != "other"]


def test_bands_meet_at_the_containment_in_the_widest_window():
    r = np.random.default_rng(0)
    met = 0
    for _ in range(300):
        template = np.unique(r.integers(0, 1 << 63, size=40).astype(np.uint64))
        window = np.concatenate([template[:32], r.integers(0, 1 << 63, size=120 - 32).astype(np.uint64)])
        met += L.Class(32, [L.Template(0, "x", template)]).met(window) == {0}
    assert met == 300


def test_every_place_and_the_right_one_of_like_notices(spark):
    """Notices of the LGPL and AGPL hold 0.8 of the GPL's; each is found as itself, at each of its places."""
    gnu = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    gpl = gnu.format("program", "General Public", "3")
    full = {name: max((t for n, t in L.TEMPLATES if n == name), key=len) for name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib")}
    rows = [
        (0, gpl + " filler words between the two " * 5 + gpl, ["GPL-3.0", "GPL-3.0"]),
        (1, gnu.format("program", "General Public", "2"), ["GPL-2.0"]),
        (2, gnu.format("program", "Lesser General Public", "3"), ["LGPL-3.0"]),
        (3, gnu.format("program", "Affero General Public", "3"), ["AGPL-3.0"]),
        (4, gnu.format("library", "Lesser General Public", "2.1") + " some words. Released under the MIT License.", ["LGPL-2.1", "MIT"]),
        (5, "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at x", ["EPL-2.0"]),
        (6, "# SPDX-License-Identifier: MIT\nimport x", ["MIT"]),
        (7, "/* SPDX-License-Identifier: GPL-2.0-or-later */", ["GPL-2.0-or-later"]),
        (8, "SPDX-License-Identifier: ISC and SPDX-License-Identifier: Zlib", ["ISC", "Zlib"]),
        (9, "see https://opensource.org/licenses/MIT", ["MIT"]),
        (10, "SPDX-License-Identifier: MIT-0", ["MIT-0"]),
        *[(20 + n, f"Copyright 2020 Somebody. {text} And code.", [name]) for n, (name, text) in enumerate(full.items())],
    ]
    found = {}
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for r in L.find_licenses(frame, every_template=False).orderBy("doc_id", "first_word").collect():
        found.setdefault(r.doc_id, []).append(r.license)
    assert found == {n: names for n, _, names in rows}


@pytest.mark.parametrize("n", [60_000])
def test_long_texts(spark, n):
    text = " ".join(f"w{i % 977}" for i in range(n)) + " " + L.TEMPLATES[1][1] + " tail" * n
    rows = L.find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), every_template=False).collect()
    assert [(r.template, r.containment, r.first_word) for r in rows] == [(1, 1.0, n)]
