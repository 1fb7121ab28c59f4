"""License notices in texts: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.grams import chained
from corpusqa.llm.license_texts import TEMPLATES

SHINGLE = 5  # words; a template of fewer words is one shingle of all its words
CONTAINMENT = 0.8  # of a template's shingles must stand in a window
BANDS = 48  # of one hash each: a window that holds a template shares one of them with a chance of over 0.99999
REMEMBERED = 300_000  # words whose hashes a task keeps

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > REMEMBERED:
        known.clear()
    new = set(words).difference(known)
    known.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_FACTORS = (np.random.default_rng(11).integers(0, 1 << 62, size=BANDS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_BAND = np.arange(BANDS, dtype=np.uint64) << np.uint64(32)
_MARKED = np.uint64(44)


def permuted(shingles: np.ndarray) -> np.ndarray:
    """BANDS x shingles: each band's hash of each shingle."""
    return ((shingles[None, :] ^ (shingles[None, :] >> np.uint64(31))) * _FACTORS[:, None]) >> np.uint64(32)


@dataclass
class Template:
    number: int
    license: str
    shingles: np.ndarray  # ascending, without repeats


class Class:
    """Templates of about one size: windows of three steps hold any of them whole, wherever it starts.

    ``keys`` are the bands and MinHash values of all its templates, ascending; ``firsts`` the shingles those values come from. A window
    without one of these has no value in common with a template.
    """

    def __init__(self, step: int, templates: list[Template]):
        self.step, self.templates = step, templates
        keys, firsts = [], []
        for t in templates:
            hashes = permuted(t.shingles)
            at = hashes.argmin(axis=1)
            keys.append(hashes[np.arange(BANDS), at] | _BAND)
            firsts.append(t.shingles[at])
        of = np.repeat(np.arange(len(templates)), BANDS)
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        self.keys, self.of, self.firsts = flat[order], of[order], np.unique(np.concatenate(firsts))

    def met(self, window: np.ndarray) -> set[int]:
        """Places of the templates that share a band with a window."""
        values = permuted(window).min(axis=1) | _BAND
        lo, hi = np.searchsorted(self.keys, values, side="left"), np.searchsorted(self.keys, values, side="right")
        return {int(k) for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist()) for k in self.of[a:b]}


class Group:
    """The classes of templates with shingles of one length, and a table of marks by which most shingles of texts are passed over."""

    def __init__(self, shingle: int, classes: list[Class]):
        self.shingle, self.classes = shingle, classes
        self.marks = np.zeros(1 << (64 - int(_MARKED)), dtype=bool)
        for c in classes:
            self.marks[c.firsts >> _MARKED] = True


def groups_of(templates) -> list[Group]:
    known: dict[str, int] = {}
    found: dict[int, dict[int, list[Template]]] = {}
    for number, (name, text) in enumerate(templates):
        words = words_of(text)
        if words:
            shingle = min(SHINGLE, len(words))
            size = len(words) - shingle + 1
            step = max(1, 1 << int(np.ceil(np.log2(max(size - 1, 1) / 2))) if size > 2 else 1)
            shingles = np.unique(chained(word_hashes(words, known), shingle))
            found.setdefault(shingle, {}).setdefault(step, []).append(Template(number, name, shingles))
    return [Group(n, [Class(step, found[n][step]) for step in sorted(found[n])]) for n in sorted(found)]


Place = tuple[int, str, float, int, int]  # template, license, containment, first word, words


def apart(places: list[Place]) -> list[Place]:
    """The best of the places, and of those that do not overlap with it, the first of equally good ones."""
    kept: list[Place] = []
    taken: list[tuple[int, int]] = []  # ascending and disjoint
    for place in sorted(places, key=lambda p: (-p[2], -p[4], p[3], p[0])):
        first, end = place[3], place[3] + place[4]
        at = bisect.bisect_left(taken, (first, end))
        if (at and taken[at - 1][1] > first) or (at < len(taken) and taken[at][0] < end):
            continue
        taken.insert(at, (first, end))
        kept.append(place)
    return kept


def shortest(place: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The part of ``place`` that spans least and has all different values: a window can hold a notice and a piece of the next."""
    wanted, counts, best, begin = len(np.unique(values)), {}, (0, len(place)), 0
    for end, value in enumerate(values.tolist(), 1):
        counts[value] = counts.get(value, 0) + 1
        while len(counts) == wanted:
            if place[end - 1] - place[begin] < place[best[1] - 1] - place[best[0]]:
                best = (begin, end)
            first = int(values[begin])
            counts[first] -= 1
            if not counts[first]:
                del counts[first]
            begin += 1
    return place[best[0] : best[1]]


def places_in(hashed: np.ndarray, groups: list[Group], containment: float = CONTAINMENT) -> list[Place]:
    """The places of each template in a text that do not overlap with a better place of the same template."""
    found: dict[int, set[Place]] = {}
    for group in groups:
        shingles = chained(hashed, group.shingle)
        marked = np.flatnonzero(group.marks[shingles >> _MARKED])
        for c in group.classes if len(marked) else ():
            hits = marked[np.isin(shingles[marked], c.firsts)]
            starts = np.unique(np.concatenate([hits // c.step - k for k in range(3)])) * c.step
            for lo in starts[starts >= 0].tolist():
                part = shingles[lo : lo + 3 * c.step]
                for t in [c.templates[k] for k in sorted(c.met(part))]:
                    place = np.flatnonzero(np.isin(part, t.shingles))
                    share = len(np.unique(part[place])) / len(t.shingles)
                    if share >= containment:
                        place = shortest(place, part[place])
                        found.setdefault(t.number, set()).add((t.number, t.license, share, int(lo + place[0]), int(place[-1] - place[0] + group.shingle)))
    return [p for k in sorted(found) for p in sorted(apart(list(found[k])), key=lambda p: p[3])]


def find_licenses(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, every_template: bool = True) -> DataFrame:
    """(doc_id, template, license, containment, first_word, n_words): one row per document, template found in it and place.

    Words are runs of letters and digits, in lower case. A text is cut into overlapping windows, for each size of templates
    of its own, such that every place a template could stand lies within one window; a window whose MinHash
    equals the template's in one band is compared by its word shingles. A template is found if ``containment`` of its different shingles
    stand in a window; of overlapping windows the best is returned, the first of equally good ones, and every place that does not
    overlap. Without ``every_template`` that holds across templates too: where notices are alike, the best-contained one is the license.

    ``templates`` are (license, text) pairs, at most some thousands, which go to every task; the work on a text does not grow with them, but with the
    windows that share a shingle. A template of fewer words than a shingle is found where all its words stand. Null and empty
    texts have no rows. Repeated rows give repeated results, null ids pass through, no rows give none, further columns are not read. A long text
    takes eight bytes for each word beside it.
    """
    groups = groups_of(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                places = places_in(word_hashes(words_of(text.as_py()), known), groups, containment)
                for row in places if every_template else sorted(apart(places), key=lambda p: p[3]):
                    for column, value in zip(out, (number, *row)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "template", "license", "containment", "first_word", "n_words"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, template int, license string, containment double, first_word int, n_words int")
