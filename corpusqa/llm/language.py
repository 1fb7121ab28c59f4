"""Language of texts: first the family, then one-versus-one support vector machines among the languages of the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.grams import bucket, letter_grams, slices
from corpusqa.llm.linear import fit_hinge, sigmoid

UNKNOWN = "und"
BITS = 12  # n-grams are hashed into this many bits
LONGEST = 3  # letters of an n-gram
ROWS_PER_LANGUAGE = 600  # a classifier is fitted to so many labelled rows of each language at most
ROWS = 6000  # and to so many in all

# fixed values: language codes of some families; any other code is a family of its own
FAMILIES = {
    "germanic": "en de nl af fy lb da sv no nb nn is fo yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn mr ne pa gu",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "austronesian": "id ms jv tl mg",
    "chinese": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_BATCH = 256


def family_of(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return _FAMILY.get(code, language)


def profile(text: str | None, bits: int = BITS, longest: int = LONGEST) -> np.ndarray | None:
    """Square roots of the n-gram counts of the whole text, at unit length; None if it has no letter."""
    counts = np.zeros(1 << bits)
    for part in slices(text or ""):
        for grams in letter_grams(part, longest):
            counts += np.bincount(bucket(grams, bits), minlength=1 << bits)
    if not counts.any():
        return None
    return np.sqrt(counts / counts.sum()).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[str]
    family_weights: np.ndarray  # n-grams and bias x families
    pairs: list[tuple[int, int]]  # of languages of one family
    pair_weights: np.ndarray  # n-grams and bias x pairs

    def predict(self, profiles: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of rows of profiles."""
        rows = len(profiles)
        if not self.languages:
            return [UNKNOWN] * rows, np.zeros(rows)
        margins = profiles @ self.family_weights[:-1] + self.family_weights[-1]
        chosen = margins.argmax(axis=1)
        shares = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
        likely = (shares / shares.sum(axis=1, keepdims=True))[np.arange(rows), chosen]
        duels = sigmoid(4 * (profiles @ self.pair_weights[:-1] + self.pair_weights[-1])) if self.pairs else np.zeros((rows, 0))
        votes, sums, met = (np.zeros((rows, len(self.languages))) for _ in range(3))
        for k, (a, b) in enumerate(self.pairs):
            won = duels[:, k]
            votes[:, a] += won > 0.5
            votes[:, b] += won <= 0.5
            sums[:, a] += won
            sums[:, b] += 1 - won
            met[:, a] += 1
            met[:, b] += 1
        of = np.array([self.families.index(family_of(x)) for x in self.languages])
        within = np.where(of[None, :] == chosen[:, None], votes + 0.5 * sums / np.maximum(met, 1), -1.0)
        best = within.argmax(axis=1)
        at = np.arange(rows), best
        inside = np.where(met[at] > 0, sums[at] / np.maximum(met[at], 1), 1.0)
        return [self.languages[i] for i in best], likely * inside


def fit_languages(profiles: np.ndarray, labels: list[str]) -> LanguageModel:
    languages = sorted(set(labels))
    families = sorted({family_of(x) for x in languages})
    size = profiles.shape[1] if len(profiles) else 1 << BITS
    rows = [(np.flatnonzero(p), p[p > 0].astype(np.float64)) for p in profiles]
    of = np.array([family_of(x) for x in labels])
    named = np.array(labels)

    def machine(inside: np.ndarray, positive: np.ndarray) -> np.ndarray:
        chosen = np.flatnonzero(inside)
        return fit_hinge([rows[i] for i in chosen], np.where(positive[chosen], 1.0, -1.0), size, cost=20.0)

    everyone = np.ones(len(labels), dtype=bool)
    family_weights = [machine(everyone, of == f) if len(families) > 1 else np.zeros(size + 1) for f in families]
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if family_of(languages[a]) == family_of(languages[b])]
    pair_weights = [machine((named == languages[a]) | (named == languages[b]), named == languages[a]) for a, b in pairs]
    stack = lambda w: np.stack(w, axis=1).astype(np.float32) if w else np.zeros((size + 1, 0), np.float32)
    return LanguageModel(languages, families, stack(family_weights), pairs, stack(pair_weights))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_profiles(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_language: int, total: int) -> tuple[np.ndarray, list[str]]:
    """Profiles and labels of a bounded sample, the same at every run: the rows with the smallest hashes of their ids."""
    labelled = docs.where(learn & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"),
        (F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)).alias("place"),
    )
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    quota = min(per_language, total // max(1, len(counts)) or 1)
    below = F.lit(0.0)
    for lang, count in sorted(counts.items()):
        below = F.when(F.col("lang") == lang, F.lit(1.5 * quota / count)).otherwise(below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profile(t.as_py()) for t in batch.column(1)]
            packed = [None if p is None else p.astype("<f2").tobytes() for p in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["place", "lang", "profile"])

    sampled = labelled.where(F.col("place") < below).select("place", "text", "lang").mapInArrow(run, "place double, lang string, profile binary")
    rows = sampled.where(F.col("profile").isNotNull()).orderBy("place", "lang", "profile").limit(2 * total).collect()
    taken, profiles, labels = dict.fromkeys(counts, 0), [], []
    for row in rows:
        if taken[row["lang"]] < quota:
            taken[row["lang"]] += 1
            profiles.append(np.frombuffer(row["profile"], dtype="<f2").astype(np.float32))
            labels.append(row["lang"])
    return np.array(profiles, dtype=np.float32).reshape(len(profiles), 1 << BITS), labels


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None,
    per_language: int = ROWS_PER_LANGUAGE, total: int = ROWS,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``.

    Learns from rows with a language for which ``learn`` holds (else: the CRC-32 of the id as text modulo 3 is not 1), from at
    most ``per_language`` rows of each language and ``total`` in all; predicts every row from its whole text alone.
    Every letter n-gram of a text counts; families are told apart by one machine each, the languages of
    the family found by one machine per pair, by votes. The score multiplies the family's share by the mean outcome of the
    language's own duels.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if there is nothing to learn from.
    Ties go to the first name. Rows with a null id are not learnt from and count as not held out. Repeated rows give repeated
    results, no rows give none, further columns are not read.
    """
    learn = ~held_out(id_col) & F.col(id_col).isNotNull() if learn is None else learn
    model = fit_languages(*training_profiles(docs, learn, id_col, text_col, lang_col, per_language, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict_texts(model, batch.column(2))
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def predict_texts(model: LanguageModel, texts) -> tuple[list[str], np.ndarray]:
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for at in range(0, len(texts), _BATCH):
        found = [profile(t.as_py()) for t in texts[at : at + _BATCH]]
        known = [i for i, p in enumerate(found) if p is not None]
        if known:
            predicted, scores[[at + i for i in known]] = model.predict(np.stack([found[i] for i in known]))
            for i, name in zip(known, predicted):
                names[at + i] = name
    return names, scores


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = ROWS_PER_LANGUAGE, total: int = ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language was identified; a missing ``lang_col`` is filled in.

    Learns as ``identify_languages`` does. Rows of null texts or texts without a letter go, and all rows if there is nothing to learn from.
    Ties go to the first name, repeated rows stay or go together, no rows give none; columns may have any names.
    """
    learn = ~held_out(id_col) & F.col(id_col).isNotNull()
    model = fit_languages(*training_profiles(docs, learn, id_col, text_col, lang_col, per_language, total))
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _ = predict_texts(model, batch.column(text_at))
            columns = list(batch.columns)
            columns[lang_at] = pc.coalesce(columns[lang_at], pa.array(names, columns[lang_at].type))
            kept = pa.array([n != UNKNOWN for n in names])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(kept)

    # columns may have names that cannot be asked for by name
    numbered = docs.toDF(*[f"c{n}" for n in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
