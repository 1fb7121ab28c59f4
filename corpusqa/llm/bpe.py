"""Byte-pair encoding of whole tables of texts, and decoding, by rounds of merges over flat arrays."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = np.iinfo(np.int32).max
CACHED = 200_000  # chunks a task remembers before it starts anew
ROUNDS = 4096  # symbols; longer words are merged through a heap, as rounds would cost their length for every rank

_PIECE = 1 << 21
_SPACE = regex.compile(r"\p{White_Space}+")
_UNSURE = regex.compile(r"[\x1c-\x1f]")
_RIGHT = 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """A vocabulary with word ends, as its JSON file describes it.

    Text between special tokens is put in NFC, lower-cased character by character and cut into words by the
    file's pattern; white space is dropped. A word's bytes are merged by rank, lowest first, leftmost first.
    Which characters are letters or numbers is as recent as the Unicode of the ``regex`` module.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (1 + max([*vocab.values(), *specials.values()]))
        for token, number in [*vocab.items(), *specials.items()]:
            tokens[number] = token
        self.tokens = [t.encode() for t in tokens]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << _RIGHT | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.specials = specials
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._word = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self._special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")")

    def split(self, chunk: str) -> Iterator[str | int]:
        """The words of a chunk without white space; special tokens as their ids."""
        for part in self._special.split(chunk) if "<|" in chunk else (chunk,):
            if part in self.specials:
                yield self.specials[part]
            elif part:
                yield from self._word.findall(part if part.isascii() and part.islower() else lowered(part))

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word. Symbols of all words lie in one array; each round merges every word's lowest-ranked pair."""
        out: list[np.ndarray | None] = [None] * len(words)
        chosen = []
        for n, word in enumerate(words):
            if len(word) > ROUNDS:
                out[n] = self._encode_long(word)
            else:
                chosen.append(n)
        lengths = np.array([len(words[n]) for n in chosen], dtype=np.int64)
        flat = np.frombuffer(b"".join(words[n] for n in chosen), dtype=np.uint8)
        symbols, owner = self.inner[flat], np.repeat(np.array(chosen, dtype=np.int64), lengths)
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        while len(symbols):
            at, made, rank = self._pairs(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = NEVER
            rank = np.append(rank, NEVER)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            done = lowest == NEVER
            if done.any():
                ids, of = symbols[done], owner[done]
                cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
                for n, part in zip(of[np.append(0, cuts)].tolist(), np.split(ids, cuts)):
                    out[n] = part
            merge = (rank == lowest) & ~done
            places = np.flatnonzero(merge)
            # of overlapping equal pairs, as in "aaa", every second one merges, from the left
            fresh = np.append(True, np.diff(places) != 1)[: len(places)]
            run = np.flatnonzero(fresh)
            offset = np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))
            places = places[offset % 2 == 0]
            symbols[places] = made[places]
            keep = ~done
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = left << _RIGHT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.made[at], np.where(self.keys[at] == key, self.ranks[at], NEVER).astype(np.int32)

    def _encode_long(self, word: bytes) -> np.ndarray:
        """The same for one long word: a heap of (rank, place) over a linked list of symbols."""
        flat = np.frombuffer(word, dtype=np.uint8)
        symbols = self.inner[flat]
        symbols[-1] = self.last[flat[-1]]
        _, made, rank = self._pairs(symbols[:-1], symbols[1:])
        known = {}
        heap = [(r, i, a, b, m) for i, (r, a, b, m) in enumerate(zip(rank.tolist(), symbols[:-1].tolist(), symbols[1:].tolist(), made.tolist())) if r != NEVER]
        heapq.heapify(heap)
        held, after, before = symbols.tolist(), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        size = len(held)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if held[i] != a or j >= size or held[j] != b:
                continue
            held[i], held[j] = m, -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < size:
                    pair = held[x], held[y]
                    if pair not in known:
                        _, new, r = self._pairs(np.array(pair[:1]), np.array(pair[1:]))
                        known[pair] = (int(r[0]), int(new[0]))
                    r, new = known[pair]
                    if r != NEVER:
                        heapq.heappush(heap, (r, x, *pair, new))
        return np.array([s for s in held if s >= 0], dtype=np.int64)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, packed as little-endian unsigned 32-bit numbers."""
        parts = [list(self.split(c)) for c in chunks]
        words = list({w: None for p in parts for w in p if isinstance(w, str)})
        packed = dict(zip(words, (ids.astype("<u4").tobytes() for ids in self.encode_words([w.encode() for w in words]))))
        return [b"".join(packed[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in p) for p in parts]

    def decode(self, packed: bytes) -> bytes:
        """The tokens of packed ids with a space between them, in UTF-8: this vocabulary's file names no decoder."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])


def lowered(text: str) -> str:
    """NFC and lower case character by character: a capital sigma becomes the same letter everywhere."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pieces(text: str) -> Iterator[list[str]]:
    """The chunks between white space, some two million characters at a time."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        gap = _SPACE.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        part = text[at:end]
        yield [c for c in _SPACE.split(part) if c] if _UNSURE.search(part) else part.split()
        at = end


def bpe_encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string): every whole text encoded and decoded again, one row per row.

    ``path`` is the vocabulary file, read on the driver; its arrays (a few MB) go to the tasks. ``ids`` holds
    little-endian unsigned 32-bit numbers. Special tokens written out in a text are encoded as such; none are
    added. Null, empty and blank texts have no ids and decode to an empty text; null ids of documents pass through. Equal texts
    give equal results, no rows give none, further columns are not read. A text is encoded in pieces cut at white
    space, at which no token crosses; what grows with a text is its own result only.
    """
    model = WordBpe(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, bytes] = {}

        def encoded(chunks: list[str]) -> bytes:
            return b"".join(map(cache.__getitem__, chunks))

        def learn(chunks: set[str]) -> None:
            new = [c for c in chunks if c not in cache]
            if len(cache) + len(new) > CACHED:
                cache.clear()
                new = list(chunks)
            cache.update(zip(new, model.encode_chunks(new)))

        def flush(held):
            learn({c for _, chunks in held for c in chunks})
            ids = [encoded(chunks) for _, chunks in held]
            return result([i for i, _ in held], ids)

        def result(numbers, ids):
            decoded = [model.decode(x) for x in ids]
            return pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

        for batch in batches:
            held, size = [], 0
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if len(text) > _PIECE:
                    ids = []
                    for chunks in pieces(text):
                        learn(set(chunks))
                        ids.append(encoded(chunks))
                    yield result([number], [b"".join(ids)])
                    continue
                held.append((number, next(pieces(text), [])))
                size += len(text)
                if size > _PIECE:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids binary, decoded string")
