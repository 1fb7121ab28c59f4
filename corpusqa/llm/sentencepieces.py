"""SentencePiece encoding and decoding of whole tables of texts: every distinct chunk is segmented once, ids are joined back by position."""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The white space marker, kinds of pieces and the model type in a model file.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2

CACHED = 400_000  # chunks in the table of a task before it starts anew
LONG = 48  # characters; longer chunks are merged through a heap, as they need a round for every merge

_PIECE = 1 << 21
_RIGHT = 20
_NEVER = 1 << 30


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def _replaced(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("a-mark-per-byte", _replaced)


class PieceBpe:
    """A BPE model with byte fallback and no rewriting of the text, as its file describes it; other models are refused.

    A space becomes a marker and one more marker is put in front. Of all neighbours that together are a piece, the
    ones whose piece has the highest score merge first, of equals the leftmost. What is no piece in the end is spelled in bytes.
    """

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        pieces, scores, kinds = [], [], []
        for number, value in message:
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0])
                kinds.append(piece.get(3, NORMAL))
        trainer = dict(_fields(next((v for n, v in message if n == 2), b"")))
        rewriting = dict(_fields(next((v for n, v in message if n == 3), b"")))
        if trainer.get(3, 1) != BPE or not trainer.get(35, 0):
            raise ValueError("not a BPE model with byte fallback")
        if rewriting.get(2) or rewriting.get(4, 1) or not rewriting.get(5, 1) or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a model that rewrites texts or has pieces of the user's own")
        self.size = len(pieces)
        self.prefix = MARK if rewriting.get(3, 1) else ""
        self.end = pieces.index("</s>")
        of_byte = {piece: n for n, piece in enumerate(pieces) if kinds[n] == BYTE}
        self.bytes = np.array([of_byte[f"<0x{b:02X}>"] for b in range(256)], dtype=np.int64)
        # what a piece shows when read back
        shown = {NORMAL: lambda n: pieces[n].replace(MARK, " ").encode(), CONTROL: lambda n: b"", UNKNOWN: lambda n: " ⁇ ".encode()}
        self.shown = [bytes([int(pieces[n][3:5], 16)]) if k == BYTE else shown[k](n) for n, k in enumerate(kinds)]
        self.led = {n for n, k in enumerate(kinds) if k == NORMAL and pieces[n].startswith(MARK)}
        self.silent = {n for n, k in enumerate(kinds) if k == CONTROL}

        known = {piece: n for n, piece in enumerate(pieces) if kinds[n] == NORMAL}
        # characters that are no piece by themselves may still be part of one
        characters = sorted({c for piece in known for c in piece if c not in known})
        symbols = known | {c: self.size + n for n, c in enumerate(characters)}
        self.letters = np.full(0x110000, -1, dtype=np.int64)
        for piece, n in symbols.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = n
        self.spelled = {n: c for c, n in symbols.items() if n >= self.size}
        ordered = {score: n for n, score in enumerate(sorted({scores[n] for n in known.values()}, reverse=True))}
        pairs = [
            (symbols[piece[:cut]] << _RIGHT | symbols[piece[cut:]], ordered[scores[n]], n)
            for piece, n in known.items()
            for cut in range(1, len(piece))
            if piece[:cut] in symbols and piece[cut:] in symbols
        ]
        keys, ranks, made = (np.array(column, dtype=np.int64) for column in zip(*sorted(pairs)))
        self.keys, self.ranks, self.made = keys, ranks, made
        self.chunk = re.compile(self._chunks(known))

    def _chunks(self, known) -> str:
        """A pattern of chunks that no piece can cross, worked out from the pieces.

        Pieces that hold a marker after another character leave whole texts as chunks. Otherwise a chunk is a run of markers
        with what follows up to the next. It is cut again between the characters beside which a piece has
        an ASCII character other than a letter, directly or by way of others, and all the rest, if letters are in the rest.
        """
        if any(MARK in piece.lstrip(MARK) for piece in known):
            return r"(?s).+"
        beside = defaultdict(set)
        for piece in known:
            bare = piece.lstrip(MARK)
            for a, b in zip(bare, bare[1:]):
                beside[a].add(b)
                beside[b].add(a)
        signs = {chr(n) for n in range(128) if not chr(n).isalpha()}
        todo = list(signs)
        while todo:
            new = beside[todo.pop()] - signs
            signs |= new
            todo += new
        if any(c.isascii() and c.isalpha() for c in signs):
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        inside = "".join(f"\\U{ord(c):08x}" for c in sorted(signs - {MARK}))
        return f"{MARK}*(?:[^{inside}{MARK}]+|[{inside}]+)|{MARK}+"

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text, some two million characters at a time."""
        marked = self.prefix + text.replace(" ", MARK) if text else ""
        at, whole = 0, self.chunk.pattern == r"(?s).+"
        cut = re.compile(f"(?<=[^{MARK}]){MARK}")
        while at < len(marked):
            gap = None if whole or at + _PIECE >= len(marked) else cut.search(marked, at + _PIECE)
            end = gap.start() if gap else len(marked)
            yield self.chunk.findall(marked, at, end)
            at = end

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of neighbours; a rank beyond all others where they make no piece."""
        key = np.where((left < 0) | (right < 0), -1, left << _RIGHT | right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER), self.made[at]

    def segment(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, packed as little-endian 32-bit numbers.

        The characters of all chunks lie in one array; a round makes the best merge of every chunk that has one left.
        """
        short = [n for n, c in enumerate(chunks) if len(c) <= LONG]
        lengths = np.array([len(chunks[n]) for n in short], dtype=np.int64)
        codes = np.frombuffer("".join([chunks[n] for n in short]).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        symbols, owner = self.letters[codes], np.repeat(np.array(short, dtype=np.int64), lengths)
        symbols = np.where(symbols < 0, -1 - codes, symbols)
        rank, made = self._pairs(symbols, np.append(symbols[1:], -1)[: len(symbols)])
        rank[np.append(owner[1:] != owner[:-1], True)[: len(rank)]] = _NEVER
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            over = lowest >> 32 == _NEVER
            out = np.repeat(over, sizes)
            if over.any():
                ended.append((owner[out], symbols[out]))
            at = lowest[~over] & 0xFFFFFFFF
            symbols[at] = made[at]
            keep = ~out
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            touched = np.concatenate([at, at[at > 0] - 1])
            after = np.minimum(touched + 1, len(symbols) - 1)
            rank[touched], made[touched] = self._pairs(symbols[touched], symbols[after])
            rank[touched[(touched == after) | (owner[touched] != owner[after])]] = _NEVER
        for n, c in enumerate(chunks):
            if len(c) > LONG:
                found = self._segment_long(c)
                ended.append((np.full(len(found), n), found))
        if not ended:
            return []
        owner, symbols = (np.concatenate(column) for column in zip(*ended))
        order = np.argsort(owner, kind="stable")
        owner, symbols = owner[order], symbols[order]
        strange = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if len(strange):
            spelled = [self.spelled[s] if s >= 0 else chr(-1 - s) for s in symbols[strange].tolist()]
            times = np.ones(len(symbols), dtype=np.int64)
            times[strange] = [len(c.encode()) for c in spelled]
            places = (np.cumsum(times) - times)[strange]
            owner, symbols = np.repeat(owner, times), np.repeat(symbols, times)
            for place, c in zip(places.tolist(), spelled):
                ids = self.bytes[list(c.encode())]
                symbols[place : place + len(ids)] = ids
        packed = symbols.astype("<i4").tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(chunks)))
        return [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _segment_long(self, chunk: str) -> np.ndarray:
        """The same for one long chunk: a heap of (rank, place) over a linked list of symbols."""
        codes = np.array([ord(c) for c in chunk], dtype=np.int64)
        first = self.letters[codes]
        held = np.where(first < 0, -1 - codes, first).tolist()
        size, gone = len(held), object()
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        known: dict[tuple[int, int], tuple[int, int]] = {}
        heap: list[tuple[int, int, int, int]] = []

        def offer(place: int) -> None:
            pair = held[place], held[after[place]]
            if pair not in known:
                rank, made = self._pairs(np.array(pair[:1]), np.array(pair[1:]))
                known[pair] = int(rank[0]), int(made[0])
            if known[pair][0] != _NEVER:
                heapq.heappush(heap, (known[pair][0], place, *pair))

        for place in range(size - 1):
            offer(place)
        while heap:
            _, place, left, right = heapq.heappop(heap)
            following = after[place]
            if held[place] != left or following >= size or held[following] != right:
                continue
            held[place], held[following] = known[left, right][1], gone
            after[place] = after[following]
            if after[place] < size:
                before[after[place]] = place
                offer(place)
            if before[place] >= 0:
                offer(before[place])
        return np.array([s for s in held if s is not gone], dtype=np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        shown = b"".join([self.shown[i] for i in ids])
        first = next((i for i in ids if i not in self.silent), None)
        return (shown[1:] if self.prefix and first in self.led else shown).decode("utf-8", "a-mark-per-byte")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): every whole text encoded, with an end id, and decoded again, one row per row.

    ``path`` is the model file, read on the driver; its arrays (some ten MB) go to the tasks. A task holds a table of the
    distinct chunks it met (see ``PieceBpe.chunk``), each segmented once; ids come back by the position of a chunk. Null and empty texts have the
    end id only and decode to an empty text; blanks are kept. Control pieces written out in a text are ordinary text. Null ids of documents
    pass through, equal texts give equal results, no rows give none, further columns are not read. A long text is encoded in pieces
    cut at a marker; what grows with a text is its own result only.
    """
    model = PieceBpe(path)
    end = np.array([model.end], dtype="<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, bytes] = {}

        def joined(texts: list[list[str]]) -> list[bytes]:
            """The ids of texts given as chunks; chunks that the table lacks are segmented together."""
            found = [list(map(table.get, chunks)) for chunks in texts]
            open_ = [n for n, ids in enumerate(found) if None in ids]
            new = list({c for n in open_ for c, ids in zip(texts[n], found[n]) if ids is None})
            if len(table) + len(new) > CACHED:
                table.clear()
            table.update(zip(new, model.segment(new)))
            for n in open_:
                found[n] = [table[c] if ids is None else ids for c, ids in zip(texts[n], found[n])]
            return [b"".join(ids) for ids in found]

        def flush(held):
            return result([n for n, _ in held], [ids + end for ids in joined([chunks for _, chunks in held])])

        def result(numbers, packed):
            lists = [np.frombuffer(p, dtype="<i4") for p in packed]
            offsets = np.cumsum([0, *map(len, lists)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
            decoded = pa.array([model.decode(p.tolist()) for p in lists], pa.string())
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), ids, decoded], names=["doc_id", "ids", "decoded"])

        for batch in batches:
            held, size = [], 0
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if len(text) > _PIECE:
                    parts = [ids for chunks in model.pieces(text) for ids in joined([chunks])]
                    yield result([number], [b"".join(parts) + end])
                    continue
                held.append((number, next(model.pieces(text), [])))
                size += len(text)
                if size > _PIECE:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
