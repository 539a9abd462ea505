"""Harmonic packing of tokenized documents into fixed-length sequences (operator 7)."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches

#: Fixed value: how the byte-level vocabulary's library splits a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Unclear(Exception):
    """A chunk whose pieces may depend on the white space before its space."""


class PieceIds(dict):
    """Maps a piece of text to its ids as little-endian unsigned 32-bit bytes; asks the library once for each.

    ``chunks`` does the same for what follows one space up to the next: a piece takes at most the one space
    before it, so pieces begin anew there, unless white space stands on both sides of that space.
    """

    def __init__(self, path: str, remember: int = 400_000):
        from tokenizers import Tokenizer

        from .bpe import byte_symbols

        tokenizer = Tokenizer.from_file(path)
        self.merge = tokenizer.model.tokenize
        self.written = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self.as_bytes = {i: ord(s) for i, s in enumerate(byte_symbols())}
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split
        self.find = regex.compile(PIECES).findall
        self.remember = remember
        self.chunks = Chunks(self)

    def __missing__(self, piece: str) -> bytes:
        ids = self.merged(piece)
        if len(self) >= self.remember:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def merged(self, piece: str) -> bytes:
        written = self.written
        return b"".join([written[t.id] for t in self.merge(piece.encode().decode("latin-1").translate(self.as_bytes))])

    def plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return b"".join([*map(self.__getitem__, self.find(first)), *map(self.chunks.__getitem__, rest)])
        except Unclear:
            return b"".join(map(self.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            return self.plain(text)
        return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else self.plain(part) for part in self.split(text))


class Chunks(dict):
    def __init__(self, pieces: PieceIds):
        self.pieces = pieces

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise Unclear
        if chunk.isalpha():
            ids = self.pieces.merged(" " + chunk)
        else:
            ids = b"".join(map(self.pieces.__getitem__, self.pieces.find(" " + chunk)))
        if len(self) >= 2 * self.pieces.remember:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(length, class) of what ``n`` ids take: full sequences, and the rest whole. Class k takes lengths from above
    capacity // (k + 1) up to capacity // k."""
    rest = n % capacity
    return [(capacity, 1)] * (n // capacity) + ([(rest, capacity // rest)] if rest else [])


class HarmonicBins:
    """One worker's open bins, one for each class: class k's bin is done when it has k documents.

    What a done bin has left is its gap. Documents stay whole until the gaps could hold one: then that one is cut over
    them. So little is padded, most documents are in one piece, and no more bins wait than a document can fill.
    Gaps below a 128th of the capacity stay. Bins that are open at the end are packed anew by first fit, longest first (fewer
    pieces than the sum of the classes), so that a worker pads a sequence or two.
    """

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next, self.least, self.room = capacity, first_id, capacity // 128 + 1, 0
        self.open: dict[int, list[list]] = {}
        self.gaps: deque[tuple[int, list[list]]] = deque()

    def close(self, pieces: list[list]) -> list[tuple]:
        at, out = 0, []
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def done(self, pieces: list[list], gap: int) -> list[tuple]:
        if gap < self.least:
            return self.close(pieces)
        self.gaps.append((gap, pieces))
        self.room += gap
        return []

    def add(self, piece: Callable[[int, int], list], n: int) -> list[tuple]:
        """Rows of the sequences that a document of ``n`` ids completes; ``piece(start, length)`` makes a piece of it."""
        out, at = [], 0
        for length, k in cuts(n, self.capacity):
            if length == self.capacity:
                out += self.close([piece(at, length)])
                at += length
            elif length <= self.room:
                while at < n:
                    gap, pieces = self.gaps.popleft()
                    self.room -= gap
                    take = min(gap, n - at)
                    out += self.done([*pieces, piece(at, take)], gap - take)
                    at += take
            else:
                held = self.open.setdefault(k, [])
                held.append(piece(at, length))
                if len(held) == k:
                    del self.open[k]
                    out += self.done(held, self.capacity - sum(p[2] for p in held))
        return out

    def end(self) -> list[tuple]:
        bins = [(self.capacity - gap, pieces) for gap, pieces in self.gaps]
        for piece in sorted((p for held in self.open.values() for p in held), key=lambda p: (-p[2], p[0] is None, p[0], p[1])):
            for i, (used, pieces) in enumerate(bins):
                if used + piece[2] <= self.capacity:
                    bins[i] = (used + piece[2], [*pieces, piece])
                    break
            else:
                bins.append((piece[2], [piece]))
        self.open, self.gaps = {}, deque()
        return [row for _, pieces in bins for row in self.close(pieces)]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of each document: ids from ``start``, ``length`` of them, at ``offset`` of ``sequence_id``.

    Each worker packs its own documents, without a shuffle. Null and empty texts are one piece, the end id
    alone; repeated rows are packed each on its own; a null id stays null; an empty table gives no rows; texts of any
    length fill sequences of their own, but for the rest; columns beside the two are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    names = SCHEMA.replace(" long", "").split(", ")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = PieceIds(path)
        end = end_id.to_bytes(4, "little")
        context = TaskContext.get()
        bins = HarmonicBins(capacity, (context.partitionId() if context else 0) << 36)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names=names)

        for b in batches:
            rows: list[tuple] = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = ids.encode(t or "") + end
                n = len(data) // 4
                rows += bins.add(lambda at, length: [doc, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), n], n)
            yield batch(rows)
        yield batch(bins.end())

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text]).mapInArrow(packed, SCHEMA)
