"""Token counts by heap-and-linked-list byte-pair merging (operator 4)."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The pieces that this vocabulary's file tells its library to keep.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter(dict):
    """Maps a chunk of lower-case text to its number of tokens; splits it into pieces and counts these when first asked.

    Symbols sit in a doubly linked list (two index arrays); a heap holds the rank and place of every
    adjacent pair that merges. The lowest rank is popped, stale entries are skipped, and the two new
    neighbours are pushed: O(n log n) for a piece of n bytes. The count is the bytes less the merges.
    The memory of seen pieces is emptied beyond ``remember`` entries.
    """

    def __init__(self, path: str, remember: int = 400_000):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, end = told["model"], told["model"]["end_of_word_suffix"]
        vocab, symbols = model["vocab"], byte_symbols()
        self.first = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(told["added_tokens"], key=lambda t: -len(t["content"]))))
        self.find = regex.compile(PIECES).findall
        self.remember = remember

    def __missing__(self, chunk: str) -> int:
        pieces = self.find(chunk)
        if pieces == [chunk]:
            data = chunk.encode()
            ids = [self.first[b] for b in data]
            ids[-1] = self.last[data[-1]]
            count = self.merged(ids)
        else:
            count = sum(map(self.__getitem__, pieces))
        if len(self) >= self.remember:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = count
        return count

    def merged(self, ids: list[int]) -> int:
        ranks, n = self.ranks, len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if found := ranks.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if found := ranks.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, new, ids[k], found[1]))
            h = left[i]
            if h >= 0 and (found := ranks.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, ids[h], new, found[1]))
            count -= 1
        return count

    def plain(self, text: str) -> int:
        if not text.isascii():
            # One character at a time, as the library does: no sigma of its own at a word's end.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        # White space is dropped and no piece holds any, so what stands between two spaces counts on its own.
        return sum(map(self.__getitem__, text.lower().split(" ")))

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))


def count_tokens(docs: DataFrame, *, text: str = "text", vocabulary: str | None = None, limit: int = 2048) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row of ``docs``; replaces columns so named.

    Null texts count as empty (0 tokens). Rows are independent: no shuffle, and repeated rows stay; an empty table gives
    no rows. Texts have any length: batches are bounded in bytes, and a text costs its length, and a heap of its longest piece.
    ``vocabulary`` is the path of a word-end BPE file on every machine (default: the public one).
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*(c for c in ("n_bytes", "n_tokens", "over_limit") if c != text))
    keep = [c for c in docs.columns if c != text]
    schema = docs.schema
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name in keep)
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(path)
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            tokens = pa.array([counter.count(t) for t in texts], pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), size, tokens], names=[*keep, "n_bytes", "n_tokens"])

    out = docs.select(*keep, text).mapInArrow(counted, f"{cols}{', ' if keep else ''}n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
