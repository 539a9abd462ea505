"""Language-model scores from an n-gram trie in Elias-Fano levels (operator 1)."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, remove, shared_dir, small_batches
from .eliasfano import STEP, TrieLevel, quantised

END = xxhash.xxh64_intdigest(b"")
ENCODED = "block long, n int, vocab array<long>, counts array<int>, ids binary, docs binary, nulls binary, lens binary, held binary"
STATE = "block long, ids binary, docs binary, nulls binary, lens binary, held binary, names binary, seen binary"
SENT = "shard long, block long, contexts binary, runs binary, seen binary, words binary, lower binary, times binary"
ANSWERED = "shard long, block long, codes binary, counts binary, places binary"
#: A context of the next order: the shard and the place of its n-gram in the level before.
PLACE_BITS = 40


def pressed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a).tobytes())


def opened(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def encode(docs: DataFrame, id_col: str, text: str, part: int, parts: int, block_tokens: int) -> DataFrame:
    """Blocks of documents as numbers into the block's own vocabulary of word hashes (ascending), with each
    word's count in the block's training documents. A document is never cut: a block ends with the one that
    fills it."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        words: dict[bytes, int] = {b"": 0}
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        tokens = 0

        def block() -> pa.RecordBatch:
            nonlocal number, words, ids, doc_ids, tokens
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            vocab, to = np.unique(hashes, return_inverse=True)
            flat, lens = to.astype(np.int32)[np.concatenate(ids)], np.array([len(x) for x in ids], np.int32)
            held = np.array([zlib.crc32(b"" if d is None else str(d).encode()) % parts == part for d in doc_ids])
            counts = np.bincount(flat[np.repeat(~held, lens)], minlength=len(vocab)).astype(np.int32)
            number += 1
            row = {
                "block": pa.array([number], pa.int64()), "n": pa.array([len(flat)], pa.int32()),
                "vocab": pa.array([vocab.view(np.int64)], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int32())),
                "ids": pa.array([pressed(flat)], pa.binary()), "docs": pa.array([pressed(np.array([d or 0 for d in doc_ids], np.int64))], pa.binary()),
                "nulls": pa.array([pressed(np.array([d is None for d in doc_ids], np.uint8))], pa.binary()),
                "lens": pa.array([pressed(lens)], pa.binary()), "held": pa.array([pressed(held.astype(np.uint8))], pa.binary()),
            }
            words, ids, doc_ids, tokens = {b"": 0}, [], [], 0
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                split = (t or b"").lower().split()
                x = np.empty(len(split) + 1, np.int32)
                x[:-1] = [words.setdefault(w, len(words)) for w in split]
                x[-1] = 0
                ids.append(x)
                doc_ids.append(d)
                tokens += len(x)
                if tokens >= block_tokens:
                    yield block()
        if ids:
            yield block()

    return docs.select(docs[id_col].cast("long").alias("i"), docs[text].cast("binary").alias("t")).mapInArrow(blocks, ENCODED)


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, at, h, c) in the order of h get the number of their h in this partition."""
    context = TaskContext.get()
    p, last, n = context.partitionId() if context else 0, None, -1
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(2).to_numpy()
        new = np.concatenate([[last is None or h[0] != last], h[1:] != h[:-1]])
        k = n + np.cumsum(new)
        n, last = int(k[-1]), h[-1]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k), pa.array(np.full(len(k), p, np.int32)), b.column(3), pa.array(new)], names=["block", "at", "k", "p", "c", "first"])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prior(seen: np.ndarray, of: float) -> np.ndarray:
    """How many counts the lower order is worth: it grows with the context's count as the number of its distinct
    successors does, by a power."""
    return of * np.maximum(seen, 0).astype(np.float64) ** 0.9


def backed(seen: np.ndarray, of: float) -> np.ndarray:
    """log10 of the lower order's weight in a context; 0 in one that was never seen."""
    m = prior(seen, of)
    return np.log10(np.where(seen > 0, m / np.maximum(seen + m, 1e-300), 1.0))


class Block:
    """A block's tokens, and its n-grams in the order in which they are dealt to shards."""

    def __init__(self, row: dict, total: int, unit: float, shards: int, priors: tuple[float, ...], least: int):
        self.ids, self.lens, self.held = opened(row["ids"], np.int32), opened(row["lens"], np.int32), opened(row["held"], np.uint8)
        self.names, self.seen = opened(row["names"], np.int64), opened(row["seen"], np.int64)
        self.total, self.shards, self.priors, self.least = total, shards, priors, least
        self.edge = np.concatenate([[0], np.cumsum(self.lens)])[:-1].astype(np.int64)
        self.log_p = np.log10(self.seen + 1) - unit
        self.lower = quantised(self.log_p)[self.ids]
        # The first order's contexts: the word before, and one number more for the start of a document.
        self.context = np.empty_like(self.ids)
        self.context[1:] = self.ids[:-1]
        self.context[self.edge] = len(self.names)
        # The end is the word of name 1; a document starts as often as one ends.
        end = int(np.searchsorted(self.names, 1))
        self.keys, self.counts = np.append(self.names, 0), np.append(self.seen, self.seen[end])
        self.order = 2

    def deal(self) -> None:
        """Distinct (context, word) pairs of this order that training may hold, by shard, then context, then word.

        A context goes to one shard, unless it is so frequent that it would crowd it: then its words are dealt
        over as many shards as its count asks for."""
        n = len(self.names)
        asks = (self.context >= 0) & (self.seen[self.ids] > 0)
        asks[asks] = self.counts[self.context[asks]] >= (1 if self.order == 2 else self.least)
        self.at = np.flatnonzero(asks)
        pair, to = np.unique(self.context[self.at].astype(np.int64) * n + self.ids[self.at], return_inverse=True)
        c, w = pair // n, pair % n
        spread = np.minimum(self.shards, 1 + 2 * self.counts[c] * self.shards // max(self.total, 1)).astype(np.uint64)
        shard = ((mixed(self.keys[c]) + mixed(self.names[w]) % spread) % np.uint64(self.shards)).astype(np.int32)
        order = np.argsort(shard.astype(np.uint16) if self.shards < 2**16 else shard, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.c, self.w, self.shard, self.place = c[order], w[order], shard[order], place[to]

    def messages(self, number: int, kind: type) -> Iterator[tuple]:
        times = np.bincount(self.place[np.repeat(self.held == 0, self.lens)[self.at]], minlength=len(self.c))
        lower = np.zeros(len(self.c), np.uint16)
        lower[self.place] = self.lower[self.at]
        cuts = np.flatnonzero(np.diff(self.shard, prepend=-1, append=-1)) if len(self.c) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            c = self.c[a:b]
            first = np.flatnonzero(np.diff(c, prepend=-1))
            yield (int(self.shard[a]), number, pressed(np.diff(self.keys[c[first]], prepend=0)), pressed(np.diff(first, append=b - a).astype(np.int32)), pressed(self.counts[c[first]]),
                   pressed(self.names[self.w[a:b]].astype(kind)), pressed(lower[a:b]), pressed(times[a:b].astype(np.uint32)))

    def take(self, answers: list[dict]) -> None:
        """Raises the tokens' codes to this order, and makes its n-grams the contexts of the next."""
        answers = sorted(answers, key=lambda r: r["shard"])
        join = lambda c, kind: np.concatenate([opened(r[c], kind) for r in answers]) if answers else np.empty(0, kind)
        codes, counts = join("codes", np.uint16), join("counts", np.uint32).astype(np.int64)
        places = np.concatenate([r["shard"] * (1 << PLACE_BITS) + np.cumsum(opened(r["places"], np.int64)) for r in answers]) if answers else np.empty(0, np.int64)
        back = quantised(backed(self.counts, self.priors[self.order - 2])).astype(np.int64)
        lower = self.lower.astype(np.int64)
        had = self.context >= 0
        lower[had] += back[self.context[had]] * (self.counts[self.context[had]] >= (1 if self.order == 2 else self.least))
        self.lower = np.clip(lower, 0, 65535).astype(np.uint16)
        self.lower[self.at] = codes[self.place]
        # The n-gram that ends with a token is the context of the token after it.
        own = np.full(len(self.ids), -1, np.int32)
        kept = np.flatnonzero(counts >= self.least)
        to = np.full(len(counts), -1, np.int32)
        to[kept] = np.arange(len(kept), dtype=np.int32)
        own[self.at] = to[self.place]
        self.context = np.empty_like(own)
        self.context[1:] = own[:-1]
        self.context[self.edge] = -1
        self.keys, self.counts = places, counts[kept]
        self.order += 1


def entries(rows: pa.Table, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The messages of a shard: block, contexts, their runs, their counts, words, lower codes, times."""
    for i in range(rows.num_rows):
        r = {c: rows.column(c)[i].as_py() for c in ("block", "contexts", "runs", "seen", "words", "lower", "times")}
        yield r["block"], np.cumsum(opened(r["contexts"], np.int64)), opened(r["runs"], np.int32), opened(r["seen"], np.int64), opened(r["words"], kind).astype(np.int64), opened(r["lower"], np.uint16), opened(r["times"], np.uint32)


def built(rows: pa.Table, kind: type, width: int, of: float) -> TrieLevel:
    """A shard's trie level from all blocks' messages: the training pairs, counted and smoothed."""
    keys, seen, taught, times, lower = [], [], [], [], []
    for _, c, runs, s, w, low, t in entries(rows, kind):
        hit = np.flatnonzero(t)
        taught.append((np.repeat(c, runs)[hit], w[hit]))
        keys.append(c), seen.append(s), times.append(t[hit]), lower.append(low[hit])
    contexts, at = np.unique(np.concatenate(keys), return_index=True)
    seen = np.concatenate(seen)[at]
    pair, group = np.unique(np.concatenate([np.searchsorted(contexts, c) * width + w for c, w in taught]), return_inverse=True)
    count = np.bincount(group, np.concatenate(times), minlength=len(pair))
    low = np.zeros(len(pair), np.uint16)
    low[group] = np.concatenate(lower)
    c = pair // width
    m = prior(seen, of)
    log_p = np.log10((count + m[c] * 10 ** (low / -STEP)) / (seen[c] + m[c]))
    starts = np.searchsorted(c, np.arange(len(contexts) + 1))
    return TrieLevel(contexts, starts, pair % width, count.astype(np.int64), log_p, backed(seen, of))


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", held_out: int = 2, parts: int = 7, order: int = 3, priors: tuple[float, ...] = (3.0, 2.0),
    least: int = 2, block_tokens: int = 2_000_000, shard_tokens: int = 3_000_000,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    An n-gram model of ``order`` (1 or more) learnt from all documents but those whose crc32 of the id, as text,
    leaves ``held_out`` modulo ``parts``. p(w) is add-one over the training words and one unknown; above it
    p(w | c) = (n(cw) + m p'(w)) / (n(c) + m) with m = prior * n(c) ** 0.9 and p' the order below, whose share so
    falls with the context's count as that of its distinct successors does. A context seen less than ``least``
    times (of two words or more), or never, leaves the order below. Scores are log10; probabilities pass through
    16-bit codes. A document starts as a context of its own.

    Null and empty text has one token, its end; a null id reads as the empty text; repeated rows count and score
    each; an empty table gives no rows; texts have any length (a block holds at least one whole); columns beside
    the two are not read, whatever their names.

    Nothing that grows with the corpus is broadcast or collected. Documents become blocks of word numbers; words
    meet once to be counted and named. For each order, blocks send their distinct pairs, compressed, to shards by
    context (very frequent contexts to several, by word; their counts are known, so nothing has to meet again). A
    shard builds its level of the trie once, as a file in the shared folder that it maps into memory (or in its own
    memory, where that folder is no mounted path), and answers each block's pairs, one message at a time. Every step is written, so lost
    executors cost its repetition at most; all is removed at the end.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made: list[DataFrame] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        made.append(materialize(df, name))
        return made[-1]

    folder = f"{shared_dir(spark)}/siteloom/trie-{uuid4().hex}"
    mounted = folder.removeprefix("file://") if folder.startswith(("file:///", "/")) else None
    try:
        blocks = written(encode(docs, id_col, text, held_out, parts, block_tokens), "blocks")
        found = blocks.select("block", F.posexplode(F.arrays_zip("vocab", "counts")).alias("at", "x")).select("block", "at", F.col("x.vocab").alias("h"), F.col("x.counts").alias("c"))
        # A block has a word once, so even the commonest word has but a row for each block.
        summed = found.withColumn("c", F.sum("c").over(Window.partitionBy("h"))).select("block", "at", "h", "c")
        counted = written(summed.mapInArrow(numbered, "block long, at int, k long, p int, c long, first boolean"), "counts")
        train, total = blocks.agg(F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        kinds, lanes, most = counted.agg(F.count_if(F.col("first") & (F.col("c") > 0)), F.coalesce(F.max("p"), F.lit(0)) + 1, F.coalesce(F.max("k"), F.lit(0))).first()
        width = (most + 1) * lanes + 2
        shards, unit, kind = max(1, -(-total // shard_tokens)), float(np.log10(train + kinds + 1)), np.uint32 if width < 2**32 else np.int64
        end = END - (1 << 64) if END >> 63 else END
        opening = lambda row: Block(row, train, unit, shards, priors, least)

        def name(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            r = {c: left.column(c)[0].as_py() for c in ("block", "ids", "docs", "nulls", "lens", "held")}
            names, seen = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
            at = right.column("at").to_numpy()
            # Names from 2 on; 1 is the end, 0 the start. Words are put in the order of their names.
            names[at], seen[at] = right.column("k").to_numpy() * lanes + right.column("p").to_numpy() + 2, right.column("c").to_numpy()
            names[np.flatnonzero(left.column("vocab").combine_chunks().flatten().to_numpy() == end)] = 1
            order_ = np.argsort(names)
            to = np.empty(len(names), np.int32)
            to[order_] = np.arange(len(names), dtype=np.int32)
            r |= {"ids": pressed(to[opened(r["ids"], np.int32)]), "names": pressed(names[order_]), "seen": pressed(seen[order_])}
            return pa.Table.from_pylist([r])

        state = written(blocks.groupBy("block").cogroup(counted.select("block", "at", "k", "p", "c").groupBy("block")).applyInArrow(name, STATE), "state")
        discard(counted), discard(blocks)
        columns = ("shard", "block", "contexts", "runs", "seen", "words", "lower", "times")

        def table(rows: list[tuple], names: tuple[str, ...], schema: str) -> pa.Table:
            kinds_ = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
            return pa.table([pa.array([r[i] for r in rows], kinds_[f.split()[1]]) for i, f in enumerate(schema.split(", "))], names=list(names))

        answered: list[DataFrame] = []
        for n in range(2, order + 1):
            of = priors[n - 2]

            def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for r in b.to_pylist():
                        block = opening(r)
                        block.deal()
                        for m in block.messages(r["block"], kind):
                            yield from table([m], columns, SENT).to_batches()

            def after(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
                r = left.to_pylist()[0]
                block = opening(r)
                raised(block, right, n - 1)
                block.deal()
                return table(list(block.messages(r["block"], kind)), columns, SENT)

            # What the later orders send is written first: the shuffles that it takes are gone when the shards get it.
            sent = state.mapInArrow(first, SENT) if n == 2 else written(state.groupBy("block").cogroup(together(answered).groupBy("block")).applyInArrow(after, SENT), "sent")

            def answer(key: tuple, rows: pa.Table) -> pa.Table:
                level = built(rows, kind, width, of).to_bytes()
                if mounted:
                    os.makedirs(mounted, exist_ok=True)
                    path = f"{mounted}/{n}-{key[0].as_py()}"
                    with open(part := f"{path}.{uuid4().hex}", "wb") as f:
                        f.write(level)
                    os.replace(part, path)
                level = TrieLevel.open(path) if mounted else TrieLevel.over(level)
                out = []
                for b, c, runs, _, w, low, _ in entries(rows, kind):
                    codes, counts, places = level.look_up(c, runs, w, low)
                    if n == order:
                        counts[:], places[:] = 0, 0
                    out.append((key[0].as_py(), b, pressed(codes), pressed(counts.astype(np.uint32)), pressed(np.diff(places[counts >= least], prepend=0))))
                if mounted:
                    # Mapped until here; no other task asks this shard.
                    os.remove(path)
                return table(out, ("shard", "block", "codes", "counts", "places"), ANSWERED)

            answered.append(written(sent.groupBy("shard").applyInArrow(answer, ANSWERED).withColumn("n", F.lit(n)), "answers"))
            if n > 2:
                discard(sent)

        def last(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            r = left.to_pylist()[0]
            block = opening(r)
            base, known = (np.add.reduceat(x, block.edge) for x in (block.log_p[block.ids], (block.seen > 0)[block.ids].astype(np.int64)))
            raised(block, right, order)
            return pa.table({
                id_col: pa.array(opened(r["docs"], np.int64), mask=opened(r["nulls"], np.uint8).astype(bool)), "held_out": pa.array(block.held.astype(bool)),
                "n_tokens": pa.array(block.lens.astype(np.int64)), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(base), train)),
                "base_score": pa.array(base), "score": pa.array(-np.add.reduceat(block.lower.astype(np.int64), block.edge) / STEP),
            })

        result = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        all_answers = together(answered) if answered else spark.createDataFrame([], ANSWERED + ", n int")
        return materialize(state.groupBy("block").cogroup(all_answers.groupBy("block")).applyInArrow(last, result), "scores")
    finally:
        for df in made:
            discard(df)
        remove(spark, folder)


def together(answered: list[DataFrame]) -> DataFrame:
    out = answered[0]
    for df in answered[1:]:
        out = out.unionByName(df)
    return out


def raised(block: Block, answers: pa.Table, upto: int) -> None:
    """Replays the orders that were answered: what was dealt is dealt again, the same way."""
    rows = answers.to_pylist()
    for n in range(2, upto + 1):
        block.deal()
        block.take([r for r in rows if r["n"] == n])
