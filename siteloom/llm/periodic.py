"""Runs of repeating words, found by probing a harmonic grid (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import WORD, bounded_batches, small_batches, with_fields

#: Offsets that the first comparison of a survivor covers; later ones double.
CHUNK = 32
RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))


def _agree(ids: np.ndarray, at: np.ndarray, period: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which survivors have ``ids[i] == ids[i + period]`` for all i in [at, at + reach): compared in chunks, and a
    survivor that fails one is not compared further."""
    alive, done, width = np.arange(len(at)), 0, CHUNK
    good = np.zeros(len(at), bool)
    while alive.size:
        # Lanes x offsets: a bound on the matrix, as lanes may be many and reaches long.
        step = max(1, min(width, 4_000_000 // alive.size))
        off = np.arange(done, done + step)
        here = at[alive][:, None] + np.minimum(off, reach[alive][:, None] - 1)
        ok = (ids[here] == ids[here + period[alive][:, None]]).all(1)
        alive, done, width = alive[ok], done + step, width * 2
        whole = reach[alive] <= done
        good[alive[whole]] = True
        alive = alive[~whole]
    return good


def _stretch(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The largest [a, b) around ``at`` with ``ids[i] == ids[i + period]`` for every i inside."""
    last = len(ids) - period
    b, width = at, CHUNK
    while b < last:
        end = min(b + width, last)
        off = np.flatnonzero(ids[b:end] != ids[b + period : end + period])
        if off.size:
            b += int(off[0])
            break
        b, width = end, width * 2
    a, width = at, CHUNK
    while a > 0:
        low = max(a - width, 0)
        off = np.flatnonzero(ids[low:a] != ids[low + period : a + period])
        if off.size:
            a = low + int(off[-1]) + 1
            break
        a, width = low, width * 2
    return a, b


def find_runs(ids: np.ndarray, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period, of every maximal stretch of ``ids`` with smallest period q and
    length >= max(least, times * q); ``times`` is at least 3.

    A run of period p and that length agrees with itself moved by p over (times - 1) * p words at least, so it covers
    as many neighbouring points of the grid 0, p, 2p, ...; the points of all periods number n / 1 + n / 2 + ... . The
    grids of the periods lo to 2 lo - 1 are tested as one matrix. Where times - 1 neighbours agree, and no run of a
    divisor of p covers them, the words between are compared in chunks, and what is left is stretched to both sides.
    Equal stretches of two periods have the smaller one's period, which divides the larger and was found before.
    """
    n, wide = len(ids), times - 1
    found: dict[tuple[int, int], int] = {}
    # The longest run found so far over each word.
    cover_from, cover_to, cover_q = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    lo = 1
    while lo * times <= n:
        hi = min(lo * 2, n // times + 1)
        # Rows of the matrix in blocks of bounded size: its lines overlap by what a survivor needs.
        lines, block = n // lo + 1, max(wide + 1, 2_000_000 // (hi - lo))
        at_all, p_all = [], []
        for top in range(0, lines, block):
            j = np.arange(top, min(top + block + wide - 1, lines))
            p = np.arange(lo, hi)
            at = j[:, None] * p
            ok = at + p < n
            ok &= ids[np.where(ok, at, 0)] == ids[np.where(ok, at + p, 0)]
            if len(j) < wide:
                continue
            three = ok[: len(j) - wide + 1].copy()
            for k in range(1, wide):
                three &= ok[k : len(j) - wide + 1 + k]
            r, c = np.nonzero(three)
            at_all.append(at[r, c])
            p_all.append(p[c])
        at, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at_all, p_all))
        if at.size:
            q = cover_q[at]
            inside = (q > 0) & (p % np.maximum(q, 1) == 0) & (at + p < cover_to[at])
            at, p = at[~inside], p[~inside]
        if at.size:
            ok = _agree(ids, at, p, (wide - 1) * p + 1)
            at, p = at[ok], p[ok]
            order = np.lexsort((at, p))
            reached = (0, 0)
            for x, period in zip(at[order].tolist(), p[order].tolist()):
                if reached[0] == period and x < reached[1]:
                    continue  # within the stretch that the grid point before led to
                a, b = _stretch(ids, x, period)
                reached = (period, b)
                s, e = a, b + period
                if e - s >= max(least, times * period) and (s, e) not in found:
                    found[s, e] = period
                    short = cover_to[s:e] - cover_from[s:e] < e - s
                    for c, v in ((cover_from, s), (cover_to, e), (cover_q, period)):
                        c[s:e][short] = v
        lo *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repeats(docs: DataFrame, text: str = "text", *, times: int = 4, least: int = 6) -> DataFrame:
    """Adds ``n_words``, ``runs`` (by start, then period) and ``collapsed`` to every row; replaces columns so named.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``collapsed`` is the text without the words that a run holds
    after its first period, joined by one space. Null and blank texts have no words, no runs and an empty
    ``collapsed``. Rows are independent: no shuffle; repeated rows stay and get equal values; an empty table gives
    none. A text of n words takes about n log n comparisons, however long it is.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*(c for c in ("n_words", "runs", "collapsed") if c != text))
    keep = [c for c in docs.columns if c != text]
    schema = with_fields(docs.select(*keep).schema, n_words="long", runs=RUNS, collapsed="string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def one(data: bytes | None) -> tuple[int, list, str]:
        words = (data or b"").split()  # of bytes: at exactly the six characters of WORD
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        runs = find_runs(ids, times, least) if len(seen) < len(words) else []
        if runs:
            step = np.zeros(len(words) + 1, np.int64)
            for s, length, q in runs:
                step[s + q] += 1
                step[s + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
        return len(ids), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(words).decode()

    def batch_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_batches(batches, text):
            rows = [one(t) for t in b.column(text).to_pylist()]
            n, runs, rest = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(rest, pa.string())], names=[*keep, "n_words", "runs", "collapsed"])

    return docs.select(*keep, F.col(text).cast("binary").alias(text)).mapInArrow(batch_of, schema)


def longest(runs: Column) -> Column:
    """The run of the greatest length; the smallest start, then period, among equals; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def with_planted_period(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, of which about a tenth, by the checksum of the id, go on from some word by repeating the words
    from there with some period. A null id changes nothing."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    # A word array and its numbers are lambda variables, so each is made once for a row.
    told = F.transform(F.array(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), lambda w: _repeated(w, g))
    return docs.withColumn(text, F.when((h % 10 == 0) & F.col(text).rlike(WORD), F.get(told, F.lit(0))).otherwise(F.col(text)))


def _repeated(words: Column, g: Column) -> Column:
    n = F.size(words).cast("long")
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    both = F.transform(F.array(F.struct(n.alias("n"), a.alias("a"), p.alias("p"))), lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: F.get(words, F.when(i < x["a"], i).otherwise(x["a"] + F.pmod(i - x["a"], x["p"])).cast("int"))))
    return F.array_join(F.get(both, F.lit(0)), " ")
