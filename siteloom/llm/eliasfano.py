"""Elias-Fano sequences, and a trie level of them in one flat, memory-mapped byte string."""

from __future__ import annotations

import mmap

import numpy as np

_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _at = [k for k in range(8) if _b >> k & 1]
    _SELECT[_b, : len(_at)] = _at

_KINDS = [np.dtype(k) for k in ("u1", "u2", "i4", "i8", "u8")]


def flat(arrays: list[np.ndarray]) -> bytes:
    """The arrays one after another, each at a multiple of 8 bytes, after a head of their kinds and lengths."""
    head = np.array([len(arrays), *(v for a in arrays for v in (_KINDS.index(a.dtype), len(a)))], np.int64)
    return b"".join(x for a in (head, *arrays) for x in (a.tobytes(), b"\0" * (-a.nbytes % 8)))


def views(data: bytes | mmap.mmap) -> list[np.ndarray]:
    """What :func:`flat` wrote, as arrays over the same memory: nothing is copied or read before it is used."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 2 * n)[1:].reshape(n, 2)
    out, at = [], 8 * (1 + 2 * n)
    for kind, size in head.tolist():
        out.append(np.frombuffer(data, _KINDS[kind], size, at))
        at += out[-1].nbytes + -out[-1].nbytes % 8
    return out


class EliasFano:
    """A non-decreasing sequence of n numbers below u: about 2 + log2(u / n) bits each.

    The low bits are packed; the high parts are a unary bit vector, with the ones before each word of it
    (8 bytes) sampled. ``get`` and ``rank`` take whole arrays.
    """

    PARTS = 4

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.uint64)
        n, u = len(values), int(values[-1]) + 1 if len(values) else 1
        self.n, self.low_bits = n, max(0, int(np.log2(max(1, u // max(n, 1)))))
        self.low = np.zeros((n * self.low_bits + 7) // 8 + 16, np.uint8)
        # A stretch at a time: a bit of a number takes a byte here.
        for a in range(0, n if self.low_bits else 0, 1 << 16):
            bits = ((values[a : a + (1 << 16), None] >> np.arange(self.low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(bits.ravel(), bitorder="little")
            self.low[a * self.low_bits // 8 : a * self.low_bits // 8 + len(packed)] = packed
        high = np.zeros(int(values[-1] >> np.uint64(self.low_bits)) + n + 1 if n else 1, np.uint8)
        high[(values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(high, bitorder="little")
        self.high = np.concatenate([high, np.zeros(-len(high) % 8 + 8, np.uint8)])
        self.ones = np.concatenate([[0], np.cumsum(_POP[self.high].reshape(-1, 8).sum(1, dtype=np.int64))])

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones]

    @classmethod
    def over(cls, arrays: list[np.ndarray]) -> EliasFano:
        out = cls.__new__(cls)
        (out.n, out.low_bits), out.low, out.high, out.ones = (*map(int, arrays[0]),), *arrays[1:]
        return out

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        # Eight bytes from any byte on: a view, so that one gather reads the low bits (up to 57).
        word = np.ndarray((len(self.low) - 7,), np.uint64, self.low, strides=(1,))[bit >> 3]
        return ((word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.ones, i, "right") - 1
        left = i - self.ones[block]
        # The byte within the block, then the bit within the byte.
        inside = np.cumsum(_POP[self.high.reshape(-1, 8)[block]], axis=1, dtype=np.int16)
        byte = (inside <= left[:, None]).sum(1)
        left = left - np.where(byte > 0, np.take_along_axis(inside, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
        place = block * 8 + byte
        return ((place * 8 + _SELECT[self.high[place], left] - i) << self.low_bits) | self.lows(i)

    def starts(self) -> np.ndarray:
        """How many numbers have a smaller high part than 0, 1, ...: the zeros of the unary vector, in one pass."""
        zeros = np.flatnonzero(np.unpackbits(self.high, bitorder="little") == 0)
        return zeros - np.arange(len(zeros))

    def rank(self, goal: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number that is at least ``goal`` (n if none), and whether it is equal: among those
        of the same high part, which the unary vector finds, by halving over their low bits. ``starts``: what
        :meth:`starts` gave."""
        top = np.minimum(goal >> self.low_bits, len(starts))
        ends = np.concatenate([[0], starts, [self.n]])
        lo, hi = np.minimum(ends[top], self.n), np.minimum(ends[top + 1], self.n)
        last, want = hi, goal & ((1 << self.low_bits) - 1)
        hi = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while open_.size:
            a, b = lo[open_], hi[open_]
            mid = (a + b) >> 1
            less = self.lows(mid) < want[open_]
            lo[open_], hi[open_] = a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            open_ = open_[a < b]
        equal = np.zeros(len(goal), bool)
        some = np.flatnonzero(lo < last)
        equal[some] = self.lows(lo[some]) == want[some]
        return lo, equal


#: Log10 probabilities are kept as 16-bit codes: steps of 1/4096 from 0 to -16.
STEP = 4096


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEP), 0, 65535).astype(np.uint16)


class TrieLevel:
    """One level of an n-gram trie: contexts and their successors.

    Contexts are numbers in ascending order, with monotone pointers to where each one's successors start.
    Successors ascend within a context; each has the last of all contexts before it added, so that the level is
    monotone throughout, and the search for one is relative to its context's sum. Beside them stand the
    quantised smoothed probabilities, and the counts: a byte, or 255 and the count in a list of the large ones. A
    context has its backoff.
    """

    SEQUENCES = ("contexts", "pointers", "base", "successors")

    def __init__(self, contexts: np.ndarray, starts: np.ndarray, successors: np.ndarray, counts: np.ndarray, log_p: np.ndarray, backoff: np.ndarray):
        some = np.diff(starts) > 0
        last = np.zeros(len(contexts), np.int64)
        last[some] = successors[starts[1:][some] - 1] + 1
        base = np.concatenate([[0], np.cumsum(last)])
        run = np.repeat(np.arange(len(contexts)), np.diff(starts))
        for name, values in zip(self.SEQUENCES, (contexts, starts, base, successors + base[run])):
            setattr(self, name, EliasFano(values))
        self.codes, self.backoff, self.counts = quantised(log_p), quantised(backoff), np.minimum(counts, 255).astype(np.uint8)
        self.large = np.flatnonzero(counts >= 255)
        self.larger = counts[self.large].astype(np.int64)

    def to_bytes(self) -> bytes:
        return flat([self.codes, self.backoff, self.counts, self.large, self.larger, *(a for name in self.SEQUENCES for a in getattr(self, name).arrays())])

    @classmethod
    def over(cls, data: bytes | mmap.mmap) -> TrieLevel:
        out = cls.__new__(cls)
        out.codes, out.backoff, out.counts, out.large, out.larger, *rest = views(data)
        for k, name in enumerate(cls.SEQUENCES):
            setattr(out, name, EliasFano.over(rest[EliasFano.PARTS * k : EliasFano.PARTS * (k + 1)]))
        out.zeros = (out.contexts.starts(), out.successors.starts())
        return out

    @classmethod
    def open(cls, path: str) -> TrieLevel:
        """Over a memory-mapped file: its pages enter memory as the look-ups touch them."""
        with open(path, "rb") as f:
            return cls.over(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def look_up(self, contexts: np.ndarray, runs: np.ndarray, words: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, counts, places) of (context, word) pairs, the words of each context in runs. A pair that is
        missing has the lower order's code with the context's backoff, count 0 and place -1."""
        c, known = self.contexts.rank(contexts, self.zeros[0])
        lo, hi, base, back = (np.zeros(len(c), np.int64) for _ in range(4))
        at = c[known]
        lo[known], hi[known], base[known], back[known] = self.pointers.get(at), self.pointers.get(at + 1), self.base.get(at), self.backoff[at]
        lo, hi, base, back = (np.repeat(x, runs) for x in (lo, hi, base, back))
        at, hit = self.successors.rank(words + base, self.zeros[1])
        hit = np.flatnonzero(hit & (at >= lo) & (at < hi))
        codes = np.minimum(lower + back, 65535).astype(np.uint16)
        counts, places = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        places[hit] = at = at[hit]
        codes[hit] = self.codes[at]
        n = self.counts[at].astype(np.int64)
        n[n == 255] = self.larger[np.searchsorted(self.large, at[n == 255])]
        counts[hit] = n
        return codes, counts, places
