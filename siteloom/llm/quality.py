"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 9)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, with_fields

BITS = 18
PARTS = re.compile(r"\w+|[^\w\s]+")
SIGNS = re.compile(r"[^\w\s]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


class Hashed(dict):
    """Maps a word to its feature numbers, as bytes: the word, and its beginnings of three to five letters
    (inflected and compound words share them). Remembers a bounded number of words."""

    def __missing__(self, word: str) -> bytes:
        keys = [word, *(f"\0{word[:k]}-" for k in (3, 4, 5) if len(word) >= k)]
        numbers = np.array([zlib.crc32(k.encode("utf-8", "surrogatepass")) >> (32 - BITS) for k in keys], np.int32).tobytes()
        if len(self) > 400_000:
            self.clear()
        self[word] = numbers
        return numbers


def features(text: str, hashed: Hashed) -> np.ndarray:
    """Sorted distinct feature numbers: words and runs of signs, and shapes of the whole text in tenths
    (upper case among letters, distinct among words, signs among characters, runs of signs among parts)."""
    parts = PARTS.findall(text.lower())
    words = set(parts)
    n, chars = max(len(parts), 1), max(len(text), 1)
    signs = len(SIGNS.findall(text))
    upper = len(UPPER.findall(text))
    shape = [f"\0upper{10 * upper // chars}", f"\0distinct{min(10, 10 * len(words) // n)}", f"\0signs{10 * signs // n}", f"\0long{min(9, chars // n)}"]
    return np.unique(np.frombuffer(b"".join(map(hashed.__getitem__, [*words, *shape])), np.int32))


@dataclass
class OrdinalModel:
    """P(grade <= j) = sigmoid(thresholds[j] - weights . features), thresholds ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ...: a row for each document."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - latent[:, None], -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, *, least_df: int = 8, least_z: float = 4.5, l2: float = 1e-4, steps: int = 300, rate: float = 0.1) -> OrdinalModel:
    """Full-batch Adam on the mean negative log-likelihood; grades count alike, however many rows each has.

    The gaps between thresholds are exponentials, so their order holds throughout. Only features of at least
    ``least_df`` documents whose share differs between the documents below and above some threshold by
    ``least_z`` standard errors get a weight: rare words of few documents tell nothing of others.
    """
    size = 1 << BITS
    flat, lens = np.concatenate(rows), np.array([len(r) for r in rows])
    df = np.bincount(flat, minlength=size)
    telling = np.zeros(size, bool)
    for j in range(1, levels):
        above = np.repeat(grades >= j, lens)
        n_up = max(int((grades >= j).sum()), 1)
        n_down = max(len(rows) - n_up, 1)
        up = np.bincount(flat[above], minlength=size)
        mean = np.clip(df / len(rows), 1e-9, 1 - 1e-9)
        telling |= np.abs(up / n_up - (df - up) / n_down) > least_z * np.sqrt(mean * (1 - mean) * (1 / n_up + 1 / n_down))
    used = np.flatnonzero(telling & (df >= min(least_df, max(1, len(rows) // 10))))
    to = np.full(size, -1)
    to[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(rows)), lens)
    keep = to[flat] >= 0
    col, row = to[flat][keep], row[keep]
    count = np.bincount(grades, minlength=levels)
    weight = (1 / np.maximum(count, 1))[grades]
    weight /= weight.sum()
    w, first, gaps = np.zeros(len(used)), 0.0, np.zeros(levels - 2)
    params = [w, np.array([first]), gaps]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, first, gaps = params
        cut = first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        latent = np.bincount(row, w[col], minlength=len(rows))
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        hi, lo = edge[grades + 1] - latent, edge[grades] - latent
        p_hi, p_lo = np.where(np.isinf(hi), 1, sigmoid(hi)), np.where(np.isinf(lo), 0, sigmoid(lo))
        p = np.maximum(p_hi - p_lo, 1e-9)
        d_hi, d_lo = weight * p_hi * (1 - p_hi) / p, weight * p_lo * (1 - p_lo) / p
        g_latent = d_hi - d_lo
        g_cut = np.array([d_lo[grades == j + 1].sum() - d_hi[grades == j].sum() for j in range(levels - 1)])
        grads = [np.bincount(col, g_latent[row], minlength=len(used)) + l2 * w, np.array([g_cut.sum()]), np.array([g_cut[j + 1 :].sum() * np.exp(gaps[j]) for j in range(levels - 2)])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    w, first, gaps = params
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return OrdinalModel(weights, first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, ratings: DataFrame, grade: Column, *, levels: int, id_col: str = "doc_id", text: str = "text", bound: int = 8000) -> OrdinalModel:
    """Fits on at most ``bound`` rated documents, those of the smallest hashed ids (a documented bound; the
    features of that many documents are all that reaches the driver). Rows without id, text or grade, or of a grade
    outside 0 to ``levels`` - 1, don't count; an id rated more than once has its lowest grade; with no rated document of two grades, a model that gives every document the top grade results.
    """
    small_batches(docs.sparkSession)
    rated = ratings.select(F.col(id_col).alias("_id"), grade.cast("int").alias("_grade")).where(F.col("_id").isNotNull() & F.col("_grade").between(0, levels - 1))
    chosen = rated.groupBy("_id").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(bound)
    # At most bound rows: a proven size.
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").where("_text is not null").select("_id", "_grade", "_text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashed()
        for b in batches:
            found = [features(t, known).tobytes() for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_grade"), pa.array(found, pa.binary())], names=["_id", "_grade", "f"])

    got = sample.mapInArrow(hashed, with_fields(sample.drop("_text").schema, f="binary")).toArrow().sort_by("_id")
    grades = got.column("_grade").to_numpy().astype(np.int64)
    if len(set(grades)) < 2:
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.full(levels - 1, -40.0))
    return fit([np.frombuffer(f, np.int32) for f in got.column("f").to_pylist()], grades, levels)


def score(docs: DataFrame, model: OrdinalModel, *, text: str = "text", keep_at: float = 0.5) -> DataFrame:
    """Adds ``expected_grade``, ``tail_prob`` (of the top grade) and ``keep`` (tail_prob >= keep_at) to every
    row; replaces columns so named. Null text is scored as empty; repeated rows each; an empty table gives no rows; texts
    have any length. Rows are independent: no shuffle."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*(c for c in ("expected_grade", "tail_prob", "keep") if c != text))
    names = docs.columns
    weights, thresholds = model.weights, model.thresholds

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = Hashed(), OrdinalModel(weights, thresholds)
        for b in batches:
            latent = np.array([weights[features(t or "", known)].sum(dtype=np.float64) for t in b.column(text).to_pylist()])
            tails = m.tails(latent)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tails.sum(1)), pa.array(tails[:, -1])], names=[*names, "expected_grade", "tail_prob"])

    out = docs.mapInArrow(scored, with_fields(docs.schema, expected_grade="double", tail_prob="double"))
    return out.withColumn("keep", F.col("tail_prob") >= keep_at)
