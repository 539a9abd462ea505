"""Exact top-k inner-product search by the threshold algorithm (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_fields

BLOCK = "block long, n int, dims int, ids binary, vectors binary, orders binary"


def clean(ids: list, vectors: list, scale: float) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Integer vectors by their length; null ids, null vectors and those with a null or non-finite component go."""
    kept: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, v in zip(ids, vectors):
        if i is None or v is None or any(x is None for x in v):
            continue
        x = np.floor(np.asarray(v, np.float64) * scale)
        if np.isfinite(x).all():
            kept.setdefault(len(x), []).append((i, x))
    return kept


def into_blocks(rows: DataFrame, size: int, scale: float, lists: bool) -> DataFrame:
    """Rows of (id, vector) into blocks of up to ``size`` vectors of one length, each with its lists: for every
    dimension the block's rows in ascending order of that component."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dims: int, rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            nonlocal number
            x = np.array([v for _, v in rows]).reshape(len(rows), dims)
            order = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16).tobytes() if lists else b""
            number += 1
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "n": pa.array([len(rows)], pa.int32()), "dims": pa.array([dims], pa.int32()),
                "ids": pa.array([np.array([i for i, _ in rows], np.int64).tobytes()], pa.binary()),
                "vectors": pa.array([x.tobytes()], pa.binary()), "orders": pa.array([order], pa.binary()),
            })

        for b in batches:
            for dims, found in clean(b.column(0).to_pylist(), b.column(1).to_pylist(), scale).items():
                held.setdefault(dims, []).extend(found)
                while len(held[dims]) >= size:
                    yield block(dims, held[dims][:size])
                    held[dims] = held[dims][size:]
        for dims, found in held.items():
            if found:
                yield block(dims, found)

    return rows.mapInArrow(build, BLOCK)


def threshold_search(query: np.ndarray, x: np.ndarray, orders: np.ndarray, ids: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of the k best rows of a block, best first, ties to the smaller id; and how many rows were scored.

    Lists are walked from the end that raises the score; a row seen for the first time gets its whole score. No
    unseen row can score above the sum of the components last seen in each list, times the query's. Each step goes
    on in the lists whose next stretch takes most off that sum. When the kth score is above it, the walk ends. (At
    equality it goes on: an unseen row could tie with a smaller id.) ``floor`` is a score that k rows of all blocks
    reach: rows below it are left out, and a sum below it ends the walk.
    """
    n = len(x)
    wide = max(np.abs(query).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * max(len(query), 1) >= 2**53
    q, x = (query.astype(np.int64), x.astype(np.int64)) if wide else (query, x)
    live = np.flatnonzero(query)
    # The lists that may take most off the sum come first; the rest are walked when these are spent.
    walk = np.where((query[live] > 0)[:, None], orders[live][:, ::-1], orders[live])
    seen = ids == own
    left, scored = n - int(seen.sum()), 0
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(live):
        walk, live = np.arange(n)[None, :], np.array([0])
    term = lambda i, d: q[live[i]] * x[walk[i, np.minimum(d, n - 1)], live[i]]
    every = np.arange(len(live))
    depth, last, stride = np.zeros(len(live), np.int64), term(every, 0), max(2, n // 512)
    while left:
        drop = np.where(depth < n, last - term(every, depth + stride), -1)
        go = np.argsort(-drop, kind="stable")[: max(1, len(live) // 4)]
        go = go[depth[go] < n]
        rows = np.concatenate([walk[i, depth[i] : depth[i] + stride] for i in go])
        rows = np.unique(rows[~seen[rows]])
        seen[rows] = True
        left -= len(rows)
        scored += len(rows)
        depth[go] = np.minimum(depth[go] + stride, n)
        last[go] = term(go, depth[go] - 1)
        if len(rows):
            scores = (x[rows] @ q).astype(np.int64)
            good = scores >= max(floor, best[-1] if len(best) >= k else floor)
            best_ids, best = np.concatenate([best_ids, ids[rows[good]]]), np.concatenate([best, scores[good]])
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
        if max(floor, best[-1] if len(best) == k else floor) > last.sum():
            break
        stride = min(2 * stride, max(2, n // 8))
    return best_ids, best, scored


def top_k(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", k: int = 5,
    scale: float = 256.0, candidates_per_block: int = 8192, queries_per_block: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score, scored): for each query the ``k`` rows of largest inner product of the vectors
    floor(scale * x); fewer if there are fewer. Ties go to the smaller id. ``scored`` is how many rows the walks of
    the query scored before their bounds ended them: on vectors without any common direction it is nearly all rows,
    as no sum of per-dimension maxima falls below the kth score before most rows have been met.

    A row whose id is the query's own is no candidate; other repeated rows each are one; a repeated query id is
    asked once, with its smallest vector that takes part. Vectors that are null or hold a null or non-finite
    component take no part; vectors of another length than the query's are not compared with it. Empty tables give
    no rows; columns beside the two are not read, whatever their names. A first block of candidates (a bounded number of vectors, the
    same for all) gives each query a score that its kth best reaches, which all its walks share. Blocks of candidates (with their sorted lists, made once) meet blocks of queries in a grid of keys, so
    neither side is broadcast or gathered, and a task holds one pair of blocks at a time.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector).alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("i"), F.col(vector).alias("v")).where("i is not null and v is not null")
    asked = asked.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))).groupBy("i").agg(F.min("v").alias("v"))
    left = materialize(into_blocks(rows, min(candidates_per_block, 65535), scale, True), "topk-rows")
    right = materialize(into_blocks(asked, queries_per_block, scale, False).withColumnRenamed("ids", "q_ids").withColumnRenamed("vectors", "q").select("block", "dims", "q_ids", "q"), "topk-queries")
    a, b = left.count(), right.count()
    # One block for each length of vector: at most ``candidates_per_block`` vectors each.
    first = {r["dims"]: (r["ids"], r["vectors"]) for r in left.groupBy("dims").agg(F.min_by(F.struct("ids", "vectors"), "block").alias("r")).select("dims", "r.*").collect()}

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for dims, q_ids, q in zip(*(batch.column(c).to_pylist() for c in ("dims", "q_ids", "q"))):
                q_ids, q = np.frombuffer(q_ids, np.int64), np.frombuffer(q).reshape(-1, dims)
                out = np.full(len(q_ids), -np.inf)
                if dims in first and len(ids := np.frombuffer(first[dims][0], np.int64)) > k:
                    x = np.frombuffer(first[dims][1]).reshape(-1, dims)
                    for i in range(len(q_ids)):
                        scores = np.sort((x @ q[i])[ids != q_ids[i]])
                        # Below 2^53 sums are exact; above, the walk finds its own.
                        if len(scores) >= k and np.abs(scores).max() < 2**52 and np.abs(q[i]).max() * np.abs(x).max() * dims < 2**53:
                            out[i] = scores[-k]
                found.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "floors"])

    right = right.mapInArrow(floors, with_fields(right.schema, floors="binary"))
    g, h = max(1, math.isqrt(a)), max(1, math.isqrt(b))
    pairs = left.select("dims", "ids", "vectors", "orders", F.pmod(F.xxhash64("block"), F.lit(g)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y")).join(
        right.select("dims", "q_ids", "q", "floors", F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("x"), F.pmod(F.xxhash64("block"), F.lit(h)).cast("int").alias("y")), ["dims", "x", "y"]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in range(batch.num_rows):
                dims, ids, x, orders, q_ids, q, least = (batch.column(c)[p].as_py() for c in ("dims", "ids", "vectors", "orders", "q_ids", "q", "floors"))
                ids, q_ids, least = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64), np.frombuffer(least)
                x, q = np.frombuffer(x).reshape(len(ids), dims), np.frombuffer(q).reshape(len(q_ids), dims)
                orders = np.frombuffer(orders, np.uint16).reshape(dims, len(ids))
                found = [threshold_search(v, x, orders, ids, i, k, f) for i, v, f in zip(q_ids, q, least)]
                # A row without a candidate tells what the walk scored.
                yield pa.RecordBatch.from_pydict({
                    "query_id": np.concatenate([q_ids, np.repeat(q_ids, [len(f[1]) for f in found])]),
                    "vec_id": pa.array([None] * len(found) + [i for f in found for i in f[0].tolist()], pa.int64()),
                    "score": pa.array([f[2] for f in found] + [i for f in found for i in f[1].tolist()], pa.int64()),
                })

    near = materialize(pairs.mapInArrow(search, "query_id long, vec_id long, score long"), "topk-found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    work = near.where("vec_id is null").groupBy("query_id").agg(F.sum("score").alias("scored"))
    found = near.where("vec_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.join(work, "query_id").select("query_id", "rank", "vec_id", "score", "scored")
