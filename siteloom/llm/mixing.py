"""Mixing sources to target weights by min-cost flow (operator 2)."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words_count

SLICES = 4096
#: Patterns up to which the plan is broadcast; beyond, it is joined like any table.
FEW = 100_000
#: Patterns that the driver plans for: a row of some hundred bytes each. More are refused, before anything is collected.
MOST = 2_000_000


def fair_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size: what a stopped source leaves is
    shared again among the others by weight, until none is above (or all are stopped)."""
    targets, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ -= full
    return targets


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each (from, to, capacity, cost) arc of a cheapest largest flow: successive shortest paths with
    potentials (costs are at least 0)."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y), cap.append(z), cost.append(v)
    height = [0] * n
    while True:
        dist: list[float] = [float("inf")] * n
        via = [-1] * n
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in out[x]:
                if cap[e] > 0 and (c := d + cost[e] + height[x] - height[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = c, e
                    heapq.heappush(heap, (c, to[e]))
        if via[sink] < 0:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        for x in range(n):
            if dist[x] < float("inf"):
                height[x] += int(dist[x])
        x, most = sink, float("inf")
        while x != source:
            most = min(most, cap[via[x]])
            x = to[via[x] ^ 1]
        x = sink
        while x != source:
            cap[via[x]] -= int(most)
            cap[via[x] ^ 1] += int(most)
            x = to[via[x] ^ 1]


def route(patterns: list[tuple[tuple[int, ...], int]], targets: Sequence[float], repeats: int) -> list[int]:
    """Tokens to take from each pattern (the sources its documents belong to, its size).

    Each pattern has an arc for every repetition, each as wide as its size and dearer than the one before
    (convex), so no text is repeated while fresh text of a source that still wants some is left. Sources that no
    document joins are networks of their own, and each goes through the flow."""
    root = list(range(len(targets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for member, _ in patterns:
        for j in member[1:]:
            root[find(j)] = find(member[0])
    nets: dict[int, list[int]] = {}
    takes = [0] * len(patterns)
    for i, (member, _) in enumerate(patterns):
        if member:
            nets.setdefault(find(member[0]), []).append(i)
    for net in nets.values():
        at = {j: k for k, j in enumerate(dict.fromkeys(j for i in net for j in patterns[i][0]))}
        p, s = len(net), len(at)
        arcs = [(0, 1 + k, patterns[i][1], copy * (copy + 1) // 2) for k, i in enumerate(net) for copy in range(repeats)]
        arcs += [(1 + k, 1 + p + at[j], patterns[i][1] * repeats, 0) for k, i in enumerate(net) for j in patterns[i][0]]
        arcs += [(1 + p + k, 1 + p + s, round(targets[j]), 0) for j, k in at.items()]
        flow = min_cost_flow(p + s + 2, arcs, 0, 1 + p + s)
        for k, i in enumerate(net):
            takes[i] = sum(flow[k * repeats : (k + 1) * repeats])
    return takes


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    sources: str = "source",
    text: str = "text",
    weights: Callable[[int], float] = lambda rank: (3, 1, 2)[rank % 3],
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 17,
    into: str | None = None,
) -> DataFrame:
    """Adds ``size`` (words), ``source_size``, ``target`` and ``taken`` (words taken, repeats counted) to ``docs``, in
    place of columns so named; with ``into``, as one struct of that name instead, and every column stays.

    ``sources`` is a string or an array of strings (a document of several sources serves any of them; its
    ``source_size`` and ``target`` are those of the first by code point). Null is a source of its own, the
    last. Only totals by membership pattern reach the driver, at most ``MOST``; more are an error. Within a pattern documents are taken by seeded hash of
    id and text: whole rounds first, then by cumulated size while they fit the quota, and at the edge the largest one
    further on that fits what is left. The cumulated size comes from ``4096`` hash slices of a pattern, and only
    the slice at the edge is ordered, so a source that holds most rows is never sorted in one task. No document
    exceeds ``repeats`` times its size; empty documents (null or no words) are taken 0 times. Repeated rows count
    each, and as many of them are taken as fit; which of them is not told apart. An empty table gives no rows; texts
    have any length; the caller's columns have any names.
    """
    spark = docs.sparkSession
    names = ("size", "source_size", "target", "taken")
    kept = docs.columns if into else [c for c in docs.columns if c not in names or c in (id_col, sources, text)]
    kept = [c for c in kept if c != into]
    many = docs.schema[sources].dataType.typeName() == "array"
    member = F.array_sort(F.array_distinct(docs[sources])) if many else F.array(docs[sources])
    # The caller's row is one column, so that its names meet none of those below. A row's place is a hash of what
    # identifies it, so reruns agree; equal rows have the same place.
    sized = docs.select(
        F.struct(*(docs[c].alias(c) for c in kept)).alias("row"), words_count(docs[text]).alias("size"),
        F.to_json(F.struct(F.coalesce(member, F.array(F.lit(None).cast("string"))).alias("s")), {"ignoreNullFields": "false"}).alias("pattern"),
        F.xxhash64(F.lit(seed), docs[id_col], docs[text]).alias("hash"), F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"),
    )
    slice_ = F.pmod("hash", F.lit(SLICES)).cast("int")
    place = F.struct("hash", "id", "size")
    slim = materialize(sized.drop("row"), "mix").withColumn("slice", slice_)
    totals = materialize(slim.groupBy("pattern").agg(F.sum("size").alias("n")), "mix-totals")
    if totals.count() > MOST:
        raise ValueError(f"more than {MOST} sets of sources; group them before they are mixed")
    sizes = totals.collect()
    by_name = lambda v: (v is None, v or "")
    patterns = sorted(((json.loads(r["pattern"])["s"], r["n"], r["pattern"]) for r in sizes), key=lambda p: [by_name(v) for v in p[0]])
    known = sorted({v for m, _, _ in patterns for v in m}, key=by_name)
    rank = {v: i for i, v in enumerate(known)}
    source_sizes = [0] * len(known)
    for m, n, _ in patterns:
        for v in m:
            source_sizes[rank[v]] += n
    targets = fair_targets(source_sizes, [weights(i) for i in range(len(known))], share * sum(n for _, n, _ in patterns), repeats)
    takes = route([(tuple(rank[v] for v in m), n) for m, n, _ in patterns], targets, repeats)
    rows = [(key, source_sizes[rank[m[0]]] if m else 0, targets[rank[m[0]]] if m else 0.0, take // n if n else 0, take % n if n else 0) for (m, n, key), take in zip(patterns, takes)]
    # A row for each pattern: sent to all only while they are few.
    small = F.broadcast if len(rows) <= FEW else lambda df: df
    plan = spark.createDataFrame(rows, "pattern string, source_size long, target double, rounds long, rest long")
    before = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        slim.groupBy("pattern", "slice").agg(F.sum("size").alias("in"))
        .withColumn("before", F.coalesce(F.sum("in").over(before), F.lit(0)))
        .join(small(plan.select("pattern", "rest")), "pattern")
    )
    # The slice in which the quota ends, one for each pattern.
    edge = slices.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("in") > F.col("rest"))).select("pattern", F.col("slice").alias("edge"), "before")
    plan = materialize(plan.join(edge, "pattern", "left"), "mix-plan")
    # Equal rows at the edge are one group. The first that does not fit whole gives as many rows as fit.
    groups = slim.join(small(plan), "pattern").where("slice = edge").groupBy("pattern", "rest", "before", place.alias("place")).agg(F.count("*").alias("rows"))
    within = Window.partitionBy("pattern").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("rows") * F.col("place.size")).over(within), F.lit(0)))
    stop = groups.where(F.col("left") < F.col("rows") * F.col("place.size")).groupBy("pattern").agg(F.min(F.struct("place", "left", "rows")).alias("stop"))
    fit = F.floor(F.col("stop.left") / F.col("stop.place.size"))
    stop = stop.select("pattern", F.col("stop.place").alias("stop"), F.col("stop.rows").alias("stop_rows"), fit.alias("fit"), (F.col("stop.left") - fit * F.col("stop.place.size")).alias("gap"))
    plan = materialize(plan.join(stop, "pattern", "left"), "mix-stop")
    behind = (F.col("slice") > F.col("edge")) | (F.col("slice") == F.col("edge")) & (place > F.col("stop"))
    fill = slim.join(small(plan), "pattern").where(behind & F.col("size").between(1, F.col("gap"))).groupBy("pattern").agg(F.max(F.struct("size", place.alias("place"))).alias("m")).select("pattern", F.col("m.place").alias("fill"))
    filled = slim.join(small(fill), "pattern").where(place == F.col("fill")).groupBy("pattern").agg(F.first("fill").alias("fill"), F.count("*").alias("fill_rows"))
    final = materialize(plan.join(filled, "pattern", "left"), "mix-edge")
    split = final.where("fit between 1 and stop_rows - 1 or fill_rows > 1")
    whole = F.when(F.col("rest") == 0, False).when(F.col("slice") != F.col("edge"), F.col("slice") < F.col("edge")).otherwise(place < F.col("stop"))
    at_stop, at_fill = place == F.col("stop"), F.coalesce(place == F.col("fill"), F.lit(False))
    told = sized.withColumn("slice", slice_).join(small(final), "pattern")
    if split.isEmpty():
        told = told.withColumn("extra", whole | at_stop & (F.col("fit") > 0) | at_fill)
    else:
        # Some of a group of equal rows: the rows are numbered in 1024 lots of it, and the lots follow one another.
        limit = F.when(at_stop, F.col("fit")).when(at_fill, F.lit(1))
        told = told.withColumn("limit", limit).withColumn("lot", F.when(F.col("limit").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024))))
        tied = materialize(told.where("limit is not null"), "mix-tied")
        lots = tied.groupBy("pattern", place.alias("place"), "lot").agg(F.count("*").alias("in"))
        lots = lots.withColumn("ahead", F.coalesce(F.sum("in").over(Window.partitionBy("pattern", "place").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        number = F.row_number().over(Window.partitionBy("pattern", "hash", "id", "size", "lot").orderBy(F.lit(1)))
        tied = tied.withColumn("number", number).withColumn("place", place).join(lots.drop("in"), ["pattern", "place", "lot"])
        told = told.where("limit is null").withColumn("extra", whole).unionByName(tied.withColumn("extra", F.col("ahead") + F.col("number") <= F.col("limit")).select(*told.columns, "extra"))
    taken = (F.col("size") * F.least(F.col("rounds") + F.coalesce(F.col("extra"), F.lit(False)).cast("int"), F.lit(repeats))).cast("long")
    out = [F.col("size"), F.col("source_size"), F.col("target"), taken.alias("taken")]
    return told.select(*(F.col("row").getField(c).alias(c) for c in kept), *([F.struct(*out).alias(into)] if into else out))
