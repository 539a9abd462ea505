"""Text analytics: keywords, TF-IDF, similar pairs and clusters, readability; performance reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut, folder, kept, ranked

FIELDS = ("title", "meta_description", "h1_text", "headings_h2", "headings_h3", "extractable_text")


def page_text(pages: DataFrame, fields: tuple[str, ...] = FIELDS) -> Column:
    """The page's texts in the given order, one space between; list columns are joined the same way."""
    return F.concat_ws(" ", *(F.col(c) for c in fields if c in pages.columns))


def once(docs: DataFrame, toks: Column, *keep: str) -> DataFrame:
    """(keep, t): the tokens as a generated column, so that what reads them several times makes them once."""
    return docs.select(*keep, F.explode(F.array(toks)).alias("t"))


def keyword_counts(docs: DataFrame, text: Column, n: int) -> DataFrame:
    """(phrase, count) of all n-grams; the counts combine before the shuffle."""
    toks = once(docs, T.keyword_tokens(text))
    if n == 1:
        phrases = toks.select(F.explode("t").alias("phrase"))
    else:  # Tokens are joined as they are exploded: no array of phrases is made.
        parts = toks.where(F.size("t") >= n).select(F.explode(F.arrays_zip(*(F.slice("t", k + 1, F.size("t") - (n - 1)).alias(f"w{k}") for k in range(n)))).alias("z"))
        phrases = parts.select(F.concat_ws(" ", *(F.col("z").getField(f"w{k}") for k in range(n))).alias("phrase"))
    return phrases.groupBy("phrase").agg(F.count("*").alias("count"))


def keywords(docs: DataFrame, text: Column, n: int, most: int = 250) -> DataFrame:
    """(phrase, count, frequency): the ``most`` frequent n-grams; frequency is the share of all phrases."""
    counts = keyword_counts(docs, text, n)
    # The same aggregate twice in one plan: its shuffle is made once.
    total = counts.agg(F.sum("count").alias("total_phrases"))
    return counts.orderBy(F.desc("count"), "phrase").limit(most).join(F.broadcast(total)).select("phrase", "count", (F.col("count") / F.col("total_phrases")).alias("frequency"))


def keyword_totals(docs: DataFrame, text: Column, n: int) -> DataFrame:
    toks = once(docs, T.keyword_tokens(text))
    return toks.agg(F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("total_words"), F.coalesce(F.sum(F.size(T.ngrams(F.col("t"), n))), F.lit(0)).alias("total_phrases"))


def keyword_density(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, phrase, density): each term's share of its document's terms."""
    toks = once(docs, T.keyword_tokens(text), id_col)
    return toks.select(id_col, F.size("t").alias("n"), F.explode("t").alias("phrase")).groupBy(id_col, "phrase").agg(F.count("*").alias("c"), F.first("n").alias("n")).select(id_col, "phrase", (F.col("c") / F.col("n")).alias("density"))


def term_counts(toks: DataFrame) -> DataFrame:
    """(id, term, tf, begun, df) of documents (id, t): begun tells how many documents begin with the term."""
    each = toks.select("id", F.size("t").alias("n"), F.posexplode("t").alias("at", "term"))
    tf = each.groupBy("id", "term").agg((F.count("*") / F.first("n")).alias("tf"), F.count_if(F.col("at") == 0).alias("begun"))
    # The documents of a term are counted where its rows meet once: terms and counts are not made again for a join.
    return tf.withColumn("df", F.count("*").over(Window.partitionBy("term")))


def weighed(counts: DataFrame, total: DataFrame) -> DataFrame:
    return counts.join(F.broadcast(total)).select("id", "term", (F.col("tf") * (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1)).alias("weight"))


def tfidf(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, weight): tf = count / length, idf = ln((N + 1) / (df + 1)) + 1."""
    toks = once(docs, T.cluster_tokens(text), id_col).withColumnRenamed(id_col, "id").where(F.size("t") > 0)
    return weighed(term_counts(toks), toks.agg(F.count("*").alias("docs")))


def stored_tfidf(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The same for those that read it several times: the texts are read once, the counts are a stored table."""
    toks = once(docs, T.cluster_tokens(text), id_col).withColumnRenamed(id_col, "id").where(F.size("t") > 0)
    counts = kept(term_counts(toks), "terms")
    return weighed(counts, counts.agg(F.coalesce(F.sum("begun"), F.lit(0)).alias("docs")))


def unit(weights: DataFrame) -> DataFrame:
    norms = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weights.join(norms, "id").where("norm > 0").select("id", "term", (F.col("weight") / F.col("norm")).alias("w"))


#: Numbers kept for the terms of most documents, documents of a block, products that are added at a time, and those of a
#: term beyond which a dense matrix is cheaper.
DENSE, BLOCK, PRODUCTS, DEAR = 2048, 4000, 1 << 20, 20_000
PAIR = "a long, b long, similarity double"


Side = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _side(ids: np.ndarray, sizes: np.ndarray, no: np.ndarray, w: np.ndarray) -> Side:
    """Documents as entries by term: their ids, then each entry's document (by place), term and weight."""
    order = np.argsort(no, kind="stable")
    return ids, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], no[order], w[order]


def _part(side: Side, at: np.ndarray) -> Side:
    """The documents at the given places, which ascend."""
    ids, row, no, w = side
    place = np.full(len(ids), -1, np.int32)
    place[at] = np.arange(len(at))
    mine = place[row] >= 0
    return ids[at], place[row[mine]], no[mine], w[mine]


def _runs(no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of entries by term, where each begins, and how many it has."""
    at = np.flatnonzero(np.diff(no, prepend=no[0] - 1 if len(no) else 0))
    return no[at], at, np.diff(at, append=len(no))


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``many`` of them."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _dots(left: Side, right: Side, kind: type = np.float64) -> np.ndarray:
    """The products of all documents of the left with all of the right. Terms of which there are more than ``DEAR`` products
    are multiplied as dense matrices, the others entry by entry, some at a time."""
    (left_no, left_at, left_n), (right_no, right_at, right_n) = _runs(left[2]), _runs(right[2])
    _, i, j = np.intersect1d(left_no, right_no, assume_unique=True, return_indices=True)
    left_at, left_n, right_at, right_n = left_at[i], left_n[i], right_at[j], right_n[j]
    many = left_n * right_n
    dear, rare = np.flatnonzero(many > DEAR), np.flatnonzero(many <= DEAR)

    def matrix(side: Side, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        of, out = _spread(at, n), np.zeros((len(side[0]), len(n)), kind)
        out[side[1][of], np.repeat(np.arange(len(n)), n)] = side[3][of]
        return out

    dot = matrix(left, left_at[dear], left_n[dear]) @ matrix(right, right_at[dear], right_n[dear]).T
    flat, width, left_w, right_w = dot.reshape(-1), np.int64(len(right[0])), left[3].astype(kind, copy=False), right[3].astype(kind, copy=False)
    ends, at = np.cumsum(many[rare]), 0
    while at < len(rare):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, "right")))
        k = rare[at:to]
        mine = _spread(left_at[k], left_n[k])
        n = np.repeat(right_n[k], left_n[k])
        other = _spread(np.repeat(right_at[k], left_n[k]), n)
        np.add.at(flat, np.repeat(left[1][mine] * width, n) + right[1][other], np.repeat(left_w[mine], n) * right_w[other])
        at = to
    return dot


def _pairs(left: Side, right: Side, same: bool, least: float) -> Iterator[pa.Table]:
    """The pairs of documents of the left with those of the right, or of one side among themselves, some at a time."""
    if not len(left[0]) or not len(right[0]):
        return
    dot = _dots(left, right)
    step = max(1, (1 << 20) // len(right[0]))
    for at in range(0, len(left[0]), step):
        x, y = np.nonzero(dot[at : at + step] >= least)
        x += at
        a, b = left[0][x], right[0][y]
        mine = a < b if same else a != b
        if mine.any():
            a, b, found = a[mine], b[mine], dot[x[mine], y[mine]]
            yield pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": found})


def _block_pairs(rows: pa.Table, least: float) -> pa.Table:
    """The pairs of one cell of the grid: documents of block i with those of block j, or of i among themselves."""
    blocks = rows.column("block").to_numpy()
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()

    def side(block: int) -> Side:
        part = rows.filter(pa.array(blocks == block)).select(["id", "no", "w"]).combine_chunks()
        no = part.column("no").combine_chunks()
        return _side(part.column("id").to_numpy(), no.value_lengths().to_numpy(zero_copy_only=False), no.flatten().to_numpy(), part.column("w").combine_chunks().flatten().to_numpy())

    left = side(i)
    none = pa.table({c: pa.array([], t) for c, t in (("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64()))})
    return pa.concat_tables([none, *_pairs(left, left if i == j else side(j), i == j, least)])


def vectors(weights: DataFrame) -> DataFrame:
    """(id, no, w): each document's terms as numbers, those of most documents below ``DENSE``, and their weights, scaled to
    length 1. Terms of one document join no pair and are left out once they have counted for the length."""
    df = cut(weights.groupBy("term").agg(F.count("*").alias("df")).where("df > 1"))
    often = df.orderBy(F.desc("df"), "term").limit(DENSE)
    often = cut(often.select("term", (F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).cast("long").alias("no")))
    number = often.unionByName(df.join(often, "term", "left_anti").select("term", (F.monotonically_increasing_id() + DENSE).alias("no")))
    w = weights.columns[-1]
    told = weights.join(cut(number), "term", "left").where("id is not null").groupBy("id").agg(F.collect_list(F.when(F.col("no").isNotNull(), F.struct("no", F.col(w).alias("w")))).alias("v"), F.sqrt(F.sum(F.col(w) * F.col(w))).alias("norm"))
    told = told.where((F.size("v") > 0) & (F.col("norm") > 0))
    return cut(told.select("id", F.col("v.no").alias("no"), F.transform("v.w", lambda x: x / F.col("norm")).alias("w")))


class Documents(NamedTuple):
    """Documents as rows (id, scale, no, x): a term's weight is x by the scale, and by its idf where ``known`` names the table
    of the terms (h, df) of more than one of the ``total`` documents, which have their numbers by df. ``hashed`` is (id, h) with the
    hashes of all tokens, ``terms`` is (h, term)."""

    rows: DataFrame
    known: str = ""
    total: int = 0
    hashed: DataFrame | None = None
    terms: DataFrame | None = None


DOCUMENT = "id long, scale double, no array<long>, x array<double>"
PACKED = "id array<long>, scale array<double>, row array<int>, no array<long>, x array<double>"
TAKEN = "id long, leader long, similarity double"


def _table(path: str, *columns: str) -> pa.Table:
    """A table that Spark wrote to the shared folder, as one worker reads it."""
    files, at = FileSystem.from_uri(path)
    return pq.read_table(at, columns=list(columns) or None, filesystem=files, partitioning=None)


@lru_cache(maxsize=2)
def _known(path: str, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes in order, the number of each, and the idf by number."""
    table = _table(path, "h", "df")
    h, df = (table.column(c).to_numpy() for c in ("h", "df"))
    by_df = np.lexsort((h, -df))
    no = np.empty(len(h), np.int64)
    no[by_df] = np.arange(len(h))
    order = np.argsort(h)
    return h[order], no[order], np.log((total + 1) / (df[by_df] + 1)) + 1


def _counted(hashes: np.ndarray, known: str, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A document's terms: hashes, counts, numbers (-1 for terms of one document) and weights, not yet by its tokens."""
    all_, numbers, idf = _known(known, total)
    h, x = np.unique(hashes, return_counts=True)
    if not len(all_):
        return h, x, np.full(len(h), -1), x * (np.log((total + 1) / 2) + 1)
    at = np.minimum(np.searchsorted(all_, h), len(all_) - 1)
    no = np.where(all_[at] == h, numbers[at], -1)
    return h, x, no, x * np.where(no < 0, np.log((total + 1) / 2) + 1, idf[no])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], Iterator[np.ndarray]]]:
    for batch in batches:
        yield batch.column("id").to_pylist(), (h.values.to_numpy(zero_copy_only=False) for h in batch.column("h"))


def _listed(values: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32), np.concatenate(values))


def _numbered(batches: Iterator[pa.RecordBatch], known: str, total: int) -> Iterator[pa.RecordBatch]:
    """Documents (id, h) as (id, scale, no, x): x counts a term; terms of one document count for the length and are left out."""
    for ids, each in _hashed(batches):
        told = []
        for k, h in zip(ids, each):
            _, x, no, w = _counted(h, known, total)
            order = np.argsort(no)[np.count_nonzero(no < 0) :]
            if len(order):
                told.append((k, 1 / np.sqrt((w * w).sum()), no[order], x[order].astype(float)))
        if told:
            k, scale, no, x = zip(*told)
            yield pa.RecordBatch.from_pydict({"id": pa.array(k, pa.int64()), "scale": pa.array(scale), "no": _listed(no), "x": _listed(x)})


@lru_cache(maxsize=1)
def _members(path: str) -> tuple[np.ndarray, np.ndarray]:
    table = _table(path, "id", "leader")
    ids, leader = (table.column(c).to_numpy() for c in ("id", "leader"))
    order = np.argsort(ids, kind="stable")
    return ids[order], leader[order]


def _terms_of(batches: Iterator[pa.RecordBatch], members: str, known: str, total: int) -> Iterator[pa.RecordBatch]:
    """The terms of documents (id, h) that are members of a cluster, as (leader, h, w)."""
    mine, leader = _members(members)
    for ids, each in _hashed(batches):
        told = []
        for k, h in zip(ids, each):
            at = np.searchsorted(mine, k)
            if at < len(mine) and mine[at] == k:
                terms, _, _, w = _counted(h, known, total)
                told.append((leader[at], terms, w / len(h)))
        if told:
            of, h, w = zip(*told)
            yield pa.RecordBatch.from_pydict({"leader": pa.array(of, pa.int64()), "h": _listed(h), "w": _listed(w)})


def text_documents(docs: DataFrame, id_col: str, text: Column) -> Documents:
    """The documents of ``tfidf``, each made of its own text: the only rows that are shuffled are terms with their counts, and
    they are counted before that. Terms are known by hashes, of a seed for which no two share one."""
    toks = once(docs, T.cluster_tokens(text), id_col).withColumnRenamed(id_col, "id").where(F.size("t") > 0)
    total = None
    if not docs.groupBy(id_col).count().where("count > 1").isEmpty():  # rows that share an id are one document, and count each
        total = toks.count()
        toks = toks.groupBy("id").agg(F.flatten(F.collect_list("t")).alias("t"))
    terms = kept(toks.select(F.posexplode(F.array_distinct("t")).alias("at", "term")).groupBy("term").agg(F.count("*").alias("df"), F.count_if(F.col("at") == 0).alias("begun")), "vocabulary")
    total = terms.agg(F.coalesce(F.sum("begun"), F.lit(0))).first()[0] if total is None else total
    seed = next(k for k in range(42, 142) if terms.groupBy(F.xxhash64("term", F.lit(k))).count().where("count > 1").isEmpty())
    known = folder(docs.sparkSession, "known")
    terms.where("df > 1").select(F.xxhash64("term", F.lit(seed)).alias("h"), "df").write.parquet(known)
    hashed = toks.where("id is not null").select("id", F.transform("t", lambda x: F.xxhash64(x, F.lit(seed))).alias("h"))
    return Documents(hashed.mapInArrow(lambda bs: _numbered(bs, known, total), DOCUMENT), known, total, hashed, terms.select(F.xxhash64("term", F.lit(seed)).alias("h"), "term"))


def _given(weights: DataFrame) -> Documents:
    rows = vectors(weights)
    return Documents(rows.select(F.col("id").cast("long").alias("id"), F.lit(1.0).alias("scale"), "no", F.col("w").alias("x")))


def _pack(rows: pa.Table) -> pa.Table:
    """Documents as one row: by id, their entries by term."""
    rows = rows.take(np.argsort(rows.column("id").to_numpy(), kind="stable")).combine_chunks()
    lists = [rows.column(c).combine_chunks() for c in ("no", "x")]
    ids, row, no, x = _side(rows.column("id").to_numpy(), lists[0].value_lengths().to_numpy(zero_copy_only=False), *(v.flatten().to_numpy() for v in lists))
    told = {"id": ids, "scale": rows.column("scale").to_numpy(), "row": row, "no": no, "x": x}
    return pa.table({"part": rows.column("part").slice(0, 1)} | {c: pa.array([v]) for c, v in told.items()})


def _unpacked(batch: pa.Table | pa.RecordBatch, k: int, known: str, total: int) -> Side:
    ids, scale, row, no, x = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("id", "scale", "row", "no", "x"))
    w = x * scale[row]
    return ids, row, no, w * _known(known, total)[2][no] if known else w


def _stored(documents: Documents, size: int) -> tuple[str, int]:
    """The folder of the documents in parts of ``size`` by id, each a row in a folder ``part=k``; and how many parts there are.
    They are shuffled once."""
    spark = documents.rows.sparkSession
    at = folder(spark, "documents")
    rows = documents.rows if not documents.known else kept(documents.rows, "numbered")
    place = ranked(rows.select("id"), ["id"], "place")
    firsts = [r.id for r in place.where(F.col("place") % size == 0).orderBy("id").collect()]
    part = lambda bs: (b.append_column("part", pa.array(np.searchsorted(np.array(firsts, np.int64), b.column("id").to_numpy(), "right") - 1)) for b in bs)
    if firsts:
        dealt = rows.mapInArrow(part, DOCUMENT + ", part long").repartition(min(len(firsts), 512), "part")
        dealt.groupBy("part").applyInArrow(_pack, "part long, " + PACKED).write.option("compression", "zstd").partitionBy("part").parquet(at)
    return at, len(firsts)


def _cell(k: int) -> tuple[int, int]:
    """Cell k of the upper triangle of a grid, with its diagonal, column by column."""
    j = (isqrt(8 * k + 1) - 1) // 2
    return k - j * (j + 1) // 2, j


def similar_pairs(weights: DataFrame | Documents, least: float = 0.35) -> DataFrame:
    """(a, b, similarity) of documents (id, term, weight) with cosine ``least`` or more, a < b; ids are whole numbers, ``least`` is above 0.

    Documents are dealt into parts, stored once in the shared folder, and every two parts meet in a task that reads them there:
    the terms of many products as a product of two dense matrices, the others by the entries that two documents share. The work
    is that of all pairs; a task holds two parts and the products between them, whatever the number of documents, and
    no copies of the documents are shuffled."""
    documents = weights if isinstance(weights, Documents) else _given(weights)
    spark = documents.rows.sparkSession
    at, parts = _stored(documents, BLOCK)
    known, total = documents.known, documents.total

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                i, j = _cell(k)
                left = _unpacked(_table(f"{at}/part={i}"), 0, known, total)
                right = left if i == j else _unpacked(_table(f"{at}/part={j}"), 0, known, total)
                for found in _pairs(left, right, i == j, least):
                    yield from found.to_batches()

    cells = parts * (parts + 1) // 2
    return spark.range(0, cells, 1, max(1, min(cells, 4096))).mapInArrow(met, PAIR)


def _exact(left: Side, right: Side, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The products of documents x of the left with y of the right, pair by pair."""
    def entries(side: Side, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(side[1], kind="stable")
        n = np.bincount(side[1], minlength=len(side[0]))
        of = order[_spread((np.cumsum(n) - n)[at], n[at])]
        return np.repeat(np.arange(len(at)), n[at]), side[2][of], side[3][of]

    out = np.zeros(len(x))
    for at in range(0, len(x), 4000):
        (p, mine_no, mine_w), (q, no, w) = entries(left, x[at : at + 4000]), entries(right, y[at : at + 4000])
        width = 1 + max(mine_no.max(initial=0), no.max(initial=0))
        mine, other = p * width + mine_no, q * width + no
        place = np.minimum(np.searchsorted(other, mine), max(0, len(other) - 1))
        hit = other[place] == mine if len(other) else np.zeros(len(mine), bool)
        out[at : at + 4000] = np.bincount(p[hit], mine_w[hit] * w[place[hit]], min(4000, len(x) - at))
    return out


def _similar(left: Side, right: Side, least: float) -> np.ndarray:
    """Which documents are similar: products in single precision, those as near to ``least`` as these may err made again."""
    dot = _dots(left, right, np.float32)
    hit = dot >= least
    sizes = [np.bincount(s[1], minlength=len(s[0])) for s in (left, right)]
    near = (min(s.max(initial=0) for s in sizes) + 8) * 2.0**-23
    x, y = np.nonzero((dot >= least - near) & (dot <= least + near))
    err = (np.minimum(sizes[0][x], sizes[1][y]) + 8) * 2.0**-23
    open_ = np.abs(dot[x, y] - least) <= err
    x, y = x[open_], y[open_]
    hit[x, y] = _exact(left, right, x, y) >= least
    return hit


def _met(right: Side, packs: Iterator[Side], least: float) -> Iterator[pa.RecordBatch]:
    """For each document the smallest similar leader of packs, which come in order; those that have one meet no other."""
    for left in packs:
        hit = _similar(left, right, least)
        y = np.flatnonzero(hit.any(0))
        if len(y):
            x = hit[:, y].argmax(0)
            yield pa.RecordBatch.from_pydict({"id": right[0][y], "leader": left[0][x], "similarity": _exact(left, right, x, y)})
            right = _part(right, np.flatnonzero(~hit.any(0)))
            if not len(right[0]):
                return


def _settled(a: np.ndarray, b: np.ndarray, similarity: np.ndarray) -> dict[str, np.ndarray]:
    """Members with their leaders by the pairs of free documents, a < b: in the order of ids, one not yet taken leads."""
    order = np.lexsort((b, a))
    a, b, similarity = a[order], b[order], similarity[order]
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    free, leader, score = np.ones(len(ids), bool), np.zeros(len(ids), np.int64), np.zeros(len(ids))
    edges = np.searchsorted(i, np.arange(len(ids) + 1))
    for k in np.flatnonzero(np.diff(edges)):
        if free[k]:
            mine = slice(edges[k], edges[k + 1])
            new = free[j[mine]]
            took = j[mine][new]
            free[took], leader[took], score[took] = False, ids[k], similarity[mine][new]
    return {"id": ids[~free], "leader": leader[~free], "similarity": score[~free]}


def leading(weights: DataFrame | Documents, least: float = 0.35) -> DataFrame:
    """(id, leader, similarity): in the order of ids, a document not yet taken leads those later ones that are similar to it
    (cosine ``least`` or more, above 0) and not taken; those that were taken, each with its leader.

    Documents are stored in parts, by id, and settled some parts at a time, in rounds. In a round, each part meets the leaders
    so far, from the smallest on, until its documents are taken; those that are left find the pairs among themselves, and
    one task settles them. Other pairs are not made: what is kept grows with the documents; the work is that of
    the documents that are left times the leaders. A task holds two parts and the products between them, or the pairs of a round's free documents."""
    documents = weights if isinstance(weights, Documents) else _given(weights)
    spark = documents.rows.sparkSession
    at, parts = _stored(documents, max(1, BLOCK // 2))
    if not parts:
        return spark.createDataFrame([], TAKEN)
    known, total, out, first, rounds = documents.known, documents.total, folder(spark, "leaders"), 0, 0
    each = lambda work: lambda batches: (found for batch in batches for k in batch.column("id").to_pylist() for found in work(k))

    def free(row: pa.Table, *taken: str) -> pa.Table:
        """A part without the documents that the given tables hold."""
        ids, scale, of, no, x = (row.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("id", "scale", "row", "no", "x"))
        left = ~np.isin(ids, np.concatenate([_table(t, "id").column("id").to_numpy() for t in taken]))
        mine = left[of]
        told = {"id": ids[left], "scale": scale[left], "row": (np.cumsum(left) - 1).astype(np.int32)[of[mine]], "no": no[mine], "x": x[mine]}
        return pa.table({c: pa.array([v]) for c, v in told.items()})

    while first < parts:
        last = min(parts, first + (4 << min(rounds, 2)))
        met, own, settled = (f"{out}/{c}/round={rounds}" for c in ("members/met", "own", "members/settled"))
        side = lambda k, met=met: _unpacked(free(_table(f"{at}/part={k}"), met), 0, known, total)

        def meet(k: int, first: int = first) -> Iterator[pa.RecordBatch]:
            packs = (_unpacked(_table(f"{out}/packs/part={j}"), 0, known, total) for j in range(first))
            return _met(_unpacked(_table(f"{at}/part={k}"), 0, known, total), packs, least)

        def among(k: int, first: int = first, side: Callable[[int], Side] = side) -> Iterator[pa.RecordBatch]:
            i, j = _cell(k)
            left = side(first + i)
            return (b for found in _pairs(left, left if i == j else side(first + j), i == j, least) for b in found.to_batches())

        def settle(k: int, own: str = own) -> Iterator[pa.RecordBatch]:
            pairs = _table(own)
            yield pa.RecordBatch.from_pydict(_settled(*(pairs.column(c).to_numpy() for c in ("a", "b", "similarity"))))

        def pack(k: int, met: str = met, settled: str = settled) -> Iterator[pa.RecordBatch]:
            yield from free(_table(f"{at}/part={k}"), met, settled).append_column("part", pa.array([k])).to_batches()

        n = last - first
        spark.range(first, last, 1, n).mapInArrow(each(meet), TAKEN).write.parquet(met)
        spark.range(0, n * (n + 1) // 2, 1, n * (n + 1) // 2).mapInArrow(each(among), PAIR).write.parquet(own)
        spark.range(0, 1, 1, 1).mapInArrow(each(settle), TAKEN).write.parquet(settled)
        if last < parts:
            spark.range(first, last, 1, n).mapInArrow(each(pack), PACKED + ", part long").write.mode("append").option("compression", "zstd").partitionBy("part").parquet(f"{out}/packs")
        first, rounds = last, rounds + 1
    return spark.read.schema(TAKEN).option("recursiveFileLookup", True).parquet(f"{out}/members")


def leaders(pairs: DataFrame) -> DataFrame:
    """(leader): the greedy leaders over pairs (a, b), a < b: in the order of ids, a document leads if none of its
    smaller neighbours does. That is the lexicographically first independent set, found in rounds.

    A document without a smaller unsettled neighbour leads; its neighbours are settled, and the pairs of either are
    gone. Every round settles the smallest document of each part that is left, and usually many more. Rounds are
    semi-joins and anti-joins, each written out; only whether pairs are left reaches the driver."""
    all_ = open_ = cut(pairs.select("a", "b").where("a < b").distinct())
    taken = []
    while not open_.isEmpty():
        smaller = open_.select(F.col("b").alias("a")).distinct()
        new = open_.select("a").distinct().join(smaller, "a", "left_anti")
        settled = cut(open_.join(new, "a", "left_semi").select(F.col("b").alias("a")).distinct())
        taken.append(settled)
        open_ = cut(open_.join(new, "a", "left_anti").join(settled, "a", "left_anti").join(settled.withColumnRenamed("a", "b"), "b", "left_anti"))
        if len(taken) == 16:
            taken = [cut(reduce(DataFrame.unionByName, taken))]
    # A document all of whose smaller neighbours were settled leads too, also those that others settled meanwhile.
    never = reduce(DataFrame.unionByName, taken, all_.select("a").limit(0))
    return all_.select("a").distinct().join(never, "a", "left_anti").withColumnRenamed("a", "leader")


def clusters(pairs: DataFrame, ids: DataFrame, smallest: int = 2) -> DataFrame:
    """(id, leader, score): greedy leader clusters over pairs (a, b, similarity). In id order, a document not yet taken
    leads those later ones of ``ids`` that are similar to it and not taken: each goes to its smallest leader. Clusters
    of fewer than ``smallest`` are left out; leaders have score 1."""
    known = ids.select(F.col("id").alias("b"))
    pairs = cut(pairs.join(known, "b", "left_semi").join(known.withColumnRenamed("b", "a"), "a", "left_semi"))
    led = pairs.join(leaders(pairs).withColumnRenamed("leader", "a"), "a", "left_semi")
    members = led.groupBy(F.col("b").alias("id")).agg(F.min_by(F.struct(F.col("a").alias("leader"), "similarity"), "a").alias("m")).select("id", "m.leader", "m.similarity")
    return grouped(members, smallest)


def grouped(members: DataFrame, smallest: int = 2) -> DataFrame:
    """(id, leader, score) of members (id, leader, similarity) and their leaders."""
    members = members.select("id", "leader", F.round("similarity", 3).alias("score"))
    sizes = members.groupBy("leader").agg((F.count("*") + 1).alias("_n")).where(F.col("_n") >= smallest)
    kept = members.join(sizes.select("leader"), "leader", "left_semi").select("id", "leader", "score")
    return kept.unionByName(sizes.select(F.col("leader").alias("id"), "leader", F.lit(1.0).alias("score")))


def cluster_report(members: DataFrame, weights: DataFrame | Documents, names: DataFrame, most_terms: int = 10) -> DataFrame:
    """The report of clusters: (cluster_id, representative_url, cluster_size, keywords, member_url, member_score), a row
    for each member. ``names`` is (id, url); clusters are named by their leader."""
    sizes = members.groupBy("leader").agg(F.count("*").alias("cluster_size"))
    told = members.join(names.select("id", F.col("url").alias("member_url")), "id").join(sizes, "leader").join(cluster_terms(members, weights, most_terms), "leader", "left")
    lead = names.select(F.col("id").alias("leader"), F.col("url").alias("representative_url"))
    return told.join(lead, "leader").select(F.col("leader").alias("cluster_id"), "representative_url", "cluster_size", "keywords", "member_url", F.col("score").alias("member_score"))


def cluster_terms(members: DataFrame, weights: DataFrame | Documents, most: int = 10) -> DataFrame:
    """(leader, keywords): the terms of the largest summed weight of each cluster. Of documents by their texts, only the members'
    terms are shuffled, by hash, and those that may be among the largest get their names."""
    if isinstance(weights, Documents):
        known, total, at = weights.known, weights.total, folder(members.sparkSession, "members")
        members.select("id", "leader").write.parquet(at)
        each = weights.hashed.mapInArrow(lambda bs: _terms_of(bs, at, known, total), "leader long, h array<long>, w array<double>")
        each = each.select("leader", F.explode(F.arrays_zip("h", "w")).alias("z")).groupBy("leader", F.col("z.h").alias("h")).agg(F.sum("z.w").alias("w"))
        large = each.withColumn("r", F.rank().over(Window.partitionBy("leader").orderBy(F.desc(F.round("w", 9))))).where(F.col("r") <= most).drop("r")
        sums = large.join(weights.terms, "h").select("leader", "term", "w")
    else:
        sums = weights.join(members, "id").groupBy("leader", "term").agg(F.sum("weight").alias("w"))
    best = sums.withColumn("r", F.row_number().over(Window.partitionBy("leader").orderBy(F.desc(F.round("w", 9)), "term"))).where(F.col("r") <= most)
    return best.groupBy("leader").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), "; ").alias("keywords"))


def readability(docs: DataFrame, text: Column) -> DataFrame:
    """Adds the reading measures of each text; texts without words get zeros."""
    w = T.words(text)
    out = docs.withColumns({"_w": w, "sentence_count": F.greatest(T.sentence_count(text), F.lit(1))})
    out = out.withColumns({"words": F.size("_w"), "syllable_count": F.coalesce(F.aggregate(F.transform("_w", T.syllables), F.lit(0), lambda a, x: a + x), F.lit(0))}).drop("_w")
    wps, spw = F.col("words") / F.col("sentence_count"), F.col("syllable_count") / F.greatest(F.col("words"), F.lit(1))
    some = F.col("words") > 0
    out = out.withColumns({
        "avg_words_per_sentence": F.when(some, F.round(100 * F.col("words") / F.col("sentence_count")) / 100).otherwise(0.0),
        "flesch_reading_ease": F.when(some, T.half_up(206.835 - 1.015 * wps - 84.6 * spw, 2)).otherwise(0.0),
        "flesch_kincaid_grade": F.when(some, T.half_up(F.greatest(0.39 * wps + 11.8 * spw - 15.59, F.lit(0.0)), 2)).otherwise(0.0),
    })
    return out.withColumn("reading_level", T.reading_level(F.col("flesch_reading_ease")))


def content_audit(pages: DataFrame, limit: int | None = 250) -> DataFrame:
    """Html pages of status 200-399 with text, thinnest first; ``limit`` is the report's (1 to 1000), None for all."""
    good = (F.col("content_type").isNull() | F.lower("content_type").startswith("text/html")) & (F.col("status_code").isNull() | F.col("status_code").between(200, 399))
    found = pages.where(good).orderBy(F.col("word_count").asc_nulls_first(), "page_id")
    if limit is not None:
        found = found.limit(max(1, min(1000, limit)))
    text = page_text(pages, ("title", "h1_text", "meta_description", "extractable_text", "headings_h2", "headings_h3"))
    return readability(found.withColumn("_text", text).where(F.trim("_text") != ""), F.col("_text")).drop("_text")


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count("*").alias("total_pages"), F.coalesce(T.half_up(F.avg("flesch_reading_ease"), 2), F.lit(0.0)).alias("average_reading_ease"), F.coalesce(T.half_up(F.avg("flesch_kincaid_grade"), 2), F.lit(0.0)).alias("average_grade_level"),
        F.count_if(F.col("flesch_reading_ease") < 50).alias("difficult_pages"), F.count_if(F.col("word_count") < 300).alias("thin_pages"))


def performance(pages: DataFrame, limit: int | None = 1000) -> DataFrame:
    """The slowest pages (the report's limit), with score and carbon; response time stands for the paint times."""
    stored = F.col("carbon_footprint_grams") if "carbon_footprint_grams" in pages.columns else None
    found = pages.where("response_time_ms is not null").orderBy(F.desc_nulls_last("response_time_ms"), F.desc_nulls_last("size_bytes"), "page_id")
    found = found if limit is None else found.limit(limit)
    return found.select("page_id", "url", F.lit("crawl").alias("strategy"), T.response_score(F.col("response_time_ms")).alias("performance_score"), F.col("response_time_ms").alias("ttfb_ms"), "size_bytes", T.carbon_grams(F.col("size_bytes"), stored).alias("carbon_footprint_grams"))


def performance_summary(rows: DataFrame) -> DataFrame:
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.agg(
        F.count("*").alias("pages"), F.round(F.avg("performance_score")).cast("long").alias("avg_score"), zero(T.half_up(F.avg("ttfb_ms"), 2)).alias("avg_ttfb_ms"), zero(T.half_up(F.avg("size_bytes"), 2)).alias("avg_size_bytes"),
        zero(T.half_up(F.avg("carbon_footprint_grams"), 4)).alias("avg_carbon"), zero(T.half_up(F.sum("carbon_footprint_grams"), 4)).alias("total_carbon"),
        F.count_if(F.col("ttfb_ms") > 1000).alias("slow_pages"), F.count_if(F.col("size_bytes") > 1_000_000).alias("large_pages"))
