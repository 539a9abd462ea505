"""Where sources speak differently from their language: an audit of terms and of pairs of sources (operator 12)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, scratch, small_batches

#: ASCII to lower-case letters or a space; other bytes, of which UTF-8 makes all further letters, stay.
LOWER = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

#: Terms that a task counts before it sends them on.
HELD = 200_000
SCALE = 1_000_000_000


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for counts of any size. Without kept terms nothing is
    asked of it, and the divisor is 1."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (whole(count) + 1).cast("decimal(20,0)"), F.greatest(whole(total) + whole(terms), F.lit(1)).cast("decimal(20,0)")) + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); p and q are at most SCALE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, d): occurrences, and documents that hold the term, by parts; every (lang, source) also has
    a row of the empty term. Tasks add up what they read, at most ``HELD`` terms at a time, before anything is shuffled."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.coalesce("lang", F.lit("")).cast("string").alias("lang"), F.coalesce("source", F.lit("")).cast("string").alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    names = ["lang", "source", "term", "c", "d"]

    def told(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs_of) in held.items():
            terms = [b"", *counts]
            n = len(terms)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *counts.values()], pa.int64()), pa.array([0, *(docs_of[t] for t in counts)], pa.int64())], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for b in bounded_batches(batches, "text"):
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                terms = text.translate(LOWER).split()
                counts, docs_of = held.setdefault((lang, source), (Counter(), Counter()))
                counts.update(terms)
                docs_of.update(set(terms))
            if sum(len(x[0]) + 1 for x in held.values()) > HELD:
                yield from told(held)
                held = {}
        yield from told(held)

    return slim.mapInArrow(count, "lang string, source string, term string, c long, d long")


def postings(docs: DataFrame, least: int = 3) -> DataFrame:
    """(lang, term, total, sources: array of (source, c)) of the terms that at least ``least`` documents of the lang hold;
    the empty term lists every source of the lang. One shuffle by (lang, term) serves both sums; a list has one entry a source."""
    by_source = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    lists = by_source.groupBy("lang", "term").agg(F.sum("c").alias("total"), F.sum("d").alias("docs"), F.collect_list(F.struct("source", "c")).alias("sources"))
    return lists.where((F.col("docs") >= least) | (F.col("term") == "")).drop("docs")


def groups(lists: DataFrame) -> DataFrame:
    """(lang, source, n, terms, lang_n): the sums over kept terms of each group and of its lang, and the lang's kept terms."""
    own = lists.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.c").alias("n"))
    of_lang = lists.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("terms"), F.sum("total").alias("lang_n"))
    return own.join(of_lang, "lang")


def term_part(lists: DataFrame, sizes: DataFrame, most: int = 200) -> DataFrame:
    """The ``most`` terms of each group that it uses more than its lang, by excess.

    A group's terms lie in buckets by its count of them and by the lang's. Excess grows with the group's probability and
    falls with the lang's, so a bucket's largest one and smallest other bound all its terms. Best buckets first, as many
    as hold ``most`` terms are evaluated; their last wanted excess is a floor, and every other bucket whose bound is not
    strictly below it is evaluated too. Nothing unseen can then enter, or tie with, the result. Buckets are few (counts
    beyond 256 share one for each 1/32 of a doubling), so that a window over a group's buckets stays small.
    """
    rows = lists.where("term <> ''").select("lang", "term", "total", F.explode("sources").alias("s")).where("s.c > 0").select("lang", "term", "total", F.col("s.source").alias("source"), F.col("s.c").alias("c"))
    rows = rows.join(sizes, ["lang", "source"]).withColumns({"p": probability(F.col("c"), F.col("n"), F.col("terms")), "q": probability(F.col("total"), F.col("lang_n"), F.col("terms"))}).where("p > q")
    fine = lambda c: F.when(F.col(c) <= 256, F.col(c)).otherwise(F.floor(F.log2(c) * 32)).cast("long")
    rows = rows.select("lang", "source", "term", "p", "q", F.struct(fine("c").alias("c"), F.floor(F.log2("total") * 4).cast("long").alias("total")).alias("bucket"))
    key = ["lang", "source", "bucket"]
    bound = rows.groupBy(*key).agg(F.count("*").alias("n"), F.max("p").alias("p"), F.min("q").alias("q")).select(*key, "n", excess(F.col("p"), F.col("q")).alias("bound"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bound = materialize(bound.withColumn("ahead", ahead), "buckets")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    evaluated = lambda chosen: rows.join(chosen.select(*key), key).select("lang", "source", "term", excess(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    first = materialize(evaluated(bound.where(F.col("ahead") < most)), "first-terms")
    floor = first.where(F.col("rank") == most).select("lang", "source", F.col("value").alias("floor"))
    more = bound.where(F.col("ahead") >= most).join(floor, ["lang", "source"]).where("bound >= floor")
    both = first.drop("rank").unionByName(evaluated(more).drop("rank"))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _shared(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, other, v): for terms that both sources use, what their excess has beyond the sums that take either
    alone. Tasks go through the lists of terms and add up a number for each pair of sources, so only sums are shuffled."""
    named = lists.where("term <> ''").select("lang", "term", F.posexplode("sources").alias("k", "s")).where("s.c > 0").select("lang", "term", F.col("s.source").alias("source"), F.col("s.c").alias("c"))
    placed = named.join(sizes, ["lang", "source"])
    own = placed.select("lang", "term", F.struct("source", probability(F.col("c"), F.col("n"), F.col("terms")).alias("p"), probability(F.lit(0), F.col("n"), F.col("terms")).alias("p0")).alias("x"))
    terms = own.groupBy("lang", "term").agg(F.collect_list("x").alias("x")).where(F.size("x") > 1).select("lang", F.col("x.source").alias("source"), F.col("x.p").alias("p"), F.col("x.p0").alias("p0"))

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, dict[str, int]] = {}
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, source, p, p0 in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "p", "p0"))):
                known = names.setdefault(lang, {})
                at = np.array([known.setdefault(s, len(known)) for s in source])
                total = sums.get(lang, np.zeros((0, 0), np.int64))
                if len(known) > len(total):
                    grown = np.zeros((2 * len(known),) * 2, np.int64)
                    grown[: len(total), : len(total)] = total
                    sums[lang] = total = grown
                p, p0 = np.array(p, np.int64)[:, None], np.array(p0, np.int64)[:, None]
                total[np.ix_(at, at)] += f(p, p.T) - f(p, p0.T) - f(p0, p.T) + f(p0, p0.T)
        for lang, known in names.items():
            here = list(known)
            for i, s in enumerate(here):
                others = [j for j in range(len(here)) if j != i]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(others), pa.string()), pa.array([s] * len(others), pa.string()), pa.array([here[j] for j in others], pa.string()), pa.array(sums[lang][i, others], pa.int64())], names=["lang", "source", "other", "v"])

    return terms.mapInArrow(add, "lang string, source string, other string, v long")


def pair_part(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """The excess of each source over each other of its lang, over all kept terms.

    A term that neither uses adds the same number each; a term that one of them uses adds a number that depends on its
    count alone, so a histogram of counts serves for all terms; the lists of terms correct what both use. The result has
    a row for each pair of sources, so that the sources of a lang must be few enough for that.
    """
    used = lists.where("term <> ''").select("lang", F.explode("sources").alias("s")).where("s.c > 0")
    histogram = used.groupBy("lang", F.col("s.source").alias("source"), F.col("s.c").alias("c")).agg(F.count("*").alias("m")).join(sizes, ["lang", "source"])
    zero = sizes.select("lang", "source", "terms", probability(F.lit(0), F.col("n"), F.col("terms")).alias("p0"))
    histogram = histogram.select("lang", "source", "m", probability(F.col("c"), F.col("n"), F.col("terms")).alias("p"), probability(F.lit(0), F.col("n"), F.col("terms")).alias("p0"))
    other = zero.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    whole = lambda c: c.cast("decimal(38,0)")
    met = histogram.join(other, "lang").where("source <> other")
    base = excess(F.col("p0"), F.col("o0"))
    ours = met.select("lang", "source", "other", (whole(F.col("m")) * whole(excess(F.col("p"), F.col("o0")) - base)).cast("decimal(38,0)").alias("v"))
    back = excess(F.col("o0"), F.col("p0"))
    theirs = met.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), (whole(F.col("m")) * whole(excess(F.col("o0"), F.col("p")) - back)).cast("decimal(38,0)").alias("v"))
    neither = zero.join(other, "lang").where("source <> other").select("lang", "source", "other", whole(F.col("terms") * whole(base)).alias("v"))
    both = _shared(lists, sizes).select("lang", "source", "other", whole(F.col("v")).alias("v"))
    sums = neither.unionByName(ours).unionByName(theirs).unionByName(both).groupBy("lang", "source", "other").agg(F.sum("v").cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", rank.alias("rank"))


def audit(docs: DataFrame, *, least: int = 3, most: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source).

    Nulls count as empty strings, and the empty lang and source are groups like others. Documents that repeat count each.
    A lang without kept terms has pairs of value 0 and no terms; a group without terms has pairs; an empty table gives
    no row. Columns beside the three are not read. What is written in between is the table of kept terms with their
    sources' counts, a bucket table and at most ``most`` terms a group.
    """
    with scratch():
        lists = materialize(postings(docs, least), "postings")
        sizes = materialize(groups(lists), "groups")
        return materialize(pair_part(lists, sizes).unionByName(term_part(lists, sizes, most)), "audit", keep=True)
