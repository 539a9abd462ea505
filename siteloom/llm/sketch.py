"""Document fingerprints: invertible Bloom lookup sketches (operator 10), in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A paragraph is a line; lines of more than 16 words are cut after every 16th. One rule for the whole text.
PARAGRAPH = r"\S++(?:[^\S\n]++\S++){0,15}"
TABLES = 3
CHECK = 99
KEYS = ["block", "place"]


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs; the empty array for null or blank text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def width(size: Column) -> Column:
    """Cells of each table in the sketch of so many digests: a power of two, so that a sketch folds to any narrower
    one. The three tables have 0.75 to 1.5 cells a digest."""
    return F.greatest(F.lit(4).cast("long"), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / 4))).cast("long"))


def sketched(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, width, seed, cell, n, d, h): the sketch of each row's ``digests``, a row for each cell that is not empty:
    how many digests it holds, their xor, the xor of their checks (32 bits)."""
    item = rows.select(*by, "width", "seed", F.explode("digests").alias("d"))
    cells = F.array(*_cells(F.col("d")))
    return item.select(*by, "width", "seed", "d", F.hash("d", F.lit(CHECK)).alias("h"), F.explode(cells).alias("cell")).groupBy(*by, "width", "seed", "cell").agg(
        F.count("*").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("h").alias("h"))


def _cells(digest: Column) -> list[Column]:
    """The digest's cell in each table: tables stand one after the other, each ``width`` cells wide."""
    return [(F.pmod(F.xxhash64(digest, F.lit(j), F.col("seed")), F.col("width")) + F.col("width") * j).cast("long") for j in range(TABLES)]


def written_out(cells: Column, size: Column) -> Column:
    """A sketch as text: the digests, the width, then each cell's place, count, xor and check, in hexadecimal."""
    low = lambda x: F.lower(F.hex(x))
    one = lambda c: F.concat_ws(".", low(c["cell"]), low(c["n"]), low(c["d"]), low(c["h"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))
    return F.concat_ws(":", low(size.cast("long")), low(width(size)), F.array_join(F.transform(F.array_sort(cells), one), ":"))


def peel(cells: DataFrame, by: list[str], rounds: int = 4, keep: Column | None = None) -> DataFrame:
    """(by, differing, left, digests): of the difference of two sketches, how many digests peeling recovers, how many
    cells it leaves, and the digests themselves with the sign of the side that has them, of pairs that fit ``keep``
    (a condition on ``by``; default all); pairs without any difference have no row.

    ``cells``: by, width, seed, cell, s, d, h, dealt by a subset of ``by``; then nothing below moves. A cell whose
    count is 1 or -1, and whose check and place fit its digest, is pure. Tables take turns, as in one table a digest has one
    cell and so is recovered once: it leaves its own cell, and its other two cells get it with the opposite sign.
    """
    by, keep = [*by, "width", "seed"], F.lit(True) if keep is None else keep
    one = lambda cell, s, d, h, got: F.struct(cell.alias("cell"), s.alias("s"), d.alias("d"), h.alias("h"), got.alias("got"))
    zero = F.lit(0).cast("long")

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by, "cell", "got").agg(F.sum("s").alias("s"), F.bit_xor("d").alias("d"), F.bit_xor("h").alias("h")).where("s <> 0 or d <> 0 or h <> 0")

    state = summed(cells.withColumn("got", zero))
    for k in range(rounds * TABLES):
        j = k % TABLES
        pure = (F.abs("s") == 1) & (F.hash("d", F.lit(CHECK)) == F.col("h")) & (F.col("cell") == _cells(F.col("d"))[j])
        # What is recovered leaves the cells: as a row of its own, or as one more in the pair's number.
        taken = [one(F.lit(-1).cast("long"), F.when(keep, F.col("s")).otherwise(1).cast("long"), zero, zero.cast("int"), F.when(keep, F.col("d")).otherwise(zero))]
        taken += [one(c, -F.col("s"), F.col("d"), F.col("h"), zero) for i, c in enumerate(_cells(F.col("d"))) if i != j]
        own = F.array(one(F.col("cell"), F.col("s"), F.col("d"), F.col("h"), F.col("got")))
        state = summed(state.select(*by, F.explode(F.when(pure, F.array(*taken)).otherwise(own)).alias("r")).select(*by, "r.cell", "r.s", "r.d", "r.h", "r.got"))
    found = F.col("cell") < 0
    return state.groupBy(*by[:-2]).agg(
        F.coalesce(F.sum(F.when(found, F.abs("s"))), F.lit(0)).alias("differing"), F.count_if(~found).alias("left"),
        F.collect_list(F.when(found & keep, F.struct(F.col("got").alias("digest"), F.col("s").alias("sign")))).alias("digests"),
    )


def successors(docs: DataFrame, id_col: str, text: str, rows_per_block: int = 512, quantiles: int = 1024) -> DataFrame:
    """(block, place, copy, id, text, next): every row with the text of the row after it by id (ties: by hash of the
    text); after the last comes the first. Null ids come first. The last row of a block is a copy of the next one's first.

    Ids are dealt into blocks: equal ranges between quantiles of the ids, so that neither gaps nor far-off ids fill
    one; null ids by the text's hash. Each block's last row also meets the first row of the next block, so no order
    over all rows is needed: texts are shuffled once, by block.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    shares = F.array(*(F.lit(k / quantiles) for k in range(quantiles + 1)))
    n, nulls, bounds = rows.agg(F.count("*"), F.count_if(F.col("id").isNull()), F.percentile_approx("id", shares, 20 * quantiles)).first()
    bounds = sorted(set(bounds or [0]))
    first = -(-nulls // rows_per_block)
    each = max(1, -(-n // (rows_per_block * len(bounds))))
    ends = [*bounds[1:], bounds[-1] + 1]
    lo, hi = (F.array(*(F.lit(b).cast("long") for b in x)) for x in (bounds, ends))
    tie = F.xxhash64("text")
    # The last bound that is not above the id: among every 32nd bound, then among the 32 from there.
    below = lambda x: F.size(F.filter(x, lambda b: b <= F.col("id")))
    rows = rows.withColumn("coarse", F.greatest(below(F.array(*(F.lit(b).cast("long") for b in bounds[::32]))) - 1, F.lit(0)) * 32)
    rows = rows.withColumn("bucket", F.greatest(F.col("coarse") + below(F.slice(lo, F.col("coarse") + 1, F.lit(32))) - 1, F.lit(0))).drop("coarse")
    a, b = (F.get(x, F.col("bucket")).cast("double") for x in (lo, hi))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0 - 1e-9), (F.col("id").cast("double") - a) / F.greatest(b - a, F.lit(1.0))))
    block = F.when(F.col("id").isNull(), F.floor((tie / F.lit(2.0**64) + 0.5) * first)).otherwise(first + F.col("bucket") * each + F.floor(inside * each)).cast("long")
    # Never null by type either: joins would add a filter, which sets the readers' plans below apart.
    block = F.coalesce(block, F.lit(0).cast("long"))
    rows = rows.withColumns({"block": block, "key": F.coalesce("id", F.lit(-(2**63)).cast("long")), "tie": tie}).drop("bucket")
    # A narrow row for each block.
    order = Window.orderBy("block")
    last = F.max("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = rows.select("block").distinct().select("block", F.coalesce(F.lag("block").over(order), last).alias("to"))
    # All three readers of the placed rows use the same columns of one shuffle, which so is written once.
    w = Window.partitionBy("block").orderBy("key", "tie")
    held = rows.select("block", "id", "key", "tie", "text").repartition("block")
    placed = held.withColumns({"place": F.row_number().over(w), "next": F.lead("text").over(w)})
    firsts = held.withColumn("place", F.row_number().over(w)).where("place = 1").select("block", F.col("id").alias("first_id"), F.col("text").alias("first"))
    extra = firsts.join(before, "block").select(F.col("to").alias("block"), "first_id", "first")
    inner = placed.where("next is not null").select("block", "place", F.lit(False).alias("copy"), "id", "text", "next")
    one = lambda place, copy, i, text, after: F.struct(place.alias("place"), F.lit(copy).alias("copy"), i.alias("id"), text.alias("text"), after.alias("next"))
    ends = placed.where("next is null").join(extra, "block").select("block", F.inline(F.array(
        one(F.col("place"), False, F.col("id"), F.col("text"), F.col("first")),
        one(F.col("place") + 1, True, F.col("first_id"), F.col("first"), F.lit(None).cast("string")))))
    return inner.unionByName(ends)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", first_rounds: int = 3, rows_per_block: int = 512) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, digests_removed,
    digests_added) for every row; the last two are the paragraph digests that peeling recovers from the difference of the
    text's and the edited text's sketches: those of the one, and those of the other.

    The edited text has the last quarter of its code points replaced by as many of the next document's first.
    A fingerprint is the text's sketch, written out: its width is that of the size class of its paragraphs. Likeness
    is |both| / |either| of the paragraph sets, from their sizes and the number of digests that peeling recovers from
    the difference of the two fingerprints, the wider folded to the narrower. Where a cell stays unpeeled, both sides
    are sketched anew, twice as wide and by another seed, until none is left. Two texts without paragraphs are alike
    (1).

    Null text counts as empty; repeated rows each have a row, and follow one another; null ids come first; an empty
    table gives no rows; texts have any length; columns beside the two are not read, whatever their names.
    """
    spark = docs.sparkSession
    s = successors(docs, id_col, text, rows_per_block)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    s = s.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(F.col("next"), F.lit(1), quarter)))
    s = s.select(*KEYS, "copy", "id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), paragraph_digests(F.col("text")).alias("own"), paragraph_digests(F.col("edited")).alias("changed"))
    s = materialize(s, "digests")
    sides = ("own", "changed")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Few rows to a task, so that its cells fit in memory; without the number, Spark would merge the partitions by
    # the size of the digests, which is a small part of that of the cells.
    dealt = s.repartition(max(least, s.count() // 2500), "block")
    # Every version's sketch on its own: what is subtracted and what is returned are these.
    versions = dealt.select(*KEYS, "copy", F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("digests")) for c in sides))).alias("v")).select(*KEYS, "copy", "v.*")
    cell = F.struct("cell", "n", "d", "h")
    size = lambda c: F.coalesce(F.max(F.when(F.col("side") == c, F.col("size"))), F.lit(0)).alias(f"n_{c}")
    versions = versions.withColumns({"size": F.size("digests"), "width": width(F.size("digests")), "seed": F.lit(0), "digests": F.when(F.size("digests") > 0, F.col("digests")).otherwise(F.array(F.lit(None).cast("long")))})
    sketches = sketched(versions, [*KEYS, "copy", "side", "size"]).groupBy(*KEYS, "copy").agg(*(F.collect_list(F.when((F.col("side") == c) & (F.col("size") > 0), cell)).alias(c) for c in sides), *map(size, sides))
    pair = [*KEYS, "other"]
    # The next document's sketch is its own one: a block's last row is the next block's first.
    w = Window.partitionBy("block").orderBy("place")
    met = sketches.withColumns({"after": F.lead("own").over(w), "n_after": F.lead("n_own").over(w)}).where("not copy")

    def difference(b: str) -> Column:
        """The cells of the text's sketch less those of b's, the wider folded to the narrower."""
        ours, theirs = width(F.col("n_own")), width(F.col(f"n_{b}"))
        narrow = F.least(ours, theirs)
        side = lambda c, w, sign: F.transform(F.col(c), lambda x: F.struct((F.floor(x["cell"] / w) * narrow + x["cell"] % w % narrow).cast("long").alias("cell"), (x["n"] * sign).alias("s"), x["d"].alias("d"), x["h"].alias("h")))
        return F.struct(F.lit(b).alias("other"), narrow.alias("width"), F.concat(side("own", ours, 1), side(b, theirs, -1)).alias("cells"))

    both = met.select(*KEYS, F.explode(F.array(difference("changed"), difference("after"))).alias("p")).select(*pair[:2], "p.other", "p.width", F.lit(0).alias("seed"), F.explode("p.cells").alias("c"))
    versions_only = F.col("other") == "changed"
    found = materialize(peel(both.select(*pair, "width", "seed", "c.*"), pair, first_rounds, versions_only), "peeled")
    solved = [found.where("left = 0").select(*pair, "differing", "digests")]
    failed = found.where("left > 0").select(*pair)
    t = 1
    while rows := failed.count():
        # A failed pair is sketched anew from its digests; what it needs of the next row meets it in the block.
        asked = failed.groupBy(*KEYS).agg(F.collect_set("other").alias("others"))
        told = s.join(asked, KEYS, "left").repartition(max(min(least, -(-rows // 500)), rows // 5000), "block").withColumn("after", F.lead("own").over(w))
        again = told.select(*KEYS, "own", "changed", "after", F.explode("others").alias("other")).withColumn("b", F.when(F.col("other") == "changed", F.col("changed")).otherwise(F.col("after")))
        most = F.greatest(width(F.size("own")), width(F.size("b"))) * 2**t
        again = again.withColumns({"width": most.cast("long"), "seed": F.lit(t)})
        both = again.select(*pair, "width", "seed", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("own").alias("digests")), F.struct(F.lit(-1).alias("sign"), F.col("b").alias("digests")))).alias("v")).select(*pair, "width", "seed", "v.*")
        cells = sketched(both, [*pair, "sign"]).select(*pair, "width", "seed", "cell", (F.col("sign") * F.col("n")).alias("s"), "d", "h")
        found = materialize(peel(cells, pair, keep=versions_only), "peeled")
        solved.append(found.where("left = 0").select(*pair, "differing", "digests"))
        failed = found.where("left > 0").select(*pair)
        t += 1
    differing = solved[0]
    for more in solved[1:]:
        differing = differing.unionByName(more)
    by = differing.groupBy(*KEYS).agg(F.max(F.when(F.col("other") == "changed", F.col("differing"))).alias("e"), F.max(F.when(F.col("other") == "after", F.col("differing"))).alias("n"), F.max(F.when(F.col("other") == "changed", F.col("digests"))).alias("digests"))

    def like(other: str, d: str) -> Column:
        total, d = F.col("n_own") + F.col(f"n_{other}"), F.coalesce(F.col(d), F.lit(0))
        return F.when(total == 0, 1.0).otherwise((total - d) / (total + d))

    def of_sign(sign: int) -> Column:
        got = F.coalesce(F.col("digests"), F.array().cast("array<struct<digest:long,sign:long>>"))
        return F.array_sort(F.transform(F.filter(got, lambda x: x["sign"] == sign), lambda x: x["digest"]))

    flat = s.where("not copy").select(*KEYS, "id", "n_chars", "edited_sha256")
    return flat.join(met.drop("after", "copy"), KEYS).join(by, KEYS, "left").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", written_out(F.col("own"), F.col("n_own")).alias("fingerprint"), written_out(F.col("changed"), F.col("n_changed")).alias("edited_fingerprint"),
        like("changed", "e").alias("near_edited"), like("after", "n").alias("near_next"), of_sign(1).alias("digests_removed"), of_sign(-1).alias("digests_added"))
