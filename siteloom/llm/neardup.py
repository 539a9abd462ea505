"""Near-duplicates by MinHash, banding, signature verification and connected components (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, with_fields
from .components import components

HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
_rng = np.random.default_rng(20)
#: Of the universal hash functions x -> (a x + b) mod 2^32, a odd.
A = _rng.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1)
B = _rng.integers(0, 2**32, HASHES, np.uint32)
#: Below this share of equal minima a pair is no candidate: six standard deviations under the similarity.
SLACK = 6.0
CHUNK_SHINGLES = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) > 300_000:
            self.clear()
        self[word] = found
        return found


def shingles(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of the whole sequence if it is shorter.

    Bytes are lower-cased and split as ASCII, which is what the words' definition says."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for j in range(min(size, len(h))):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def minima(s: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    best = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 2048):
        best = np.minimum(best, (x[i : i + 2048, None] * A + B).min(0))
    return best


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    data = s.tobytes()
    return xxhash.xxh64_intdigest(data) - 2**63, xxhash.xxh64_intdigest(data, 1) - 2**63


def signatures(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(id, t, n, k1, k2, bands, sig): the text's hash, set size, two hashes of the whole set, a hash for each band,
    low bytes of all minima. Empty sets have null bands."""
    small_batches(docs.sparkSession)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for t in b.column(2).to_pylist():
                s = shingles(t or b"", size, hashes)
                if not len(s):
                    rows.append((0, 0, 0, None, None))
                    continue
                m = minima(s)
                bands = [xxhash.xxh64_intdigest(m[ROWS * k : ROWS * (k + 1)].tobytes(), k) - 2**63 for k in range(BANDS)]
                rows.append((len(s), *set_hashes(s), bands, m.astype(np.uint8).tobytes()))
            n, k1, k2, bands, sig = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["id", "t", "n", "k1", "k2", "bands", "sig"])

    return docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text]).alias("t"), docs[text].cast("binary").alias("x")).mapInArrow(signed, "id long, t long, n long, k1 long, k2 long, bands array<long>, sig binary")


#: Bits of a filter of ids that may go to every task: 16 MB, for 8 million ids.
FILTER_BITS = 1 << 27
FILTER_HASHES = 4


def id_filter(ids: DataFrame) -> np.ndarray | None:
    """A Bloom filter of ``ids`` (least), as words of 32 bits; None where so many ids don't fit into FILTER_BITS. Tasks
    combine their bits, so what reaches the driver is the filter itself, whose size is known from the count."""
    bits = 1 << max(10, (16 * ids.count() - 1).bit_length())
    if bits > FILTER_BITS:
        return None
    words = ids.select(F.explode(filter_spots(bits)).alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("b")).toArrow()
    table = np.zeros(bits >> 5, np.uint32)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return table


def filter_spots(bits: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64("least", F.lit(k)), F.lit(bits)) for k in range(FILTER_HASHES)))


def shingle_sets(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(n, k1, k2, s): the whole set of each of ``texts`` (least, x) whose id is among ``ids`` (least), as bytes of sorted
    64-bit hashes, and what names it. Texts stay where they are: a filter of the ids, which lets few others through, goes to
    them. Where there are too many ids for one, the two are joined, and each text is shuffled once."""
    table = id_filter(ids)
    shared = None if table is None else texts.sparkSession.sparkContext.broadcast(table)
    if shared is None:
        near = texts.join(ids, "least", "left_semi").select("x")
    else:
        near = texts.where("least is not null").select("x", filter_spots(32 * len(table)).alias("spots"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            if shared is not None and b.num_rows:
                at = pa.compute.list_flatten(b.column(1)).to_numpy().reshape(-1, FILTER_HASHES)
                b = b.filter(pa.array((shared.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).all(1)))
            sets = [shingles(t or b"", size, hashes) for t in b.column(0).to_pylist()]
            keys = [(len(s), *set_hashes(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64()) for i in range(3)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["n", "k1", "k2", "s"])

    return near.mapInArrow(made, "n long, k1 long, k2 long, s binary")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_equal(percent: int) -> int:
    """Equal minima (of their low bytes) below which a pair is no candidate."""
    j = percent / 100
    return int(HASHES * j - SLACK * (HASHES * j * (1 - j)) ** 0.5)


def star_links(pairs: DataFrame, sets: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Which (u, v) pairs are linked. Signatures are compared first; the survivors' whole sets confirm."""
    floor = least_equal(percent)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("s1", "s2"))
            good = np.flatnonzero((x == y).sum(1) >= floor)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(good)) for c in ("u", "v")], names=["u", "v"])

    first = pairs.join(sigs.select(F.col("id").alias("u"), F.col("sig").alias("s1")), "u").join(sigs.select(F.col("id").alias("v"), F.col("sig").alias("s2")), "v").select("u", "v", "s1", "s2").mapInArrow(near, "u long, v long")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, x, y = (b.column(c).to_pylist() for c in ("u", "v", "x", "y"))
            good = [(p, q) for p, q, s, t in zip(u, v, x, y) if alike(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return first.join(sets.select(F.col("id").alias("u"), F.col("s").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("y")), "v").select("u", "v", "x", "y").mapInArrow(confirm, "u long, v long")


#: A frequent shingle's rows meet its count in so many tasks.
LOTS = 16


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(id, bucket): for each set (id, s) the rarest of its shingles, of which two linked sets share one at least.

    A set of n shingles that is linked with another shares percent * n / 100 of them or more. In any one order of all
    shingles, such two sets share one among the first n - ceil(percent * n / 100) + 1 of each. The order is by how many
    of the sets hold a shingle, so the keys are rare. Those that one set alone holds come first and need no row: a set
    with as many of them as its prefix is long has no key at all."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held = b.column("id").to_numpy(), [np.frombuffer(x, np.int64) for x in b.column("s").to_pylist()]
            n = np.array([len(x) for x in held], np.int64)
            at = 0
            while at < len(held):  # a few sets at a time, as a batch's sets may be long
                end = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), 1_000_000)) + at)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at:end], n[at:end])), pa.array(np.repeat(n[at:end], n[at:end])), pa.array(np.concatenate(held[at:end]))], names=["id", "n", "bucket"])
                at = end

    rows = sets.select("id", "s").mapInArrow(grams, "id long, n long, bucket long")
    often = rows.groupBy("bucket").agg(F.count("*").alias("df")).where("df > 1").withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))))
    met = rows.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(LOTS)).cast("int")).join(often, ["bucket", "lot"])
    own = met.groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "bucket"))).alias("v"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("v"))
    return own.select("id", F.explode(F.slice("v", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("x")).select("id", "x.bucket")


def cross_links(ids: np.ndarray, comps: np.ndarray, sides: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different components among rows of one block pair: between the two sides, or, if there is
    one side, within it. Those that join what earlier links joined already are left out."""
    root = {c: c for c in comps.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    floor, out, one = least_equal(percent), [], len(set(sides.tolist())) == 1
    n = np.array([len(s) for s in sets])
    for i in range(len(ids)):
        others = np.arange(i + 1, len(ids)) if one else np.flatnonzero(sides[i + 1 :] != sides[i]) + i + 1
        mine = find(int(comps[i]))
        others = others[[find(c) != mine for c in comps[others].tolist()]] if len(others) else others
        others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
        others = others[(sigs[others] == sigs[i]).sum(1) >= floor]
        for j in others.tolist():
            a, b = find(int(comps[i])), find(int(comps[j]))
            if a != b and alike(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
                out.append((a, b))
    return out


def partnered(comps: np.ndarray, sides: np.ndarray, n: np.ndarray, sigs: np.ndarray, within: bool, percent: int) -> np.ndarray:
    """Which rows of one block pair :func:`cross_links` may compare with another on whole sets."""
    floor, keep = least_equal(percent), np.zeros(len(n), bool)
    for i in range(len(n)):
        others = np.arange(i + 1, len(n)) if within else np.flatnonzero(sides[i + 1 :] != sides[i]) + i + 1
        others = others[comps[others] != comps[i]]
        others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
        others = others[(sigs[others] == sigs[i]).sum(1) >= floor]
        if len(others):
            keep[i] = keep[others] = True
    return keep


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept, group, text_hash) of every row: the smallest id linked to each document,
    directly or through others; ``group`` names the component also where ids repeat.

    Documents are linked when 100 * |both| >= percent * |either| over their sets of ``shingle``-word runs; without
    words (null, empty, blank), with nothing. Rows of equal sets collapse first. Rows that repeat an id are documents
    of their own if their sets differ, and copies if not; those of a null id are linked with nothing and kept. An
    empty table gives no rows; texts have any length; columns beside the two are not read, whatever their names.

    1. 128 minima in 32 bands of 4 (a linked pair at 80 % shares no band with probability 5e-8). Each row of a
       bucket is paired with the bucket's smallest id: as many pairs as rows, however large the bucket.
    2. Pairs are verified by signature, then confirmed on whole sets; large-star/small-star joins them.
    3. Buckets that still hold several components may hide links between rows other than their smallest. Those that
       make one chunk of bounded size are compared across components in a task. The rows of larger ones are keyed anew,
       by the rarest shingles of each set, as many as two linked sets can't both lack (exact, see :func:`prefixes`):
       rows of one template, alike in half of their shingles, then share no key. Groups of a key with several components
       are joined to their smallest rows as in 2.
    4. Groups of a key that hold several components even now (each set of rows once) are dealt into chunks, and every two
       chunks of a group are compared across components. Only links that join components leave a task. Components again.
    """
    size, key = shingle, ["n", "k1", "k2"]
    made: list[DataFrame] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        made.append(materialize(df, name))
        return made[-1]

    signed = written(signatures(docs, id_col, text, size), "signatures")
    full_rows = signed.where("id is not null and n > 0")
    # Equal sets: the same two hashes and size. A set's node is its smallest id; where an id has several sets, it is
    # that of the first of them, and the others get numbers below all ids that a hash makes.
    equal = full_rows.groupBy(*key).agg(F.min(F.struct("id", "bands", "sig")).alias("r")).select(*key, F.col("r.id").alias("least"), "r.bands", "r.sig")
    several = written(full_rows.groupBy("id").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).where("lo <> hi").select(F.col("id").alias("least"), "lo"), "several")
    other = F.lit(-1) - F.shiftrightunsigned(F.xxhash64("least", *key), 1)
    node = F.when(F.col("lo").isNull() | (F.col("lo") == F.struct(*key)), F.col("least")).otherwise(other)
    heads = written(equal.join(several, "least", "left").withColumn("id", node).drop("lo"), "heads")
    rows = heads.select("id", F.explode("bands").alias("bucket"))
    buckets = written(rows.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("id").alias("least"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark")).where("rows > 1"), "bucket-sizes")
    shared = written(rows.join(buckets, "bucket"), "buckets")
    wanted = shared.select("id").distinct()
    # Whole sets are made only for rows that share a bucket.
    named = written(heads.join(wanted, "id", "left_semi").select("id", "least", *key), "wanted")
    texts = docs.select(docs[id_col].cast("long").alias("least"), docs[text].cast("binary").alias("x"))
    # Copies combine where they are made; what names a set is its row's only one.
    full = shingle_sets(texts, named.select("least").distinct(), size).groupBy(*key).agg(F.first("s").alias("s"))
    sets = written(full.join(named.drop("least"), key).select("id", "s"), "sets")
    sigs = heads.join(wanted, "id", "left_semi").select("id", "sig", "n")
    pairs = shared.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()
    links = written(star_links(pairs, sets, sigs, percent), "links")
    first = written(components(links), "first")

    # Buckets that still hold several components: a link between two of their rows may be open. Buckets of several bands
    # often hold the same rows: one of them is enough.
    mixed_rows = shared.where("rows > 2").join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = mixed_rows.groupBy("bucket").agg(F.first("rows").alias("c"), F.first("mark").alias("mark"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    mixed = mixed.groupBy("c", "mark").agg(F.min("bucket").alias("bucket"))
    open_rows = written(mixed_rows.join(mixed.select("bucket"), "bucket").join(sigs, "id").select("bucket", "id", "component", "sig", "n"), "open")

    def chunked(rows: DataFrame) -> DataFrame:
        """(bucket, chunks): how many parts of bounded size a group of rows makes."""
        loads = rows.groupBy("bucket").agg(F.sum("n").alias("load"), F.count("*").alias("rows"))
        return loads.select("bucket", F.ceil(F.greatest(F.col("load") / CHUNK_SHINGLES, F.col("rows") / 1000)).cast("int").alias("chunks"))

    parts = written(chunked(open_rows), "chunks")
    small = open_rows.join(parts.where("chunks = 1"), "bucket")
    keyed = written(prefixes(sets.join(open_rows.join(parts.where("chunks > 1"), "bucket").select("id").distinct(), "id"), percent), "prefixes")

    def groups(known: DataFrame) -> DataFrame:
        """Rows of prefix shingles that hold several components, each set of rows once."""
        told = keyed.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
        some = told.groupBy("bucket").agg(F.count("*").alias("c"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"), F.min("id").alias("least"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        once = some.groupBy("c", "mark").agg(F.min(F.struct("bucket", "least")).alias("r")).select("r.*")
        return told.join(once, "bucket")

    second, placed = first, small.withColumn("kind", F.lit(0))
    if not keyed.isEmpty():
        star = written(groups(first).where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct(), "prefix-stars")
        second = written(components(first.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(star_links(star, sets, sigs, percent))), "second")
        large = written(groups(second).join(sigs, "id").select("bucket", "id", "component", "sig", "n"), "open-prefixes")
        placed = placed.unionByName(large.join(chunked(large), "bucket").withColumn("kind", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # Chunk c meets itself and every other chunk: it goes to the pairs (min, max).
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "kind", "bucket", "id", "component", "sig", "n", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")
    )

    def hopeful(t: pa.Table) -> pa.Table:
        """The rows that have a partner of another component, of like size and signature: no other needs its whole set."""
        return t.filter(pa.array(partnered(
            t.column("component").to_numpy(), t.column("chunk").to_numpy(), t.column("n").to_numpy(), np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES),
            t.column("lo")[0].as_py() == t.column("hi")[0].as_py(), percent)))

    met = met.groupBy("kind", "bucket", "lo", "hi").applyInArrow(hopeful, met.schema).drop("n").join(sets, "id")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        found = cross_links(
            t.column("id").to_numpy(), t.column("component").to_numpy(), t.column("chunk").to_numpy(),
            np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES),
            [np.frombuffer(s, np.uint64) for s in t.column("s").to_pylist()], percent,
        ) if t.num_rows > 1 and (t.column("lo")[0].as_py() == t.column("hi")[0].as_py() or len(set(t.column("chunk").to_pylist())) > 1) else []
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    more = met.groupBy("kind", "bucket", "lo", "hi").applyInArrow(compare, "u long, v long")
    joined = second.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more)
    final = written(components(joined), "components")
    # A component's name is its smallest node; its smallest id may be that of another.
    least = final.join(heads.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = written(heads.select(*key, "id", "least").join(final.join(least, "component"), "id", "left").select(*key, F.coalesce("component", "id").alias("group"), F.coalesce("component_id", "least").alias("component_id")), "by-set")
    # The rows' own shuffle meets the sets' own: a large group of copies can be split.
    out = written(
        signed.where("id is not null and n > 0").join(by_set, key).select("id", "n", "component_id", "group", "t")
        .unionByName(signed.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id"), F.col("id").alias("group"), "t"))
        .select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "group", F.col("t").alias("text_hash")), "near-duplicates")
    for df in made[:-1]:
        discard(df)
    return out
