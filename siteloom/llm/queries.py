"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, html, lmscore, mixing, neardup, packing, periodic, quality, secrets, sketch, telephony, topk
from .common import materialize, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, shingle=3, percent=85).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).drop("scored")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "start", "length", "rule", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "secret")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality_grade(), levels=3)
    return quality.score(docs, model).drop("text")


def quality_grade():
    """0: poor and toxic, 1: one of them, 2: neither."""
    return F.col("quality") + 1 - F.col("toxic")


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_period(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    told = periodic.repeats(docs).withColumn("best", periodic.longest(F.col("runs")))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is written as a table in the shared folder; what follows is read back from it."""
    media = materialize(telephony.store(table(spark, sf_dir, "documents").select("doc_id", "text")), "media", keep=True, codec="zstd")
    told = telephony.decoded(media, with_pcm=False)
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("codec", "samples", "peak", "rms", "crossings", "pcm_crc32")))
    return told.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_source_mix": op2_source_mix,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_main_text": op5_main_text,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_harmonic_packing": op7_harmonic_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_divergence_audit": op12_divergence_audit,
    "op13_telephony": op13_telephony,
}

P = "1 + 1000000000 * ({0} + 1) // ({1} + v)"

ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 3 THEN [array_to_string(x, ' ')] ELSE list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS g FROM s), often AS (SELECT g FROM u GROUP BY g HAVING count(*) > 1), t AS (SELECT u.* FROM u SEMI JOIN often USING (g)),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a), c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(least, n.doc_id)) AS component_id, n.doc_id <= coalesce(least, n.doc_id) AS kept FROM n LEFT JOIN c USING (doc_id)""",
    "op6_exact_top_k": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op12_divergence_audit": rf"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k FROM documents),
w AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 3), g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL), n AS (SELECT lang, source, CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, kept.term, coalesce(c, 0) AS c, {P.format("coalesce(c, 0)", "n")} AS p FROM n JOIN kept ON kept.lang = n.lang JOIN v ON v.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
l AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL), q AS (SELECT lang, term, CAST({P.format("c", "sum(c) OVER (PARTITION BY lang)")} AS BIGINT) AS q FROM l JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200""",
}
