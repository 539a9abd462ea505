"""The corpus pipeline: quality classifier, near-duplicates, secret scan, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of ``documents``, all but the last,
which returns the pieces of packed sequences. ``run`` writes each result as Parquet and reads it back.

Every stage takes an empty table and returns one; texts have any length; extra columns, whatever their names, pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import mixing, neardup, packing, quality, secrets
from siteloom.llm.common import discard, materialize, scratch, table
from siteloom.llm.queries import quality_grade


def whole(docs: DataFrame) -> DataFrame:
    """The rows as one column, beside the id and the text: no name of a step meets one of theirs."""
    return docs.select(F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))


def again(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the rated ones of all documents, expects to be of the top grade.
    Null text counts as empty; repeated rows are each judged, alike."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality_grade(), levels=3)
    return again(quality.score(whole(docs), model).where("keep"), docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 80 %), that of the smallest id. Rows of one id
    whose texts are no near-duplicates are documents of their own; of those that are, and of repeated rows, the one of
    smallest text hash and, where texts are equal, of the smallest row (as JSON) stays, so reruns agree. Rows without an id, and without words, stay
    (of repeated ones one, if they have an id)."""
    found = neardup.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80).where("kept and id is not null")
    kept = found.groupBy("id", "group").agg(F.min("text_hash").alias("hash")).select("id", "hash")
    rows = whole(docs).withColumns({"id": F.col("doc_id").cast("long"), "hash": F.xxhash64("text")})
    chosen = rows.join(kept, ["id", "hash"], "left_semi")
    # Rows of equal id and text are few; where there are none, nothing meets again.
    many = materialize(rows.where("id is not null").groupBy("id", "hash").count().where("count > 1").select("id", "hash"), "repeated")
    if not many.isEmpty():
        first = chosen.join(many, ["id", "hash"], "left_semi").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
        chosen = chosen.join(many, ["id", "hash"], "left_anti").select("row").unionByName(first.select("row"))
    return again(chosen.select("row").unionByName(rows.where("id is null").select("row")), docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by the name of the rule that found them. Null text stays null; repeated
    rows are each replaced."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Documents without words are not taken;
    a null source is one of its own; repeated rows count each."""
    taken = mixing.mix(whole(docs).withColumn("source", F.col("row").getField("source")), into="told")
    copies = F.sequence(F.lit(1), (F.col("told.taken") / F.col("told.size")).cast("int"))
    return again(taken.where("told.taken > 0").select("row", F.explode(copies)), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. Null and empty texts are their end id; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", one_of_each),
    ("secret_scan", without_secrets),
    ("source_mixing", mixed),
    ("harmonic_packing", packed),
]

#: Neither classifier, forest nor tokenizer can be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves behind is removed once the next has read it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():
            done = materialize(stage(spark, docs, sf_dir), name, keep=True)
        discard(docs)
        docs = done
    return docs
