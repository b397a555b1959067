"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, encoding.

Each stage takes all that its predecessor kept and returns the columns of
``documents``; the last returns the encoded documents.  ``run`` writes each stage's
result to the shared folder as Parquet and reads it again.

Defined results: a null text has no language and goes with the first stage, as do texts
without a letter; null ids, languages, sources and lengths stay null (the first stage sets
the language, the second the length); repeated rows count as copies of each other; rows of
one id with different texts are different documents; texts of any length pass whole; an
empty table gives an empty result; other columns of the table, whatever their names, are
neither read nor returned.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, decontaminate, language_mix, line_dedup, simhash_pivots
from tallyloom.llm.common import cut, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("doc_id", "lang", "source", "n_chars")
#: Language ID rejects a document whose leading language has no larger share of it, or no language at all.
LEAST_SHARE = 0.5


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, which only equal rows share: null ids last, then the id and a hash of all columns."""
    return docs.withColumn("row", F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.xxhash64(*COLUMNS).alias("content")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language that leads; ``lang`` becomes what the text is in."""
    model = language_mix.fit(language_mix.training_rows(docs))
    judged = language_mix.predict(docs.select(F.struct(*REST).alias("row"), "text"), model, key="row", text="text")
    good = judged.filter((F.col("lang_pred") != language_mix.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return good.select("doc_id.doc_id", "text", F.col("lang_pred").alias("lang"), "doc_id.source", "doc_id.n_chars")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document that keeps none of its lines goes."""
    done = line_dedup.dedup_lines(_columns(docs))
    left = (F.col("n_dropped") == 0) | (F.length(F.trim(F.translate("text", "\n\t\r", "   "))) > 0)
    return done.filter(left).select("doc_id", "text", "lang", "source", F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity of 0.8 or more): one with the smallest id, a null id only if there is no other.

    Rows are told apart by all their columns, so other texts of the same id keep their own groups.
    """
    rows = _identified(_columns(docs))
    found = simhash_pivots.near_duplicates(rows.select("row", "text"), width=5, least=0.8, key="row")
    kept = cut(found.filter(F.col("component_id") == F.col("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")))
    kept = kept.select(F.col("doc_id.content").alias("_content"), F.col("doc_id.doc_id").alias("_id"), "n")
    named = rows.join(kept, (F.col("row.content") == F.col("_content")) & F.col("row.doc_id").eqNullSafe(F.col("_id")))
    once = named.filter("n = 1").select(*COLUMNS)
    if kept.filter("n > 1").isEmpty():
        return once
    return once.unionByName(named.filter("n > 1").dropDuplicates(["_content", "_id"]).select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.scan(docs.select(F.struct(*REST).alias("row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row")
    return found.filter(F.size("hit_words") == 0).select("doc_id.doc_id", "text", "doc_id.lang", "doc_id.source", "doc_id.n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and digests of the ids and of what they decode to."""
    done = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("byte_bpe", encoded),
]

#: SQL can express neither the language model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
