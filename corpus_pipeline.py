"""A training corpus from raw documents: language, repeated lines, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of documents; a changed text brings its n_chars up to date.
Every stage takes all that the one before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard_join, language_id, line_dedup, packing, pii
from quillon.llm._shared import freed, stored

CAPACITY = 2048


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        docs = docs.withColumn("n_chars", F.char_length("text").cast(kind))
    return docs.select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language, however unsure which: those without letters (`und`), null and empty texts go.

    Null ids, repeated rows and columns of any name stay; of an empty table nothing is learned and nothing kept.
    """
    model = language_id.fit_language_model(docs.where(~language_id.held_out("doc_id")))
    found = language_id.with_language(docs, model, pred_col="_quillon_lang", score_col="_quillon_score")
    return found.where("_quillon_lang <> 'und'").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated lines; documents of which no line is left go.

    Null and empty texts have no lines and stay; null ids, repeated rows, ties, very long texts and clashing columns are
    those of `dedup_lines`; of an empty table nothing is kept.
    """
    found = line_dedup.dedup_lines(docs)
    return _with_length(found.where((F.col("n_deleted") == 0) | (F.col("text") != "")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates, and one of equal rows.

    Texts without words are in no group and stay. Rows with null ids stay if one of them has no copy with an id. Only the
    ids that go and the ids that repeat are joined with the documents, whose texts are shuffled, once, only if those are many.
    Very long texts are compared whole; of an empty table nothing is kept; other columns stay as they are.
    """
    named = jaccard_join.jaccard_components(docs).groupBy(F.col("doc_id").alias("_quillon_id"))
    marks = named.agg(F.max(F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("_quillon_stays"), F.count("*").alias("_quillon_rows"))
    marks = stored(marks.where("not _quillon_stays or _quillon_rows > 1"), "marks")
    few = marks.count() <= jaccard_join.BROADCAST_ROWS
    left = docs.join(F.broadcast(marks) if few else marks, docs["doc_id"].eqNullSafe(F.col("_quillon_id")), "left").where("coalesce(_quillon_stays, true)")
    once = left.where("_quillon_rows > 1").withColumn("_quillon_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_quillon_h"]).drop("_quillon_h")
    return left.where("_quillon_rows is null").unionByName(once).drop(*marks.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by placeholders; every row stays, null and empty texts as they are.

    Null ids, repeated rows and other columns stay; very long texts are looked at whole; an empty table stays empty.
    """
    return _with_length(pii.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences; a null or empty text is a piece of one end token.

    Null ids and repeated rows are packed like others, ties of length in the order of tasks and rows; very long texts are cut
    into pieces; other columns are ignored; an empty table gives none.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("pack", pack)]
#: SQL can express neither the classifiers nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage_{name}")
        if k:  # what the stage before has kept is read by no other
            freed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
