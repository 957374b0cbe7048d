"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, encoding.

Each stage takes all that its predecessor kept and calls one operator of leafmill.llm; all but the last return the
columns of documents. Rows are judged by id and text: rows of one id with other texts stand for themselves. Rows with
null in any column, empty and repeated ones go through each stage as its operator says: the first stage already
rejects texts that are null or have under ten words; of repeated rows of one id and text the near-duplicate stage keeps
one, the least by its other columns. Rows without a doc_id are never duplicates, as no id stands for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, table
from leafmill.llm.decontaminate import decontaminate
from leafmill.llm.pieces import encode
from leafmill.llm.pii import sanitised
from leafmill.llm.quality import fit, quality_rules
from leafmill.llm.simhash import similar_texts


#: Keys of rows to be dropped that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 200_000


#: Names of a row's id and text for joins; documents have none such.
KEY = ["__row_id", "__row_hash"]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of these KEYs. Few are broadcast, so texts are not dealt anew."""
    gone = checkpointed(gone.distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(KEY[0])) & (F.xxhash64("text") == F.col(KEY[1])), "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep. Judged row by row, so no text is dealt anew."""
    return quality_rules(docs, fit(docs, table(spark, sf_dir, "labels")), keep_columns=True)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 alike: that with the smallest id."""
    found = checkpointed(similar_texts(docs).withColumnsRenamed({"doc_id": KEY[0], "text_hash": KEY[1]}))
    unique = _without(docs, found.where((F.col(KEY[0]) != F.col("component_id")) | (F.col(KEY[1]) != F.col("component_hash"))).select(*KEY))
    repeated = checkpointed(found.groupBy(*KEY).count().where("count > 1").select(*KEY))
    if repeated.isEmpty():
        return unique
    # Only rows that occur again are gathered by id and text.
    again = unique.withColumn(KEY[0], F.col("doc_id")).withColumn(KEY[1], F.xxhash64("text")).join(repeated, KEY, "left_semi")
    again = again.groupBy(*KEY).agg(F.min(F.struct(*docs.columns)).alias("__row_least")).select("__row_least.*")
    return _without(unique, repeated).unionByName(again)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words (or a whole shorter item) of the benchmark."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias(KEY[0]), F.col("text_hash").alias(KEY[1])))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what reveals it put as placeholders or removed; n_chars follows the text."""
    return sanitised(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces."""
    made = encode(docs)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "score", "decoded_sha256")


STAGES = [
    ("quality_rules", quality),
    ("simhash", near_duplicate),
    ("decontaminate", contamination),
    ("pii", personal_data),
    ("sentencepiece", encoding),
]

#: None: hashes, forests, co-occurrence and pieces are beyond SQL. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
