"""The corpus pipeline: documents through five training-data operators, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows as
Parquet in the shared folder and hands them, read again, to the next. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import bpe, decontaminate, exact_dedup, language, ngram_join
from terrace.llm.shared import read, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents of undetermined language (no text, no letter) go."""
    return language.keep_known_languages(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near duplicates the smallest doc_id stays."""
    return ngram_join.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: doc_id, the packed token ids, their number, and whether they decode to the text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, apart=True, decoded="decoded")
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.select("doc_id", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("near_duplicates", near_copies),
    ("decontamination", decontaminated),
    ("byte_bpe", tokens),
]

#: Linking near duplicates and encoding are beyond SQL. Tests hold each stage against a brute-force
#: version (tests/llm/test_queries.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table: one row for each document that all of them keep."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
