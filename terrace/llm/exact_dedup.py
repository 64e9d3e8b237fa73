"""Exact deduplication with a heavy-hitter split (native).

A frequent-items sketch of the Misra-Gries family (Spark's approx_top_k) proposes digests that
may hold many rows. One exact aggregation over the proposed digests alone verifies them; the
winners, at most `max_heavy` rows, are broadcast and settle their rows on the map side. All other
digests go through an ordinary shuffle and a window, whose groups are then small. The split only
decides which road a row takes: both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.shared import stored

SPACE_RUN = r"[\x20\x09-\x0D]+"


def with_digest(docs: DataFrame, text: str = "text", name: str = "text_sha256") -> DataFrame:
    """Adds the SHA-256 of the text after each run of white space has become one space; null
    counts as the empty text."""
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_RUN, " ")
    return docs.withColumn(name, F.sha2(normal.cast("binary"), 256))


def heavy_digests(keyed: DataFrame, key: str, order: str, max_heavy: int = 1000, tracked: int = 8192, least: int = 64) -> DataFrame:
    """(key, keep, size) of verified frequent keys: at most max_heavy rows.

    keep is the smallest `order` value of the key, size its rows. The sketch tracks `tracked`
    counters, so every key with more than about rows / tracked occurrences is proposed; a key it
    misses is only settled by the shuffle instead.
    """
    proposed = keyed.agg(F.expr(f"approx_top_k({key}, {max_heavy}, {tracked})").alias("top")).select(F.inline("top")).filter(F.col("count") >= least).select(F.col("item").alias(key))
    return keyed.join(F.broadcast(proposed), key, "left_semi").groupBy(key).agg(F.min(order).alias("keep"), F.count("*").alias("size")).filter(F.col("size") >= least)


def duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits: int) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts are; the smallest doc_id of a group stays, and of
    repeated rows with that doc_id exactly one. A null id comes after all others; a null text
    equals the empty one. An empty table gives no rows. Other columns are not looked at.
    """
    keyed = stored(with_digest(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "digests")
    heavy = stored(heavy_digests(keyed, "text_sha256", "doc_id", **limits), "heavy").withColumn("heavy", F.lit(True))
    split = keyed.join(F.broadcast(heavy), "text_sha256", "left")
    settled = split.filter("heavy and not (doc_id <=> keep)").select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.lit(False).alias("kept"), "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = split.filter("heavy is null or doc_id <=> keep").select(
        "doc_id",
        F.min("doc_id").over(group).alias("keep_id"),
        F.coalesce(F.first("size").over(group), F.count("*").over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.asc_nulls_last("doc_id"))) == 1).alias("kept"),
        "text_sha256",
    )
    return rest.unionByName(settled)


def drop_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits: int) -> DataFrame:
    """docs without the rows whose equal text stays elsewhere; same columns.

    The rules are those of duplicate_groups. Rows of heavy digests go on the map side; whole rows
    of the others cross the network once.
    """
    digest, rank = "__digest", "__rank"
    keyed = stored(with_digest(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), name="key").drop("text"), "digests")
    heavy = stored(heavy_digests(keyed, "key", "doc_id", **limits), "heavy").select(F.col("key").alias(digest), F.col("keep").alias("__keep"), F.lit(True).alias("__heavy"))
    split = with_digest(docs, text, digest).join(F.broadcast(heavy), digest, "left")
    left = split.filter(F.col("__heavy").isNull() | F.col(doc_id).eqNullSafe(F.col("__keep")))
    first = Window.partitionBy(digest).orderBy(F.asc_nulls_last(doc_id))
    return left.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1).select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts and whether it stays."""
    from terrace.llm.shared import read

    return duplicate_groups(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d
"""
