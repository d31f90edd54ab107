"""Exact dedup by progressive refinement: length, then a hash of the first characters, then a full hash.

Texts are equal when they are identical after lower-casing A-Z. The first two levels only count (partial aggregates, so a
group of copies that holds a third of all rows reaches the shuffle as one row per task). Only rows whose (length, prefix hash)
occurs again have their whole text hashed. Texts are never shuffled to decide; rows of some 60 bytes are.

Defined cases: a null text is an empty text; a null key ranks below all others; of repeated rows with the same key and text
exactly one is kept; an empty table gives an empty result; further columns pass through ``carry``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlake.llm.common import lower_ascii, table, text_of, written

#: Characters of the second level.
PREFIX = 256
#: Up to so many (length, prefix hash) pairs, 16 bytes each, are broadcast; more are joined by a shuffle of narrow rows.
BROADCAST_KEYS = 1_000_000
#: A group with more than this part of all rows does not go through the shuffle.
HOT = 1000


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: key, the carried columns, ``keep_id``, ``group_size``, ``kept``, ``full`` (hash, null where unique)."""
    whole = text_of(text)
    length = F.octet_length(whole)
    prefix = F.xxhash64(lower_ascii(F.substring(whole, 1, PREFIX)))

    lengths = docs.groupBy(length.alias("_n")).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("_n")
    heads = docs.select(length.alias("_n"), prefix.alias("_head")).groupBy("_n", "_head").agg(F.count(F.lit(1)).alias("_rows"))
    again = written(heads.filter("_rows > 1").join(lengths, "_n", "left_semi").select("_n", "_head"))

    rows = docs.select(F.col(key).alias("_key"), *carry, length.alias("_n"), prefix.alias("_head"), whole.alias("_text"))
    digest = F.unhex(F.sha2(lower_ascii(F.col("_text")), 256))
    found = again.withColumn("_again", F.lit(True))
    if again.count() <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(found), ["_n", "_head"], "left")
        rows = rows.withColumn("_full", F.when(F.col("_again"), digest)).drop("_text")
    else:  # hashing costs less than moving texts to where the survivors are known
        rows = rows.withColumn("_full", digest).drop("_text").join(found, ["_n", "_head"], "left")
        rows = rows.withColumn("_full", F.when(F.col("_again"), F.col("_full")))
    rows = written(rows.drop("_again", "_head"))

    copies = rows.filter("_full IS NOT NULL")
    groups = copies.groupBy("_n", "_full").agg(F.max("_key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.filter("group_size > 1"))
    # fewer than HOT groups can hold more than 1 / HOT of all rows: they are broadcast, and their rows stay where they are
    large = F.col("group_size") * HOT > rows.count()
    hot, cold = F.broadcast(groups.filter(large)), groups.filter(~large)
    on = ["_n", "_full"]
    joined = copies.join(hot, on).unionByName(copies.join(hot, on, "left_anti").join(cold, on, "left"))
    alone = rows.filter("_full IS NULL").withColumns({"keep_id": F.col("_key"), "group_size": F.lit(None).cast("long")})
    joined = joined.unionByName(alone).select(
        "_key",
        *carry,
        F.when(F.col("group_size").isNull(), F.col("_key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("group_size").isNull().alias("_alone"),
        F.col("_full").alias("full"),
    )
    # repeated rows share key and text: number them, so that one of them stays
    turn = F.row_number().over(W.partitionBy("full", "_key").orderBy("_alone"))
    kept = F.col("_alone") | (F.col("_key").eqNullSafe(F.col("keep_id")) & (F.col("_turn") == 1))
    return joined.withColumn("_turn", turn).select(
        F.col("_key").alias(key), *carry, "keep_id", "group_size", kept.alias("kept"), "full"
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; the text moves once, to meet the decision."""
    mark = F.xxhash64(lower_ascii(text_of(text)))
    marked = docs.withColumn("_mark", mark).withColumn("_key2", F.col(key))
    stay = exact_groups(marked, key=key, text=text, carry=("_mark",)).filter("kept").select(F.col(key).alias("_key2"), "_mark")
    over = W.partitionBy("_key2", "_mark")
    # rows that share key and text may differ elsewhere: the order by all columns makes reruns agree
    left = marked.withColumn("_turn", F.row_number().over(over.orderBy(F.xxhash64(*docs.columns))))
    right = stay.withColumn("_turn", F.row_number().over(over.orderBy(F.lit(1))))
    same = [left[c].eqNullSafe(right[c]) for c in ("_key2", "_mark", "_turn")]
    return left.join(right, same[0] & same[1] & same[2], "left_semi").select(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(lower_ascii(text_of()), 256))
    return exact_groups(docs, carry=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)
"""
