"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import BUCKET_BITS, ascii_lower, bitmap, bitmap_buckets, marked, pick
from cellweft.runtime import discard, materialize, relieve, short_batches

#: Buckets of 4 KiB, at most, of the bitmap of groups that survive: 16 MiB, which is broadcast.
SURVIVORS = 4096


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, buckets: int = SURVIVORS, digest_all: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z. Of equal texts the largest id stays.

    1. A scan gives each row's byte length and a hash of its first ``prefix_chars`` characters.
    2. Lengths that occur once, then (length, prefix) pairs that occur once, are out.
    3. What is left is marked in a bitmap of 16 bits or more for each group, ``buckets`` * 4 KiB at most, which is broadcast. Beyond
       its bound (some 8 million groups) it fills up, which costs needless hashing, never a wrong result.
    4. A second scan hashes the whole texts of marked rows only, and groups them by the full hash.

    Both scans read texts in batches of 512 rows where the session has Spark's default of 4,096 (set for their time only), and executors collect garbage before and after each.

    ``digest_all`` also hashes the rows that are out, for callers who want ``text_sha256`` in every row; else it
    is null for them. Texts never cross a shuffle; the rows that do are narrow, groups are aggregated before the
    shuffle, and the join back is one that adaptive execution splits if a group is large.

    Null text is empty text; empty texts equal each other. A null id never wins against another id; where all ids of
    a group are null, keep_id is null and all its rows are kept. Repeated rows with the winning id are all kept, as
    they are one document. Extra columns are ignored. An empty table gives an empty result.
    """
    rows = pick(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    head = F.xxhash64(ascii_lower(F.substring("text", 1, prefix_chars)))
    relieve(docs.sparkSession)
    with short_batches(docs.sparkSession):
        keys = materialize(rows.select(size.alias("n_bytes"), head.alias("head")).groupBy("n_bytes", "head").agg(F.count("*").alias("n")), "dedup-keys")
    relieve(docs.sparkSession)
    lengths = keys.groupBy("n_bytes").agg(F.sum("n").alias("of_length")).where("of_length > 1")
    shared = keys.where("n > 1").join(lengths, "n_bytes", "left_semi")
    n_bits = bitmap_buckets(keys.where("n > 1").count(), buckets) * BUCKET_BITS
    bit = F.pmod(F.xxhash64("n_bytes", "head"), F.lit(n_bits)) + 1
    hashed = marked(rows.select("id", "text", size.alias("n_bytes"), head.alias("head")), bitmap(shared, bit), bit)
    digest = F.sha2(ascii_lower(F.col("text")), 256)
    hashed = hashed.select("id", "n_bytes", "marked", (digest if digest_all else F.when(F.col("marked"), digest)).alias("text_sha256"))
    with short_batches(docs.sparkSession):
        hashed = materialize(hashed, "dedup-digests")
    relieve(docs.sparkSession)
    discard(keys)
    groups = hashed.where("marked").groupBy("n_bytes", "text_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = materialize(groups.select(F.col("text_sha256").alias("of"), "keep_id", "group_size"), "dedup-groups")
    # Rows that are out join on a key of their own, so that they do not meet in one partition.
    out = hashed.withColumn("of", F.coalesce("text_sha256", F.concat(F.lit("-"), F.xxhash64("id", "n_bytes").cast("string"))))
    out = out.join(groups, "of", "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")
