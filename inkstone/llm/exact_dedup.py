"""Exact deduplication by content hash, with DataFrame functions only.

Every text (null: empty), lower-cased for A-Z, gets a 128-bit hash. Hashes alone are shuffled and counted,
pre-aggregated on the map side, so that a group that holds a third of all rows sends one row from each task. Texts
move only where a hash occurs more than once: they are grouped by hash and whole text, again pre-aggregated, which
compares their bytes and tells apart texts that collide.

Which rows may matter is known from a sieve of the repeated hashes, a bitmap of 64 to 128 bits for each and at most
128 MB, which is broadcast; beyond 16 million repeated hashes it passes ever more single texts (one in 16 with 67
million), which costs time and no row.

Defined results: null text equals the empty text. Rows without doc_id count in their group and are chosen only where
no row of it has one (keep_id is null then, and they all stay). Rows that repeat a doc_id are reported each. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sieve, ascii_lower, staged, without


def _normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def exact_groups(docs: DataFrame, *, keep: str = "max") -> DataFrame:
    """doc_id, keep_id (largest doc_id of the group, or smallest with keep="min"), group_size, kept, text_sha256."""
    choose = {"max": F.max, "min": F.min}[keep]
    rows = docs.select("doc_id", _normal(F.col("text")).alias("body"))
    digests = staged(
        rows.select(
            "doc_id",
            F.unhex(F.md5(F.col("body").cast("binary"))).alias("hash"),
            F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"),
        ),
        "exact-digests",
    )
    counts = digests.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    repeated = Sieve(staged(counts.where("n > 1").select("hash"), "exact-repeated"), "hash")
    hashed = rows.withColumn("hash", F.unhex(F.md5(F.col("body").cast("binary"))))
    # the aggregates need the bytes of a text only; equal bytes make one variant of a hash
    variants = (
        repeated.passed(hashed, hashed["hash"])
        .groupBy("hash", "body")
        .agg(choose("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("hash", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"), "keep_id", "group_size")
    )
    found = digests.join(variants, ["hash", "sha"], "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, *, keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that repeat a kept doc_id stay with it, and a row goes
    only where its own text is a copy, whatever other rows without doc_id or with the same one hold."""
    gone = exact_groups(docs, keep=keep).where("not kept")
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone_key"))
    return without(docs, gone, lambda text: F.unhex(F.sha2(_normal(text).cast("binary"), 256)))
