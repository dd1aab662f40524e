"""Operator 7: exact deduplication by an extendible-hash index on shared files.

Texts that are equal after deleting white space form a group. The index has one entry per distinct text: its 64-bit hash, which
addresses a bucket, and its SHA-256 digest and length, which tell apart the entries chained under one hash. Entries of several rows are
checked on the texts themselves: their normalised bytes are compared, and the job stops should a digest ever stand for two texts.
Copies fold into their entry before anything is shuffled by hash, so a group of any size is one entry per task.

A directory maps the leading bits of the hash to buckets. It starts with one bucket; a bucket with more than `capacity` entries is
split by the next bit, and the directory doubles as often as its deepest bucket needs. The splits follow from the counts of the
deepest slots: the bucket of a slot is its shortest prefix that is not overfull. Entries of one and the same slot beyond the deepest
level stay chained in their bucket. The index is written range-partitioned and sorted by (bucket, hash), so each owner task holds a
range of keys; every row then looks its entry up by an equi-join.

Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.checks import InputError
from spotweave.llm.common import delete_spaces, text_of
from spotweave.session import materialise, shared_dir

CAPACITY = 50_000
DEEPEST = 16  # a directory of at most 65,536 slots; deeper levels would only make buckets smaller


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
    return d.select("doc_id", F.length("_t").cast("long").alias("chars"), delete_spaces(F.col("_t")).alias("norm"))


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, chars, hash, digest, bytes) per row. A null text counts as empty."""
    n = F.col("norm")
    return _normalised(docs, id_col, text_col).select(
        "doc_id", "chars", hash_of(n).cast("long").alias("hash"), F.sha2(n, 256).alias("digest"), F.octet_length(n).alias("bytes")
    )


def compare_bytes(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = F.xxhash64) -> None:
    """Compare the normalised bytes of all rows that share an entry; an error if two texts differ.

    Equal texts fold inside each task before the shuffle, so a group of copies arrives as a few rows.
    """
    several = index.filter("group_size > 1").select("hash").distinct()
    n = F.col("norm")
    texts = _normalised(docs, id_col, text_col).select(hash_of(n).cast("long").alias("hash"), "norm")
    texts = texts.join(several, "hash", "left_semi").groupBy("hash", "norm").count()
    twice = texts.groupBy("hash", F.sha2(n, 256).alias("digest")).count().filter("count > 1")
    if twice.limit(1).count():
        raise InputError("two different texts have one digest")


def entries(keys: DataFrame) -> DataFrame:
    """One entry per distinct text: members and the id that stays (most code points, then smallest id; null ids last)."""
    order = F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    return keys.groupBy("hash", "digest", "bytes").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(order).getField("doc_id").alias("keep_id"),
    )


def _slot() -> Column:
    """The leading bits of the hash, as a number."""
    return F.shiftrightunsigned(F.col("hash"), 64 - DEEPEST)


def directory(index: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(slot, depth, bucket, chained): for every slot of the deepest level in use, its bucket and whether that is still overfull."""
    slots = index.groupBy(_slot().alias("slot")).count()
    up = slots.select("slot", "count", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("depth"))
    up = up.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {DEEPEST} - depth)"))
    filled = up.groupBy("depth", "prefix").agg(F.sum("count").alias("n"))
    fits = (F.col("n") <= capacity) | (F.col("depth") == DEEPEST)
    leaf = up.join(filled, ["depth", "prefix"]).filter(fits).groupBy("slot").agg(
        F.min(F.struct("depth", "prefix", (F.col("n") > capacity).alias("chained"))).alias("b")
    )
    return leaf.select("slot", F.col("b.depth").alias("depth"), F.concat_ws(":", "b.depth", "b.prefix").alias("bucket"), F.col("b.chained").alias("chained"))


def build_index(keys: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Write the index to a folder that all executors share and read it back."""
    spark = keys.sparkSession
    found = materialise(entries(keys))
    placed = found.withColumn("slot", _slot()).join(directory(found, capacity), "slot").drop("slot")
    chain = W.partitionBy("bucket", "hash").orderBy("digest", "bytes")  # entries of one hash: nearly always one
    path = path or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    owned = placed.repartitionByRange("bucket", "hash").withColumn("link", F.row_number().over(chain))
    owned.sortWithinPartitions("bucket", "hash", "link").write.parquet(path)
    return spark.read.parquet(path)


def dedup(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, link for every row of `docs`.

    Of equal texts the row with the most code points stays, then the smallest id; rows alike in both (repeated rows) are all marked
    kept. Null ids come last and count as ids of their own. Other columns of `docs` do not take part. No row is dropped.
    """
    keys = materialise(text_keys(docs, id_col, text_col, hash_of))
    index = build_index(keys, capacity)
    compare_bytes(docs, index, id_col, text_col, hash_of)
    best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    found = keys.join(index.select("hash", "digest", "bytes", "keep_id", "group_size", "link"), ["hash", "digest", "bytes"])
    return found.select("doc_id", "keep_id", "group_size", best.alias("kept"), F.col("digest").alias("text_sha256"), F.col("link").alias("chain_link"))


ORACLE = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, chars, sha256(norm) AS text_sha256 FROM n
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM k
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, 1 AS chain_link FROM g
"""
