"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Deal all documents, in ascending doc_id order, into `shards` runs of near equal size.

    A row's size is the UTF-8 bytes of its text (null: none) plus 8. Its shard is where the middle of its bytes falls
    among equal cuts of the total, so a shard misses its target by less than one document. Law: `bytes`.
    Groups do not matter to this law: copies are dealt like other rows. Null doc_ids come first; equal ones keep every
    row, ordered by size and checksum (rows equal in all three can stand for each other). text_crc32 of null is 0.
    No documents: an empty result. Other columns are ignored.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = common.with_prefix(rows, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], F.col("size"), "shard-sizes")
    # in decimals, whose integer division is exact: the product of a corpus' bytes and the shard count may pass 2^63
    cut = F.expr(f"cast(2 * _before + size as decimal(38,0)) * {int(shards)} div cast(2 * _total as decimal(38,0))")
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1).cast("long"), cut).cast("int"))
    rows = common.materialize(rows, "shards")
    firsts = rows.groupBy("shard").agg(F.min("_index").alias("_first")).withColumnRenamed("shard", "_s")  # `shards` rows
    out = rows.join(F.broadcast(firsts), F.col("shard") == F.col("_s"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_index") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
