"""Exact deduplication by a tree of merges over digest runs; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import common

#: Runs merged into one in each round, as a power of two.
FAN_IN_BITS = 3


def normalized(text: Column) -> Column:
    """Texts are equal when identical after lower-casing A-Z only; null counts as empty."""
    return common.fold_case(F.coalesce(text, F.lit("")))


def exact_dedup(docs: DataFrame, runs: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Documents are dealt into `runs` runs by a hash of the row. A run holds one entry per digest: the row that would
    stay and the count. In each round, groups of eight runs merge: entries of one digest meet, verified by a second
    hash and the length of the text, and keep the largest identifier. The last round leaves one run, which is spread
    over the cluster by digest. The verdicts then go back down to the first runs, so the documents of one digest, even
    a third of the corpus, are looked up in `runs` separate places and never gathered.

    Of equal texts the row with the largest doc_id stays. Null doc_ids lose to any other; among repeated rows with one
    doc_id exactly one stays. Null text equals empty text. Other columns are ignored. No documents: an empty result.
    """
    text = normalized(F.col("text"))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.xxhash64("text").alias("second"),
        F.octet_length("text").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    # written once: row numbers and digests stay as they are if executors are lost later
    rows = common.materialize(rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "row"), F.lit(runs)).cast("int")), "digests")
    key = ["run", "digest", "second", "bytes"]
    best = F.max(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("at"), "doc_id", "row"))
    level = rows.groupBy(*key).agg(best.alias("keep"), F.count(F.lit(1)).alias("n"))
    level = common.materialize(level.sortWithinPartitions("run", "digest"), "run-0")
    levels, left = [level], runs
    while left > 1:
        left = ((left - 1) >> FAN_IN_BITS) + 1
        merged = level.withColumn("run", F.shiftright("run", FAN_IN_BITS)).groupBy(*key).agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
        level = merged if left == 1 else common.materialize(merged.sortWithinPartitions("run", "digest"), f"run-{len(levels)}")
        levels.append(level)
    found = levels.pop()
    while levels:
        lower = levels.pop()
        up = found.select(F.col("run").alias("up"), *key[1:], "keep", "n")
        found = lower.drop("keep", "n").withColumn("up", F.shiftright("run", FAN_IN_BITS)).join(up.hint("merge"), ["up", *key[1:]]).drop("up")
    out = rows.join(found.hint("merge"), key)
    return out.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("keep.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )
