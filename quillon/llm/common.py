"""Helpers shared by the corpus operators: scratch tables, skew-safe lookups, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as white space between words, as a character class body.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows of a lookup table that may be broadcast; larger ones go through a shuffle.
BROADCAST_ROWS = 100_000
#: Whether the shuffle files of a write go as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """The folder shared by the cluster. Where none is configured, local mode gets a temporary one; a cluster must have one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    Its shuffle files go as soon as it is written; else those of every round would stay until the driver happens to
    collect its garbage, many small ones where partitions are many.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or ["*"])


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, table: DataFrame, on: Column, n: int) -> DataFrame:
    """Left join to a table of n rows: broadcast while n is small, else a merge join that AQE can split."""
    return rows.join(F.broadcast(table) if n <= BROADCAST_ROWS else table.hint("merge"), on, "left")


def with_prefix(rows: DataFrame, order: list[Column], size: Column, name: str) -> DataFrame:
    """Add `_before` (sum of size over all earlier rows), `_index` (0-based place) and `_total`, in the given order.

    Rows are range-partitioned and written once, so that the partition of a row cannot change; totals per
    partition are summed into offsets (as many rows as partitions), and only those are broadcast.
    Rows that are equal in every order column should be interchangeable.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    dealt = rows.withColumn("_size", size).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, name)
    inside = Window.partitionBy("_part").orderBy(*order)
    dealt = dealt.withColumn("_in", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).withColumn("_row", F.row_number().over(inside) - 1)
    totals = dealt.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_base"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base_rows"),
        F.sum("_bytes").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    out = lookup(dealt, totals, F.col("_part") == F.col("_p"), n)
    return out.withColumn("_before", F.col("_base") + F.col("_in")).withColumn("_index", F.col("_base_rows") + F.col("_row")).drop("_part", "_p", "_base", "_base_rows", "_in", "_row")
