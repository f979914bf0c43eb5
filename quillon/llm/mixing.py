"""Mixing sources to target weights by repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    # a word starts where a character that is no space follows a space or the beginning
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{common.SPACE}]++")), F.lit(0)).cast("long")


def unit(*columns: Column) -> Column:
    """A number in [0, 1) from the md5 of the columns' text; any SQL engine can compute the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 13), 16, 10).cast("double") / float(16**13)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Give each (source, source_size) its target.

    Sources in code point order, null last, take the weights in turn and share `share` of all sizes; targets stop at
    `most` times the source's size and the excess is shared again by weight, until none is above. That is one level for
    all: a source is full if the level passes `most` times its size over its weight. In the order of that quotient, the
    full ones come first, so that prefix sums give the level that each place would have; the first place that bears its
    own level has the right one. Sources are ordered across partitions, not in one task; one number reaches the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    rows = sources.select("source", "source_size", order[0].alias("_null"))
    rows = common.with_prefix(rows, [F.col("_null"), F.col("source")], F.lit(1).cast("long"), "sources")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_index") % len(weights) + 1).cast("int"))
    rows = rows.select("source", F.col("source_size").cast("long").alias("source_size"), F.col("_null"), weight.alias("weight"))
    rows = rows.withColumn("stop", most * F.col("source_size") / F.col("weight"))
    place = [F.col("stop"), F.col("_null"), F.col("source")]
    # twice in one order: sums of sizes and of weights before each source
    heavy = common.with_prefix(rows, place, F.col("weight"), "source-weights").withColumnsRenamed({"_before": "lighter", "_total": "weights"}).drop("_size", "_index")
    heavy = common.with_prefix(heavy, place, F.col("source_size"), "source-levels")
    level = (share * F.col("_total") - most * F.col("_before")) / (F.col("weights") - F.col("lighter"))
    first = heavy.where(level <= F.col("stop")).agg(F.min_by(level, F.struct("stop", "_null", "source"))).first()[0]
    least = most * F.col("source_size").cast("double")
    return heavy.select("source", "source_size", (F.least(F.col("weight") * F.lit(first), least) if first is not None else least).alias("target"))


def numbered(docs: DataFrame) -> DataFrame:
    """Add `_k`, the number from 0 of each row among those with its doc_id, source and `_digest` of the text.

    Such rows can stand for each other. Only rows of classes that hold several are moved: they are put in one order over
    all partitions, so that a class of a third of all rows is numbered in many tasks.
    """
    key = ["doc_id", "source", "_digest"]
    alike = docs.groupBy(*key).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    alike = common.materialize(alike, "repeated").withColumnsRenamed({x: f"_r{x}" for x in key})
    if alike.isEmpty():
        return docs.withColumn("_k", F.lit(0).cast("long"))
    same = lambda prefix: F.col("doc_id").eqNullSafe(F.col(f"{prefix}doc_id")) & F.col("source").eqNullSafe(F.col(f"{prefix}source")) & (F.col("_digest") == F.col(f"{prefix}_digest"))
    met = docs.join(alike.hint("merge"), same("_r"), "left").drop(*[f"_r{x}" for x in key])
    many = met.where("_m is not null").withColumn("_at", F.monotonically_increasing_id())
    many = common.with_prefix(many, [F.col("_digest"), F.col("doc_id"), F.col("source"), F.col("_at")], F.lit(1).cast("long"), "repeats")
    first = many.groupBy(*[F.col(x).alias(f"_f{x}") for x in key]).agg(F.min("_index").alias("_first"))
    placed = many.join(first.hint("merge"), same("_f")).withColumn("_k", F.col("_index") - F.col("_first"))
    names = [F.col(f"`{x}`") for x in docs.columns]
    return placed.select(*names, "_k").unionByName(met.where("_m is null").select(*names, F.lit(0).cast("long").alias("_k")))


def mix(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """Add size, source_size, target and copies to every row of docs (columns doc_id, size, source, _digest).

    A document is taken floor(rate) times, and once more if a number from the hash of the seed, its doc_id, the digest
    of its text and its number among equal rows is below the rest of the rate, where rate = target / source_size. So
    rows without a doc_id, with the same one, or repeated draw each for themselves, and a source comes near its target
    whatever its ids. Reruns agree. Null source: a source of its own, the last. A source of size 0 has rate 0. No
    documents: an empty result.
    """
    sources = common.materialize(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    n = sources.count()
    found = targets(sources, **kw).select(F.col("source").alias("_s"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = common.lookup(numbered(docs), found, F.col("source").eqNullSafe(F.col("_s")), n)
    chance = unit(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_digest"), F.col("_k").cast("string"))
    return out.withColumn("copies", (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")).drop("_s", "_k")


def _sized(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(*columns, "doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_digest"))


def mixed_sizes(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized = common.materialize(_sized(docs), "sizes")
    return mix(sized, **kw).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with its own columns, whatever their names.

    Null text: size 0, and taken like other documents of its source. Rows with one doc_id, or none, and repeated rows
    are taken each by a draw of its own, so they do not move a source off its target. Empty tables: as in mix().
    """
    whole = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_doc")
    taken = mix(_sized(docs, whole), **kw).withColumn("_copy", F.explode(F.expr("array_repeat(0, copies)")))
    return taken.select("_doc.*")
