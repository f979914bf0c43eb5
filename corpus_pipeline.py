"""Corpus pipeline: language ID, exact dedup, near-duplicates, mixing, packing.

Stages take documents (doc_id, text, lang, source, and any other columns under any names) and, but for the last, return
rows of the same columns. A null in any column is a value like others: texts count as empty, sources form one of their
own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, dedup, language, mixing, packing, similar

#: Least score of a language verdict; below it a document is rejected.
LEAST_SCORE = 0.5

#: SQL cannot express hashed naive Bayes; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def _key(doc_id: str, digest: Column) -> Column:
    """What tells a row from others: its doc_id, or that it has none, and the digest of its folded text."""
    return F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("none")), digest)


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of docs for each of the keys (distinct, not null): of rows with one key the first by text, then by its other columns.

    Rows of one key meet in the task that reads them before any travels, so repeated rows move once per task at most,
    and texts travel once. No column of docs can clash.
    """
    digest = F.sha2(dedup.normalized(F.col("text")), 256)
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"`{x}`") for x in docs.columns if x != "text"]))
    order = F.struct(F.sha2("text", 256).alias("text"), rest.alias("rest"))
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_doc"), _key("doc_id", digest).alias("_key"), order.alias("_order"))
    found = rows.groupBy("_key").agg(F.min_by("_doc", "_order").alias("_doc"))
    return found.join(keys.hint("merge"), "_key").select("_doc.*")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, or with no verdict above LEAST_SCORE, go.

    Repeated rows are judged alike. Where no row has a lang to learn from, no verdict is possible and every row stays.
    """
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    if not model.names:
        return docs
    # names of their own for the time being, so that none can clash
    names = {x: f"_{i}" for i, x in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{x}`").alias(y) for x, y in names.items()])
    scored = language.predict(rows, model, tuple(names.values()), names["text"])
    return scored.where(F.col("score") >= LEAST_SCORE).select(*[F.col(y).alias(x) for x, y in names.items()])  # that of `und` is 0


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of several with that doc_id the first in the order of _only. Rows without a doc_id lose to others."""
    kept = dedup.exact_dedup(docs).where("kept").select(_key("doc_id", F.col("text_sha256")).alias("_key"))
    return _only(docs, kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays: one with the component's smallest doc_id, if any has a doc_id.

    Candidates are found by operator 9's method, SimHash fingerprints linked through Golay keys, and by MinHash keys where
    fingerprints differ in more than three bits; documents link at a Jaccard similarity of 0.8 of their five-word
    shingles, verified on the whole sets. Rows without
    a doc_id, or with the same one, are judged each by its own text; of repeated rows one stays.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), _key("doc_id", F.sha2(dedup.normalized(F.col("text")), 256)).alias("_key"), "text")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("first")
    return _only(docs, similar.parts(rows, "_id", "_key").groupBy("part").agg(first).select("first._key"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice, each row by a draw of its own."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; every row is packed for itself, copies too."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
