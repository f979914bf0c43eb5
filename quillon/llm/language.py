"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillon.llm.encoding import chunks

BITS = 16
#: Training rows in all, by expectation: every label gets the same share, a rarer one all its rows.
TRAIN_ROWS = 20_000
#: Rows of one label, at least, by expectation, if it has as many.
LEAST_ROWS = 32
#: Labels whose log-probabilities are held as a full matrix, for speed; those of more labels are held sparsely.
DENSE = 64
#: Added to every count, so that no n-gram is impossible.
SMOOTH = 0.1
#: N-grams after which further evidence no longer sharpens the score.
SHARP = 64
UNKNOWN = "und"


class Model(NamedTuple):
    """Labels, their log priors, the log-probability of a bucket that a label was not seen with, and by how much more
    likely the seen ones are: `more[starts[b]:starts[b + 1]]` for the labels at the same places of `at`."""

    names: list[str]
    prior: np.ndarray
    unseen: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    more: np.ndarray

    def dense(self) -> np.ndarray:
        table = np.tile(self.unseen.astype(np.float32), (1 << BITS, 1))
        table[np.repeat(np.arange(1 << BITS), np.diff(self.starts)), self.at] += self.more
        return table


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(text: str) -> np.ndarray:
    """Buckets of all 2-grams and 3-grams of a whole text, lower-cased, with a blank before and after."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    return np.concatenate([two, three]) >> np.uint32(32 - BITS)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of docs (doc_id, text, lang). Rows without text or lang teach nothing, nor does the label `und`.

    Labels are counted on all rows (the priors); n-grams on a sample of rows, chosen by a hash of doc_id and text, of
    rows / labels (LEAST_ROWS at least) for each label, so that a rare one is learned from all it has. At most `rows`
    labels are learned, the most frequent ones: with more, the sample would not be bounded.
    """
    known = docs.where(f"text is not null and lang is not null and lang <> '{UNKNOWN}'").select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    total = {r["lang"]: r["count"] for r in counts}
    share = max(LEAST_ROWS, rows // max(1, len(total)))
    chances = docs.sparkSession.createDataFrame([(x, min(1.0, share / n)) for x, n in total.items()], "_lang string, _chance double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(chances), F.col("lang") == F.col("_lang")).where(draw < F.col("_chance")).select("text", "lang")  # at most `rows` labels

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in chunks(batch):
                found: dict[str, list[np.ndarray]] = {}
                for k, text in enumerate(texts):
                    found.setdefault(langs[at + k], []).append(grams(text))
                for lang, own in found.items():
                    bucket, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n)), "bucket": bucket.astype(np.int32), "n": n.astype(np.int64)})

    # at most as many rows as the sample has n-grams, and as labels x buckets
    summed = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(summed["lang"].unique())  # labels without n-grams in the sample are not learned
    label = np.searchsorted(np.array(names, object), summed["lang"].to_numpy(object)) if names else np.zeros(0, np.int64)
    bucket, n = summed["bucket"].to_numpy(np.int64), summed["n"].to_numpy(np.float64)
    order = np.lexsort((label, bucket))
    label, bucket, n = label[order], bucket[order], n[order]
    all_ = np.log(np.bincount(label, n, minlength=len(names)) + SMOOTH * (1 << BITS))
    prior = np.array([total[x] for x in names], float)
    starts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=1 << BITS))])
    return Model(names, np.log(prior / prior.sum()), np.log(SMOOTH) - all_, starts, label.astype(np.int32), np.log((n + SMOOTH) / SMOOTH).astype(np.float32))


def scorer(model: Model):  # noqa: ANN201
    """A function from the n-grams of a text to the log-likelihood of each label."""
    if len(model.names) <= DENSE:
        table = model.dense()
        return lambda at: sum(table[at[a : a + 65536]].sum(axis=0, dtype=np.float64) for a in range(0, len(at), 65536))

    def sparse(at: np.ndarray) -> np.ndarray:
        bucket, n = np.unique(at, return_counts=True)
        size = model.starts[bucket + 1] - model.starts[bucket]
        places = np.arange(size.sum()) + np.repeat(model.starts[bucket] - np.cumsum(size) + size, size)
        return len(at) * model.unseen + np.bincount(model.at[places], model.more[places] * np.repeat(n, size), minlength=len(model.names))

    return sparse


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns of docs with lang_pred and score of column `text`; `und` and 0 where it is null or has no letter.

    The score is the posterior of the label with evidence beyond SHARP n-grams averaged, so that it stays below 1 for
    mixed texts; of equal labels the first by code point wins. Whole texts are scored, in batches, against the
    broadcast model, whose size the training sample bounds.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, *[x for x in (text,) if x not in keep])
    fields = [f for f in kept.schema.fields if f.name in keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = sent.value
        likely = scorer(known)
        for batch in batches:
            labels: list[str] = []
            scores: list[float] = []
            for _, texts in chunks(batch, text):
                for one in texts:
                    if not known.names or not any(x.isalpha() for x in one):
                        labels.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    at = grams(one)
                    total = likely(at) + known.prior
                    best = int(total.argmax())
                    labels.append(known.names[best])
                    scores.append(float(1 / np.exp((total - total[best]) / max(1.0, len(at) / SHARP)).sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in keep], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return kept.mapInArrow(score, StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from rows that are not held out and have a lang. Null doc_id: not held out. With nothing to learn from,
    every row is `und`. Repeated rows are predicted alike; clashing column names in docs do not matter. No documents: an
    empty result.
    """
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, train(rows.where(~F.col("held_out"))), ("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")
