"""Importance resampling towards a target distribution: hashed features, Gumbel scores, ranks by a distributed radix sort."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import common

BUCKETS = 10_000
#: Most consecutive words of a feature.
RUN = 1
SEED = "2024"
#: Fewest words of a document that may be drawn, and the percentage drawn.
LEAST_WORDS, PERCENT = 20, 10
#: Bits of a digit; a pass counts 2^DIGIT of them.
DIGIT = 12
#: Rows of a block after a pass, at most.
BLOCK_ROWS = 2_000_000
#: Words kept by one worker, and bytes of a text that are split into words at once.
WORDS, PIECE = 500_000, 1 << 20

# Words are runs of 0-9, a-z (upper case folded) and whatever is not ASCII, whose UTF-8 bytes are 128 and above.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in (ord(chr(b).lower()) if b < 128 else b for b in range(256)))


class _Known(dict):
    """Words to what a function makes of them; emptied when full."""

    def __init__(self, make: Callable[[bytes], int]) -> None:
        self.make = make

    def __missing__(self, word: bytes) -> int:
        found = self.make(word)
        if len(self) >= WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def features(text: bytes | None, run: int = RUN) -> Iterator[list[bytes]]:
    """All features of a whole text in lists of bounded size; null: none."""
    folded, at, before = (text or b"").translate(_FOLD), 0, []
    while at < len(folded):
        end = len(folded) if len(folded) - at <= PIECE else folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        words, at = folded[at:end].split(), end
        yield words
        if run > 1:
            joined, old = before + words, len(before)
            for n in range(2, run + 1):
                yield [b" ".join(joined[i - n : i]) for i in range(max(n, old + 1), len(joined) + 1)]
            before = joined[1 - run :]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    for value in batch.column("text").cast(pa.large_binary()):
        yield value.as_py()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket, summed per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, bucket = np.zeros(buckets, np.int64), _Known(lambda w: zlib.crc32(w) % buckets)
        for batch in batches:
            for text in _texts(batch):
                for some in features(text, run):
                    for word, n in Counter(some).items():
                        sums[bucket[word]] += n
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> list[int]:
    """The gain of each bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))); `buckets` numbers come to the driver."""

    def counts(texts: DataFrame) -> list[int]:
        found = {r["bucket"]: r["n"] for r in bucket_counts(texts, buckets, run).collect()}
        return [found.get(i, 0) for i in range(buckets)]

    source, wanted = counts(docs), counts(target)
    all_source, all_wanted = sum(source), sum(wanted)
    ratio = lambda s, t: float(t + 1) * float(all_source + buckets) / (float(s + 1) * float(all_wanted + buckets))
    return [math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source, wanted, strict=True)]


def gumbel(doc_id: int | None, seed: str = SEED) -> int:
    """The noise of a document: floor(-1000 ln(-ln u)), u from the hash of seed and doc_id (null: the word null)."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: list[int], run: int = RUN, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = _Known(lambda w: gains[zlib.crc32(w) % len(gains)])
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, _texts(batch), strict=True):
                n_words = n = total = 0
                for i, some in enumerate(features(text, run)):
                    n_words += len(some) if i % run == 0 else 0
                    n += len(some)
                    total += sum(map(gain.__getitem__, some))
                weight = total // n if n else 0
                out.append((n_words, n, weight, weight + gumbel(doc_id, seed)))
            columns = [pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], [], []))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def radix_rank(rows: DataFrame, keys: list[tuple[str, bool]], digit: int = DIGIT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `_pos`, the 0-based place of each row in the order of long columns `keys` (name, descending), most significant first.

    Least significant digit first: the keys' bits that vary are laid side by side and cut into digits. A pass counts
    each digit in each block of rows; prefix sums over (digit, block) give where the first row of a cell goes, and a
    row's place among its cell's, in the order of the pass before, the rest. Rows move to the blocks of their new
    places, all equally large, so that ties and hot keys weigh on no task; each pass is a written table. Nulls come
    last. Rows equal in all keys are in any order. No rows: an empty result.
    """
    high = F.lit(-(2**63))
    parts = {}
    for name, down in reversed(keys):
        value = F.coalesce(F.col(name), F.lit(0)).bitwiseXOR(high)  # as unsigned
        parts[f"_v_{name}"] = F.bitwise_not(value) if down else value
        parts[f"_n_{name}"] = F.col(name).isNull().cast("long")
    names = [x for x in rows.columns]
    rows = common.materialize(rows.withColumns({"_part": F.spark_partition_id().cast("long"), "_pos": F.monotonically_increasing_id()}), "radix-0")
    bounds = rows.select(F.count(F.lit(1)).alias("n"), *[f(v).alias(f"{f.__name__}{x}") for x, v in parts.items() for f in (F.min, F.max)]).first()
    if not bounds["n"]:
        return rows.select(*names, "_pos")
    fields, bits = [], 0  # (value, first bit, bits)
    for x, v in parts.items():
        wide = ((bounds[f"min{x}"] ^ bounds[f"max{x}"]) & (2**64 - 1)).bit_length()
        fields, bits = [*fields, (v, bits, wide)], bits + wide
    blocks = max(common.partitions(rows.sparkSession), -(-bounds["n"] // block_rows))
    size = -(-bounds["n"] // blocks)

    def cut(low: int) -> Column:
        found = F.lit(0).cast("long")
        for v, at, wide in fields:
            first, last = max(low, at), min(low + digit, at + wide)
            if first < last:
                taken = F.shiftrightunsigned(v, first - at).bitwiseAND(F.lit((1 << (last - first)) - 1))
                found = found.bitwiseOR(F.shiftleft(taken, first - low))
        return found

    for low in range(0, max(bits, 1), digit):
        dealt = rows.withColumn("_digit", cut(low))
        cells = dealt.groupBy("_part", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # at most 2^digit rows in one window
        bases = cells.groupBy("_digit").agg(F.sum("_n").alias("_n")).select(F.col("_digit").alias("_d"), before(Window.orderBy("_digit")).alias("_base"))
        cells = cells.withColumn("_earlier", before(Window.partitionBy("_digit").orderBy("_part")) - before(Window.partitionBy("_part").orderBy("_digit")))
        cells = cells.join(F.broadcast(bases), F.col("_digit") == F.col("_d")).select("_part", "_digit", (F.col("_base") + F.col("_earlier")).alias("_shift"))
        # a cell's shift goes before its rows, so that no join is needed
        both = dealt.withColumn("_row", F.lit(1)).unionByName(cells.withColumn("_row", F.lit(0)), allowMissingColumns=True)
        w = Window.partitionBy("_part").orderBy("_digit", "_row", "_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = both.withColumn("_to", F.last("_shift", ignorenulls=True).over(w) + F.sum("_row").over(w) - 1).where("_row = 1")
        rows = placed.select(*names, F.expr(f"_to div {size}").alias("_part"), F.col("_to").alias("_pos"))
        rows = common.materialize(rows, f"radix-{low // digit + 1}")
    return rows.select(*names, "_pos")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (1 for the best of those drawn; null: not drawn).

    A document's weight is the floored mean of the gains of its features, its score the weight plus Gumbel noise; of
    the N documents with at least `least_words` words, floor(percent * N / 100) with the highest scores are drawn,
    which samples without replacement in proportion to the importance weights. Ties go to the smaller doc_id, then to
    fewer features; rows without a doc_id come last and share one noise, as do rows with one doc_id. Null and empty
    texts have no features and weight 0. Other columns are ignored. An empty target makes every gain that of an unseen
    feature. No documents: an empty result.
    """
    found = common.materialize(scores(docs, bucket_gains(docs, target, buckets, run), run, seed), "scores")
    enough = found.where(F.col("n_words") >= least_words).drop("n_words")
    ranked = radix_rank(enough, [("score", True), ("doc_id", False), ("n_features", False)])
    drawn = percent * ranked.count() // 100
    rank = F.when(F.col("_pos") < drawn, F.col("_pos") + 1)
    rest = found.where(F.col("n_words") < least_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).drop("_pos").unionByName(rest)
