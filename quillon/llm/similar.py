"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles: Golay keys, blocks, verified links, components.

Candidates are the texts whose fingerprints Golay keys link at three bits, as in simhash; pairs of a similarity that
three bits cannot reach come from MinHash keys besides. Texts that share a key are joined into blocks; the sets of a block travel to one task together, once, and are compared
there with an inverted list. No pair leaves a task: it emits the links of its members to the smallest one of their part.
A block beyond BLOCK_TEXTS or BLOCK_SHINGLES is dealt into chunks, and every two chunks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quillon.llm import common, dedup, simhash
from quillon.llm.encoding import chunks

WORDS = 5
SIMILARITY = 0.8
#: Keys of a text, and minima in a key: a pair at 0.8 shares a key with a chance of 1 - (1 - 0.8^5)^24 = 0.99993.
BANDS, ROWS = 24, 5
#: Texts and shingles of one chunk of a block, about; a task holds two chunks at most.
BLOCK_TEXTS, BLOCK_SHINGLES = 2_000, 1_000_000
_draw = np.random.default_rng(simhash.SEED)
_FACTORS = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text; no words: none."""
    return np.unique(np.array(simhash.shingle_hashes(text, words), np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One signed key per band from the minima of its hash functions."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(found), 4096):
        least = np.minimum(least, (found[k : k + 4096, None] * _FACTORS + _SHIFTS).min(axis=0))
    line = least.astype("<u8").tobytes()
    return np.array([xxhash.xxh64_intdigest(line[8 * ROWS * b : 8 * ROWS * (b + 1)], b) for b in range(BANDS)], np.uint64).view(np.int64)


def alike_parts(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For every set the smallest index among those it is joined to by pairs of this Jaccard similarity.

    Row by row, an inverted list gives the sizes of all intersections. Two empty sets are alike.
    """
    size = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets), dtype=np.int32), size)
    order = np.argsort(flat, kind="stable")
    held, flat = owner[order], flat[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(flat)), bool), flat[1:] != flat[:-1]]))
    many = np.diff(np.append(first, len(flat)))
    code = np.empty(len(flat), np.int64)
    code[order] = np.repeat(np.arange(len(first)), many)
    ends = np.concatenate([[0], np.cumsum(size)])
    part = np.arange(len(sets))
    for i in range(len(sets)):
        own = code[ends[i] : ends[i + 1]]
        n = many[own]
        places = np.arange(n.sum()) + np.repeat(first[own] - np.cumsum(n) + n, n)
        both = np.bincount(held[places], minlength=len(sets))
        met = np.unique(part[both >= similarity * (size + size[i] - both)])
        if len(met) > 1:
            part[np.isin(part, met)] = met[0]
    return part


def _node(text: Column) -> Column:
    """128 bits of a folded text's digest: the text's node in the graph."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _signatures(docs: DataFrame, keep: tuple[str, ...], words: int) -> DataFrame:
    """The kept columns, node, the MinHash keys of the text, the number of its distinct shingles and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch):
                hashes = [simhash.shingle_hashes(x, words) for x in part]
                fps = pa.array(np.array([simhash.majority(x) for x in hashes], np.uint64).view(np.int64))
                found = [np.unique(np.array(x, np.uint64)) for x in hashes]
                del hashes
                keys = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([band_keys(x) for x in found])), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(x).slice(at, len(part)) for x in (*keep, "_node")], keys, pa.array([len(x) for x in found], pa.int32()), fps], names=[*keep, "_node", "_keys", "_size", "_fp"])

    rows = docs.select(*keep, "_node", "text")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("_keys", ArrayType(LongType())), StructField("_size", IntegerType()), StructField("_fp", LongType())]))


def _golay_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of texts that connect what links of their fingerprints within three bits connect; the smallest text of a fingerprint stands for it."""
    fps = common.materialize(nodes.groupBy("_fp").agg(F.min("_node").alias("_least")), "distinct-fingerprints")
    links = simhash.golay_links(fps.select(F.col("_fp").alias("fp")))
    for end in ("a", "b"):
        links = links.join(fps.hint("merge"), F.col(end) == F.col("_fp")).withColumn(end, F.col("_least")).drop("_fp", "_least")
    return links


def _sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch):
                found = pa.array([shingles(text, words).astype("<u8").tobytes() for text in part], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_node").slice(at, len(found)), found], names=["_node", "found"])

    return texts.select("_node", "text").mapInArrow(run, "_node binary, found binary")


def _links(grouped: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of each member of a group (g, _node, found) to the smallest member of its part; rows come sorted by g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, sets = None, [], []

        def close() -> pa.RecordBatch:
            part = alike_parts(sets, similarity)
            at = np.flatnonzero(part != np.arange(len(part))).tolist()
            return pa.RecordBatch.from_arrays([pa.array([nodes[part[i]] for i in at], pa.binary()), pa.array([nodes[i] for i in at], pa.binary())], names=["a", "b"])

        for batch in batches:
            names, found = batch.column("_node").to_pylist(), batch.column("found")
            for i, g in enumerate(batch.column("g").to_pylist()):
                if g != held:
                    if len(nodes) > 1:
                        yield close()
                    held, nodes, sets = g, [], []
                nodes.append(names[i])
                # a copy: a view would hold the whole batch
                sets.append(np.frombuffer(found[i].as_buffer(), "<u8").copy())
            del found, names
            pa.default_memory_pool().release_unused()
        if len(nodes) > 1:
            yield close()

    return grouped.mapInArrow(run, "a binary, b binary")


def parts(docs: DataFrame, *keep: str, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: the kept columns and part, which rows of one component share.

    docs has the kept columns (none named part, text, _node, _keys, _size or _fp) and text. Texts (A-Z folded, null as
    empty) link when their sets of word shingles have this Jaccard similarity; texts of fewer words have one shingle, and
    texts without words link to each other. Candidates lie in one component of SimHash fingerprints (of these shingles)
    or share a MinHash key; every link is verified on the whole sets. Copies of a text are one node. No documents: an
    empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(*keep, dedup.normalized(F.col("text")).alias("text")).withColumn("_node", _node(F.col("text")))
    rows = common.materialize(_signatures(texts, keep, words), "signatures")
    nodes = common.materialize(rows.groupBy("_node").agg(F.first("_keys").alias("_keys"), F.first("_size").alias("_size"), F.first("_fp").alias("_fp")), "nodes")
    keys = nodes.select(F.explode(F.concat("_keys", F.array(F.xxhash64(F.lit("golay"), "_fp")))).alias("u"), "_node")
    shared = keys.groupBy("u").agg(F.min("_node").alias("a"), F.max("_node").alias("most")).where("a < most").select("u", "a")
    candidates = keys.join(shared.hint("merge"), "u").where("a < _node").select("a", F.col("_node").alias("b"))
    blocks = simhash.components(candidates.union(_golay_links(nodes))).withColumnRenamed("node", "_node")
    blocks = common.materialize(blocks.join(nodes.select("_node", "_size").hint("merge"), "_node"), "blocks")

    # chunks of a block, and the groups of two chunks in which a text is compared
    needs = blocks.groupBy("component").agg(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("_size") / BLOCK_SHINGLES).alias("n"))
    needs = common.materialize(needs.where("n > 1").select(F.col("component").alias("_large"), F.ceil("n").cast("int").alias("n")), "large-blocks")
    dealt = common.lookup(blocks, needs, F.col("component") == F.col("_large"), needs.count()).withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("_node"), F.col("n")))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("n") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1))))
    pair = F.when(F.col("n") <= 2, F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))).otherwise(F.struct(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))
    # two groups of one hash are compared as one, which costs time only
    groups = common.materialize(dealt.select("_node", F.xxhash64("component", pair).alias("g")).distinct(), "groups")

    busy = blocks.select(F.col("_node").alias("_busy"))
    table = F.broadcast(busy) if blocks.count() <= common.BROADCAST_ROWS else busy.hint("merge")
    needed = texts.select("_node", "text").join(table, F.col("_node") == F.col("_busy"), "left_semi").dropDuplicates(["_node"])
    sets = common.materialize(_sets(needed, words), "sets")
    met = groups.join(sets.hint("merge"), "_node").repartition(common.partitions(spark), "g").sortWithinPartitions("g")
    links = common.materialize(_links(met.select("g", "_node", "found"), similarity), "links")

    found = simhash.components(links)
    out = rows.join(found.hint("merge"), F.col("_node") == F.col("node"), "left")
    return out.select(*keep, F.coalesce("component", "_node").alias("part"))
