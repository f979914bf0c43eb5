"""Near-duplicates by SimHash: fingerprints, Golay-code keys, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillon.llm import common, golay
from quillon.llm.encoding import chunks

WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints with one key that are compared with each other directly; larger groups go the other exact way.
DIRECT = 2048
#: Parts of a node's edges in a round of contraction.
SALTS = 64
LINKS = "a long, b long, hot boolean"
_FOLD = str.maketrans(common.UPPER, common.LOWER)
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """64-bit hashes of the word shingles of a whole text, repeats included; a text of fewer words is one shingle."""
    # bytes of UTF-8 characters beyond ASCII are never white space or A-Z, so both can be handled as bytes
    joined = text.encode().translate(_SPACES).lower().split(b" ")
    found = [x for x in joined if x]
    if not found:
        return []
    line = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(x) + 1 for x in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a whole text, repeats included; no words: 0."""
    return majority(shingle_hashes(text, words))


def majority(hashes: list[int]) -> int:
    """The bits set in over half of the hashes, repeats included; none: 0."""
    if not hashes:
        return 0
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    digits = np.array(hashes, "<u8").view(np.uint8).reshape(n, 8)
    for k in range(0, n, 16384):
        ones += np.unpackbits(digits[k : k + 16384], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the kept columns and fingerprint (as a signed long) of every row; null text: no words."""
    kept = docs.select("doc_id", *keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x) for _, texts in chunks(batch) for x in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("doc_id", *keep)], pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", *keep, "fp"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], StructField("fp", LongType())]))


def key_rows(fps: DataFrame) -> DataFrame:
    """Keys (key, fp, node) of distinct fingerprints.

    Of four 16-bit segments, three errors leave one without any; the other 48 bits are two halves, of which one has at
    most one error. A key is the exact segment, the half, and the index of a Golay codeword near the first 23 bits of
    the half: so two fingerprints within three bits share a key. 28 bits tell keys of one kind apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy()
            for segment in range(4):
                low = fp & np.uint64((1 << 16 * segment) - 1)
                rest = low | (fp >> np.uint64(16) & ~np.uint64((1 << 16 * segment) - 1))
                exact = fp >> np.uint64(16 * segment) & np.uint64(0xFFFF)
                for half in range(2):
                    row, index = golay.keys((rest >> np.uint64(24 * half) & np.uint64(0x7FFFFF)).astype(np.uint32))
                    key = np.uint64(segment * 2 + half) << np.uint64(28) | exact[row] << np.uint64(12) | index.astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row].view(np.int64)), pa.array(node[row])], names=["key", "fp", "node"])

    return fps.mapInArrow(run, "key long, fp long, node long")


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= RADIUS


def _stars(fp: np.ndarray, node: np.ndarray) -> list[tuple[int, int]]:
    """What pairs within RADIUS connect, as links of every node to the smallest of its part: flood fill, row by row."""
    open_ = np.ones(len(fp), bool)
    out = []
    for start in range(len(fp)):
        if not open_[start]:
            continue
        open_[start] = False
        part, stack = [start], [start]
        while stack:
            rest = np.flatnonzero(open_)
            found = rest[_near(fp[rest], fp[stack.pop()])]
            open_[found] = False
            stack += found.tolist()
            part += found.tolist()
        least = int(node[part].min())
        out += [(least, x) for x in node[part].tolist() if x != least]
    return out


def bucket_links(keys: DataFrame) -> DataFrame:
    """Links that connect what verified pairs inside groups of one key connect; members of groups above DIRECT are
    passed on as hot instead.

    Rows arrive sorted by key and stream through; no group is held beyond DIRECT rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])
        tail: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        passed = None  # the key whose members are being passed on

        def out(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), hot))], schema=schema)

        def groups(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            two = first[size == 2]
            two = two[_near(fp[two], fp[two + 1])]
            yield out(node[two], node[two + 1], False)
            links = [x for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True) if n <= DIRECT for x in _stars(fp[a : a + n], node[a : a + n])]
            yield out(np.array([x for x, _ in links], np.int64), np.array([x for _, x in links], np.int64), False)
            for a, n in zip(first[size > DIRECT].tolist(), size[size > DIRECT].tolist(), strict=True):
                yield out(fp[a : a + n].view(np.int64), node[a : a + n], True)

        for batch in batches:
            key, fp, node = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy()
            if tail is not None:
                key, fp, node = (np.concatenate(x) for x in zip(tail, (key, fp, node), strict=True))
            if passed is not None:
                n = int(np.searchsorted(key, passed, side="right"))
                yield out(fp[:n].view(np.int64), node[:n], True)
                key, fp, node = key[n:], fp[n:], node[n:]
            if not len(key):
                tail = None
                continue
            passed, last = None, int(np.searchsorted(key, key[-1], side="left"))
            if last:
                yield from groups(key[:last], fp[:last], node[:last])
            tail = key[last:], fp[last:], node[last:]
            if len(tail[0]) > DIRECT:
                passed = int(key[-1])
                yield out(tail[1].view(np.int64), tail[2], True)
                tail = None
        if tail is not None:
            yield from groups(*tail)

    n = common.partitions(keys.sparkSession)
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, LINKS)


def hot_links(fps: DataFrame) -> DataFrame:
    """Links among fingerprints of very large groups, in work that grows with their number, not its square.

    Two fingerprints are within three bits exactly if some word is within two bits of one and one bit of the other.
    Each fingerprint therefore emits its 2,081 words within two bits, and marks the 65 within one. A word has at most
    2,081 distinct fingerprints; if one of them is within one bit of it, all of them link to that one.
    """
    one = [1 << i for i in range(64)]
    masks = [0, *one, *(x | y for i, x in enumerate(one) for y in one[:i])]  # the first 65 flip one bit at most
    listed = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in masks])
    words = fps.select("node", "fp", F.posexplode(listed).alias("at", "mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("word"), "node", (F.col("at") <= 64).alias("one"))
    near = words.groupBy("word").agg(F.min(F.when(F.col("one"), F.col("node"))).alias("a"), F.collect_set("node").alias("all")).where("a is not null and size(all) > 1")
    return near.select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def _with_least(edges: DataFrame, value: str = "v") -> DataFrame:
    """Distinct edges (u, v) with m, the smallest value of u. A hub's edges lie in SALTS parts and never meet in one task.

    Edges travel once: parts, repeats and the join all use that one exchange by (u, salt); only a row of each part goes on.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).repartition("u", "salt")
    low = salted.groupBy("u", "salt").agg(F.min(value).alias("m")).withColumn("m", F.min("m").over(Window.partitionBy("u")))
    return salted.distinct().join(low.hint("merge"), ["u", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for every node with a link.

    Alternates two rounds of star contraction until all parts are stars; every round is written out. A round makes one
    edge of each edge at most; repeats go when their edges next travel.
    """
    edges = common.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _are_stars(edges):
        # large star: neighbours above a node go to its smallest neighbour or itself
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: neighbours below a node, and the node, go to the smallest of them
        small = _with_least(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = common.materialize(small, "edges")
    # by both columns: a join by node then deals the rows out itself, and can split a node that many rows have
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, repeats aside, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), "v", F.lit(0).alias("centre")).union(edges.select(F.col("v").alias("x"), F.lit(None).cast(edges.schema["v"].dataType).alias("v"), F.lit(1).alias("centre")))
    return ends.groupBy("x").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max("centre").alias("centre")).where("least < most or (least is not null and centre = 1)").isEmpty()


def golay_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect what pairs of distinct fingerprints (fp) within RADIUS connect."""
    found = common.materialize(bucket_links(key_rows(fps.select("fp", F.col("fp").alias("node")))), "links")
    links = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("a").alias("fp"), F.col("b").alias("node")).distinct()
    return links if hot.isEmpty() else links.union(hot_links(hot))


def parts(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document: doc_id, the kept columns, fp, part and component_id.

    Nodes of the graph are the distinct fingerprints themselves, whatever the doc_ids of their rows: part is the
    smallest fingerprint of the component, component_id the smallest doc_id in it (null if none has one).
    """
    rows = common.materialize(fingerprints(docs, *keep), "fingerprints")
    fps = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    met = components(golay_links(fps)).join(fps.withColumnRenamed("fp", "node").hint("merge"), "node")
    met = common.materialize(met.select(F.col("component").alias("u"), F.col("node").alias("v"), "least"), "parts")
    linked = _with_least(met, "least").select(F.col("v").alias("fp"), F.col("u").alias("part"), "m")
    joined = fps.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("part", "fp").alias("part"), F.when(F.col("part").isNull(), F.col("least")).otherwise(F.col("m")).alias("component_id"))
    return rows.join(joined.hint("merge"), "fp", "left").select("doc_id", *keep, "fp", "part", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at three or fewer differing bits; the component is the smallest doc_id reachable. Links are
    searched between distinct fingerprints, so copies cost nothing, and rows of one text never meet in one task. Null or
    blank texts have fingerprint 0 and are linked like any other. Null doc_ids keep their row and count as larger than
    all others (null component only if no other member has a doc_id). Rows without a doc_id, or with the same one, are
    linked by their texts only. No documents: an empty result.
    """
    return parts(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
