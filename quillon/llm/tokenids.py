"""Token ids in binary form: patched frame-of-reference blocks.

An image holds the ids of a run of documents. Ids are cut into blocks of 128; a block stores its minimum and the
differences to it, packed at the width that a percentile of the differences needs; the few larger ones are
exceptions, listed with their places and full differences. An index gives where each block's bits and exceptions
start, so that any range of ids is read without the rest. Images are rows of a table that Spark writes and commits,
so a lost executor leaves no half-written file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.encoding import chunks, encoder, tokenizer_path

BLOCK = 128
MAGIC = b"PFR1"
#: Share of a block's differences that its width must hold.
PERCENTILE = 0.92
#: Ids after which an image is closed.
IMAGE_IDS = 1 << 20
FILES = "part int, image int, first_id long, n_docs int, n_ids long, payload binary"


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Unsigned 32-bit ids as blocks: counts, minima, widths, index, bits, exceptions."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = full - low[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile))
    wide = np.partition(diff, at, axis=1)[:, at] if blocks else low
    width = np.ceil(np.log2(wide.astype(np.float64) + 1)).astype(np.uint8)
    over = diff >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0
    over[width > 31] = False
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    patches = np.concatenate([[0], np.cumsum(over.sum(axis=1, dtype=np.int64))])
    bits = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        alike = np.flatnonzero(width == w)
        for own in np.array_split(alike, 1 + len(alike) // 4096):
            digits = ((diff[own][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            bits[starts[own][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(digits.reshape(len(own), -1), axis=1, bitorder="little")
    place = np.nonzero(over)[1].astype(np.uint8)
    parts = [struct.pack("<4sQI", MAGIC, n, blocks), low.astype("<u4"), width, starts.astype("<u8"), patches.astype("<u8"), bits, place, diff[over].astype("<u4")]
    return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)


def unpack(image: bytes, start: int = 0, end: int | None = None) -> np.ndarray:
    """Ids start to end of an image; only the blocks that hold them are read."""
    magic, n, blocks = struct.unpack_from("<4sQI", image)
    if magic != MAGIC:
        raise ValueError("not an image of token ids")
    at = struct.calcsize("<4sQI")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(image, kind, count, at)
        at += found.nbytes
        return found

    low, width, starts, patches = take("<u4", blocks), take("u1", blocks), take("<u8", blocks + 1).astype(np.int64), take("<u8", blocks + 1).astype(np.int64)
    bits, place, value = take("u1", int(starts[-1])), take("u1", int(patches[-1])), take("<u4", int(patches[-1]))
    end = n if end is None else min(end, n)
    if start >= end:
        return np.zeros(0, np.uint32)
    b0, b1 = start // BLOCK, -(-end // BLOCK)
    out = np.zeros((b1 - b0, BLOCK), np.uint32)
    for w in np.unique(width[b0:b1]).tolist():
        if not w:
            continue
        alike = np.flatnonzero(width[b0:b1] == w)
        for own in np.array_split(alike, 1 + len(alike) // 4096):
            digits = np.unpackbits(bits[starts[own + b0][:, None] + np.arange(w * BLOCK // 8)], axis=1, bitorder="little").reshape(len(own), BLOCK, w)
            got = np.zeros((len(own), BLOCK), np.uint32)
            for k in range(w):
                got |= digits[:, :, k].astype(np.uint32) << np.uint32(k)
            out[own] = got
    here = slice(patches[b0], patches[b1])
    out[np.repeat(np.arange(b1 - b0), np.diff(patches[b0 : b1 + 1])), place[here]] = value[here]
    return (out + low[b0:b1, None]).reshape(-1)[start - b0 * BLOCK : end - b0 * BLOCK]


def image_of(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A run of documents: their ids and sizes, then their token ids packed."""
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], "<i8")
    return struct.pack("<I", len(sizes)) + known.tobytes() + names.tobytes() + np.array(sizes, "<u8").tobytes() + pack(ids)


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, memoryview]:
    """The documents' ids, their sizes, and the packed rest for unpack()."""
    (n,) = struct.unpack_from("<I", image)
    known, names, sizes = np.frombuffer(image, "u1", n, 4), np.frombuffer(image, "<i8", n, 4 + n), np.frombuffer(image, "<u8", n, 4 + 9 * n)
    return [x if k else None for x, k in zip(names.tolist(), known.tolist(), strict=True)], sizes.astype(np.int64), memoryview(image)[4 + 17 * n :]


def cuts(docs: DataFrame, n: int) -> list[tuple[bool, int, int]]:
    """First rows (has a doc_id, doc_id, tie) of n ranges of near equal counts, in ascending order; at most n - 1 tuples.

    Ranges are cut between ties too, so that rows of one doc_id, or without any, are dealt among several.
    """
    dealt = docs.select("doc_id", "tie").repartitionByRange(n, "doc_id", "tie").withColumn("part", F.spark_partition_id())
    firsts = dealt.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")).alias("first"))
    return sorted((r["first"]["known"], r["first"]["id"], r["first"]["tie"]) for r in firsts.collect())[1:]


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1) -> None:
    """Encode whole texts (null: empty) and write the images under path, in ascending doc_id order (nulls first).

    Documents are encoded where they are read; only their ids travel, to the range of their doc_id, which writes them.
    `first_id` counts within the range.
    """
    n = common.partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    bounds = cuts(rows, n)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(tokenizer)
        for batch in batches:
            names, ties = batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()
            for at, texts in chunks(batch):
                ids, ends = run(texts)
                if end_id is not None:
                    ids, ends = np.insert(ids, ends[1:], np.uint32(end_id)), ends + np.arange(len(ends))
                # two bytes an id where they do
                kind = "<u2" if ids.max(initial=0) < 1 << 16 else "<u4"
                raw = pa.py_buffer(ids.astype(kind))
                own = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.astype("<i8") * int(kind[2])), raw]).cast(pa.binary())
                to = [bisect_right(bounds, (i is not None, i or 0, t)) for i, t in zip(names[at : at + len(texts)], ties[at : at + len(texts)], strict=True)]
                cut = slice(at, at + len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(names[cut], pa.int64()), pa.array(ties[cut], pa.int64()), pa.array(to, pa.int32()), pa.array([int(kind[2])] * len(texts), pa.int32()), own], names=["doc_id", "tie", "part", "wide", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, image, before = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal image, before, names, held, size
            payload = image_of(names, [len(x) for x in held], np.concatenate(held))
            row = {"part": [part], "image": [image], "first_id": [before], "n_docs": [len(names)], "n_ids": [size], "payload": [payload]}
            image, before, names, held, size = image + 1, before + size, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("image", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            for name, wide, own in zip(batch.column("doc_id").to_pylist(), batch.column("wide").to_pylist(), batch.column("ids"), strict=True):
                names.append(name)
                held.append(np.frombuffer(own.as_buffer(), f"<u{wide}").astype(np.uint32))
                size += len(held[-1])
                if size >= IMAGE_IDS:
                    yield close()
        if names:
            yield close()

    encoded = rows.mapInArrow(encode, "doc_id long, tie long, part int, wide int, ids binary")
    dealt = encoded.repartitionById(n, "part").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "wide", "ids").mapInArrow(write, FILES).write.option("compression", "none").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(FILES).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(batch.column("part").to_pylist(), batch.column("first_id").to_pylist(), batch.column("payload"), strict=True):
                names, sizes, rest = read_image(payload.as_py())
                ids, ends = unpack(rest).astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(names), pa.int32()), "doc_id": pa.array(names, pa.int64()), "start": ends[:-1] + first, "n_tokens": sizes, "ids_crc32": pa.array(crc, pa.int64())})

    docs = files.select("part", "first_id", "payload").mapInArrow(decode, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # as many rows as range partitions of the writer
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("_p"), F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("_base"))
    return docs.join(F.broadcast(bases), F.col("part") == F.col("_p")).select("doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write all documents as id files and read them back.

    Null or empty text: the end id alone. Null doc_id: kept, first in order. Equal doc_ids keep all rows, next to each
    other, by a hash of the text; many rows of one doc_id are dealt among several files by it. Other columns are ignored. No documents: no files' rows, an empty result.
    """
    path = path or f"{common.scratch(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_files(docs, path, tokenizer or tokenizer_path("word_bpe_49k.json"))
    return read_files(docs.sparkSession, path)
