"""Packing token sequences: large items paired by greedy matching, small ones best-fit into the gaps.

Pieces of one length can stand for each other, so the packing is decided on the histogram of lengths (at most
`capacity` rows, whatever the corpus). The decision is a list of runs "pieces number a to b of this length go to
sequences c, c+1, ... at this offset"; a piece finds its run by its length and its number among pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.encoding import chunks, encoder, tokenizer_path

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1) -> DataFrame:
    """Whole texts to pieces of at most `capacity` ids; only longer documents are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(tokenizer)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in chunks(batch, most=500_000):
                ids, ends = run(texts)
                rows = []
                for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for i, s in enumerate(range(0, len(own), capacity)):
                        x = own[s : s + capacity]
                        rows.append((doc_ids[at + k], i, s, len(x), zlib.crc32(x.tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first number, count, first sequence, offset) for a histogram of lengths, and the sequences used."""
    left = dict(counts)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, count)
    rooms: list[int] = []
    used = 0

    def place(size: int, first: int, count: int, offset: int) -> None:
        runs.append((size, counts[size] - left[size], count, first, offset))
        left[size] -= count

    def leave(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in gaps:
                insort(rooms, room)
            gaps.setdefault(room, []).append((first, count))

    large = sorted(x for x in left if 3 * x > capacity)
    for size in reversed(large):
        while left[size]:
            # the largest partner that fits, of this length or a smaller one
            k = bisect_left(large, capacity - size + 1) - 1
            while k >= 0 and (large[k] > size or not left[large[k]] or (large[k] == size and left[size] < 2)):
                k -= 1
            if k < 0:
                first, count = used, left[size]
                used += count
                place(size, first, count, 0)
                leave(capacity - size, first, count)
                break
            other = large[k]
            first, count = used, left[size] // 2 if other == size else min(left[size], left[other])
            used += count
            place(size, first, count, 0)
            place(other, first, count, size)
            leave(capacity - size - other, first, count)
    for size in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[size]:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                count = -(-left[size] // each)
                room, first = capacity, used
                used += count
            else:
                room = rooms[k]
                each = room // size
                first, count = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room], rooms[k]
            full = min(count, left[size] // each)
            for i in range(each if full else 0):
                place(size, first, full, capacity - room + i * size)
            leave(room - each * size, first, full)
            first, count = first + full, count - full
            if count and left[size]:
                some = left[size]
                for i in range(some):
                    place(size, first, 1, capacity - room + i * size)
                leave(room - some * size, first, 1)
                first, count = first + 1, count - 1
            leave(room, first, count)
    return runs, used


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text: one piece with the end id alone. Null doc_ids and repeated rows are packed like others, every
    row for itself. Other columns are ignored. No documents: an empty result. Texts do not travel: pieces hold lengths.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(n)).cast("int")
    pieces = common.materialize(cut_pieces(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), capacity).withColumn("part", part), "pieces")
    by_part = common.materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    tables = spark.sparkContext.broadcast(table)

    # number of each piece among all of its length: those of earlier parts, then its place in its own part
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = pieces.withColumn("row", F.row_number().over(inside) - 1).join(bases.hint("merge"), ["length", "part"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("row")).alias("number"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tables.value
        sizes, stride = found[:, 0], (found[:, 1] + found[:, 2]).max(initial=0) + 1
        keys = sizes * stride + found[:, 1]
        for batch in batches:
            size, number = batch.column("length").to_numpy().astype(np.int64), batch.column("number").to_numpy()
            at = np.searchsorted(keys, size * stride + number, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x) for x in ("doc_id", "piece", "start")], pa.array(size), batch.column("ids_crc32"), pa.array(found[at, 3] + number - found[at, 1]), pa.array(found[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
