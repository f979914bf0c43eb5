"""Importance resampling: weights and ranks against brute force, the radix sort against sorted(), odd and empty rows."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, run):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least=20, buckets=10_000, run=1):
    """Rows (doc_id, text) to sorted rows of the result."""
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for x in features(text, run)[1]:
                counts[bucket(x)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc_id, text in docs:
        words, found = features(text, run)
        weight = sum(gain[bucket(x)] for x in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_whole_table(spark, docs, texts, sf_dir):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert got(resampling.resample(docs, target)) == brute(list(texts.items()), [r["text"] for r in target.collect()])


@pytest.mark.parametrize("run", [1, 3])
def test_odd_rows(spark, odd, nothing, run):
    target = spark.createDataFrame([("One TWO three",), (None,), ("",), ("x",)], "text string")
    pairs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    made = resampling.resample(odd, target, percent=60, least_words=1, buckets=50, run=run)
    assert got(made) == brute(pairs, ["One TWO three", None, "", "x"], 60, 1, 50, run)
    assert resampling.resample(nothing, target).collect() == []
    assert resampling.resample(odd, target.where("false")).count() == odd.count()


def test_long_text_in_pieces(monkeypatch):
    text = "Ünï " * 1000 + "x" * 5000 + " one,two  THREE"
    whole = [list(x) for x in resampling.features(text.encode(), 3)]
    monkeypatch.setattr(resampling, "PIECE", 64)
    pieces = list(resampling.features(text.encode(), 3))
    assert len(pieces) > 9
    assert sorted(w for x in whole for w in x) == sorted(w for x in pieces for w in x) == sorted(x.encode() for x in features(text, 3)[1])


def test_radix_rank(spark):
    rng = random.Random(5)
    made = [(rng.choice([None, -(2**63), 2**63 - 1, 0, -1, rng.randrange(-(2**40), 2**40)]), rng.randrange(-3, 4), i) for i in range(3000)]
    df = spark.createDataFrame(made, "a long, b long, c long").repartition(5)
    found = {r["_pos"]: (r["a"], r["b"], r["c"]) for r in resampling.radix_rank(df, [("b", True), ("a", False), ("c", True)], digit=5, block_rows=100).collect()}
    want = sorted(made, key=lambda r: (-r[1], r[0] is None, r[0] or 0, -r[2]))
    assert [found[i] for i in range(len(made))] == want


def test_hot_rows_fill_equal_blocks(spark):
    """One key in all rows: places are still all different, and blocks equally large."""
    df = spark.range(5000).select(F.lit(7).cast("long").alias("a"))
    found = resampling.radix_rank(df, [("a", False)], block_rows=100)
    assert sorted(r["_pos"] for r in found.collect()) == list(range(5000))


def test_every_null_id_counts(spark):
    """Half of the rows without a doc_id, copies among them: each is a row, each drawn rank is given once."""
    text = "alpha beta gamma delta " * 8
    pairs = [(None if i % 2 else i, text if i % 3 else text + "omega") for i in range(400)]
    made = resampling.resample(spark.createDataFrame(pairs, "doc_id long, text string"), spark.createDataFrame([("omega",)], "text string"), percent=50)
    assert got(made) == brute(pairs, ["omega"], 50)
    assert sorted(r["rank"] for r in made.where("rank is not null").collect()) == list(range(1, 201))
