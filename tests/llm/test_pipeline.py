"""The pipeline's stages against brute force, each on its own input, on clean and on odd rows."""

import hashlib
import time
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, language, similar, simhash
from tests.llm.test_operators import WORD, brute_ids, brute_language, brute_targets, draw, fold


def brute_near(rows):
    """One (doc_id, folded text) per component of all pairs of texts with a Jaccard similarity of 0.8."""
    sets, at, least = {}, defaultdict(list), {}
    for r in rows:
        text = fold(r["text"])
        words = WORD.findall(text)
        sets[text] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}
        rank = (r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256(text.encode()).hexdigest())
        least[text] = min(least.get(text, rank), rank)
    parent = {t: t for t in sets}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for t in sorted(sets):
        for u, both in Counter(u for x in sets[t] for u in at[x]).items():
            if both >= 0.8 * (len(sets[t]) + len(sets[u]) - both):
                parent[root(t)] = root(u)
        for x in sets[t]:
            at[x].append(t)
    first = {}
    for t in sets:
        first[root(t)] = min(first.get(root(t), least[t]), least[t])
    return Counter((None if none else i, sha) for none, i, sha in first.values())


def kept_rows(got):
    return Counter((r["doc_id"], hashlib.sha256(fold(r["text"]).encode()).hexdigest()) for r in got)


def check_stage(name, before, got):
    """The rows that a stage gave against its whole input."""
    if name == "language":
        labelled = [(r["text"], r["lang"]) for r in before if not language_held(r["doc_id"])]
        score = brute_language(labelled)
        want = [r for r in before if (v := score(r["text"]))[0] != "und" and v[1] >= 0.5]
        assert kept_rows(got) == kept_rows(want)
    if name == "exact dedup":
        best = {}
        for r in before:
            best.setdefault(fold(r["text"]), []).append(r["doc_id"])
        want = Counter((max((i for i in ids if i is not None), default=None), hashlib.sha256(t.encode()).hexdigest()) for t, ids in best.items())
        assert kept_rows(got) == want
    if name == "near dedup":
        assert kept_rows(got) == brute_near(before)
    if name == "mixing":
        size = lambda r: len(WORD.findall(r["text"] or ""))
        sizes = Counter()
        for r in before:
            sizes[r["source"]] += size(r)
        rate = {s: t / sizes[s] if sizes[s] else 0 for s, t in brute_targets(sizes).items()}
        want, number = Counter(), Counter()
        for r in before:
            own = (r["doc_id"], r["text"] or "", r["source"])
            chance = draw(r["doc_id"], r["text"], number[own])
            number[own] += 1
            whole = int(rate[r["source"]])
            want[(r["doc_id"], r["text"], r["source"])] += whole + (chance < rate[r["source"]] - whole)
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == +want
    if name == "packing":
        ids = brute_ids([r["text"] for r in before])
        want = Counter((r["doc_id"], p, s, min(4096, len(x) - s)) for r, x in zip(before, ids) for p, s in enumerate(range(0, len(x), 4096)))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in by.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 4096


def language_held(doc_id):
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.mark.parametrize("what", ["docs", "odd", "no_ids", "nothing"])
def test_stages(spark, request, sf_dir, what):
    """Every stage on what the stage before it kept; on odd rows also every stage on all rows."""
    first = request.getfixturevalue(what)
    rows = first
    for name, stage in corpus_pipeline.STAGES:
        for source in [rows] if what == "docs" else [rows, first]:
            before = [r.asDict() for r in source.collect()]
            out = stage(spark, source, sf_dir).cache()
            got = [r.asDict() for r in out.collect()]
            check_stage(name, before, got)
            if name != "packing":
                # the user's columns, whatever their names, come back as they were
                assert out.columns == first.columns
                extra = [c for c in first.columns if c not in ("doc_id", "text", "lang", "source")]
                was = {tuple(r[c] for c in extra) for r in before}
                assert all(tuple(r[c] for c in extra) in was for r in got)
            if source is rows:
                after = out
        rows = after


@pytest.fixture(scope="module")
def no_ids(spark):
    """Unrelated texts without a doc_id, texts that share one, near copies with and without an id."""
    x, y = ([f"{p}{i}" for i in range(60)] for p in "xy")
    near = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    rows = [(None, " ".join(x), "en"), (1, near(x, 0), "en"), (7, near(x, 59), "en"), (7, " ".join(y), "fr"), (None, near(y, 0), "fr"), (None, "p q r s", "en"), (None, "e f g h", None), (4, "some text here", "en"), (4, "other words there", "fr"), (4, "other words there", "fr")]
    return spark.createDataFrame([(*r, "s", "mine") for r in rows], "doc_id long, text string, lang string, source string, size string").repartition(2)


@pytest.mark.parametrize("texts,shingles", [(2000, 1_000_000), (2, 100), (5, 40)])
def test_chunks_of_blocks(spark, monkeypatch, texts, shingles):
    """A block that is dealt into chunks gives the same components as one that is not."""
    monkeypatch.setattr(similar, "BLOCK_TEXTS", texts)
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", shingles)
    import random

    draw, rows = random.Random(4), []
    base = [f"w{i}" for i in range(60)]
    for i in range(120):
        words = list(base)
        for _ in range(draw.randint(0, 5)):
            words[draw.randrange(60)] = f"n{draw.randint(0, 30)}"
        rows.append({"doc_id": i, "text": " ".join(words)})
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    assert kept_rows(r.asDict() for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == brute_near(rows)


def test_run_equals_stages(spark, sf_dir):
    """run() gives the pieces of what the stages keep, in as few sequences as the packing of them."""
    got = corpus_pipeline.run(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got.select(key).exceptAll(rows.select(key)).count() == rows.select(key).exceptAll(got.select(key)).count() == 0
    assert got.select(F.countDistinct("sequence_id")).first() == rows.select(F.countDistinct("sequence_id")).first()


def test_languages_need_a_teacher(spark, sf_dir):
    """Without any lang nothing can be judged, and nothing is rejected."""
    docs = spark.createDataFrame([(1, "one two", None), (2, None, None)], "doc_id long, text string, lang string")
    assert language.train(docs).names == []
    assert corpus_pipeline.identify_language(spark, docs, sf_dir).count() == 2


def test_copies_that_differ_in_case(spark, sf_dir):
    """Rows of one doc_id whose texts differ in case only: the same one stays, however the rows are dealt."""
    made = [(1, "ABC def ghi", "en", "a"), (1, "abc def ghi", "en", "b"), (1, "abc DEF ghi", "en", "c"), (None, "x Y", "en", "a"), (None, "X y", None, None)] * 40
    kept = set()
    for parts in (1, 3, 7):
        df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").repartition(parts)
        got = sorted((tuple(r) for r in corpus_pipeline.drop_copies(spark, df, sf_dir).collect()), key=str)
        assert len(got) == 2
        kept.add(tuple(got))
    assert len(kept) == 1


def test_near_copies_are_candidates_by_golay_keys(spark, monkeypatch):
    """Without any MinHash key, texts whose fingerprints differ in three bits at most still meet, and are verified."""
    signatures = similar._signatures
    monkeypatch.setattr(similar, "_signatures", lambda *a: signatures(*a).withColumn("_keys", F.expr("cast(array() as array<long>)")))
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1]), "", " . "]
    prints = [simhash.fingerprint(x, similar.WORDS) for x in texts]
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[0] ^ prints[2]).bit_count()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    part = {r.doc_id: r.part for r in similar.parts(docs, "doc_id").collect()}
    assert part[0] == part[1] and len({part[k] for k in (0, 2, 3, 4)}) == 4


def shuffle_files(spark):
    """Shuffle files that now lie in the folders of a local session."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(x) for folder in manager.localDirs() for x in Path(folder.getPath()).glob("*/shuffle_*")}


def test_rounds_leave_no_shuffle_files(spark):
    """A table written between two rounds takes its shuffle files with it; the session's setting stays as it was."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(setting)
    before = shuffle_files(spark)
    found = common.materialize(spark.range(2000).groupBy((F.col("id") % 7).alias("k")).count(), "test-rounds")
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and found.count() == 7
    assert spark.conf.get(setting) == held


def test_components_of_repeated_links(spark):
    """A hub, a chain and repeated links, in both directions and to a node itself, end as one row a node."""
    hub = [(5, k) for k in range(100, 400)]
    chain = [(k + 1, k) for k in range(1000, 1040)]
    links = spark.createDataFrame([*hub, *hub, *[(b, a) for a, b in hub[:50]], *chain, (7, 7)], "a long, b long")
    got = Counter((r.node, r.component) for r in simhash.components(links).collect())
    assert got == Counter([(5, 5), *[(b, 5) for _, b in hub], *[(k, 1000) for k in range(1000, 1041)]])
