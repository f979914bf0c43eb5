"""Maths, sources, streams and plan checks on small frames."""

import math
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.functions import mathcols as X
from quillon.operators import confidence as K
from quillon.operators import joins as J
from quillon.operators import markets as M
from quillon.operators import scoring as A
from quillon.operators import series as S
from quillon.operators import text as T
from quillon.sources import chunk_index as I
from quillon.sources import readers as R
from quillon.streaming import folds as Y
from quillon.streaming import stateful as Z

ROOT = Path(__file__).resolve().parent.parent


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("x", [-4.0, -1.3, -0.2, 0.0, 0.7, 2.5])
def test_normal(spark, x):
    want = 0.5 * (1 + math.erf(x / math.sqrt(2)))
    assert one(spark, X.normal_cdf(F.lit(x))) == pytest.approx(want, abs=2e-7)
    assert one(spark, X.probit(F.lit(want))) == pytest.approx(x, abs=1e-6)


@pytest.mark.parametrize("nu,t,want", [(3, 1.0, 0.8044988905), (4, -2.0, 0.0580582618), (5, 0.5, 0.6808505640)])
def test_student(spark, nu, t, want):
    assert one(spark, X.student_cdf(F.lit(t), nu)) == pytest.approx(want, abs=1e-8)


def test_library_stands_without_corpus_operators():
    code = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name == 'quillon.llm' or name.startswith('quillon.llm.'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and e.oracle_sql() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0


def test_no_python_in_plans(spark, sf_dir):
    from quillon.plans import QUERIES

    for name in QUERIES:
        if name.startswith(("str_", "mkt_42", "udf_06_sql")):  # the last: folds of str_ as table functions
            continue
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("MapInPandas", "FlatMapGroupsInPandas", "ArrowEvalPython", "BatchEvalPython")), name


PRICES = [("a", "2024-01-01", 100.0), ("a", "2024-01-02", 110.0), ("a", "2024-01-03", 99.0), ("a", "2024-01-04", 99.0), ("b", "2024-01-01", 50.0), ("b", "2024-01-02", 50.0)]


@pytest.fixture(scope="module")
def prices(spark):
    return spark.createDataFrame(PRICES, "series string, d string, close double").withColumn("d", F.to_date("d"))


def test_series_by_hand(prices):
    r = {(x["series"], str(x["d"])): x["r"] for x in S.simple_returns(prices).collect()}
    assert r == pytest.approx({("a", "2024-01-02"): 0.1, ("a", "2024-01-03"): -0.1, ("a", "2024-01-04"): 0.0, ("b", "2024-01-02"): 0.0})
    assert {x["series"]: x["max_drawdown"] for x in S.max_drawdown(prices).collect()} == pytest.approx({"a": 0.1, "b": 0.0})
    assert {x["series"]: x["var"] for x in S.tail_risk(S.simple_returns(prices)).collect()} == pytest.approx({"a": 0.1, "b": 0.0})
    # upper median of |0.1|, |-0.1|, |0| is 0.1
    assert {x["series"]: x["threshold"] for x in S.adaptive_threshold(S.simple_returns(prices)).collect()} == pytest.approx({"a": 0.05, "b": 0.001})


def test_transition_rows_sum_to_one(prices):
    m = S.transition_matrix(S.regime_series(S.simple_returns(prices)), min_obs=1)
    assert all(x["s"] == pytest.approx(1) for x in m.groupBy("series", "state_from").agg(F.sum("p").alias("s")).collect())
    assert m.count() == 18
    default = S.transition_matrix(S.regime_series(S.simple_returns(prices)))
    assert [x["lambda2"] for x in S.second_eigenvalue(default).collect()] == pytest.approx([0.4, 0.4])


def test_empty_series(prices):
    none = prices.where("false")
    for f in (S.simple_returns, S.max_drawdown, S.rolling_z, S.risk_report, S.momentum):
        assert f(none).count() == 0


def test_brier_of_nothing_is_one(spark):
    assert spark.createDataFrame([], "predicted_prob double, y int").agg(A.brier().alias("b")).first()["b"] == 1.0


def test_asof_is_inclusive_unless_strict(spark):
    left = spark.createDataFrame([("k", 1), ("k", 3), ("k", 5), ("z", 3)], "k string, at int")
    right = spark.createDataFrame([("k", 3, 0.3), ("k", 4, 0.4)], "k string, at int, v double")
    got = lambda strict: sorted((x["k"], x["at"], x["v"]) for x in J.asof(left, right, "k", "at", "v", strict).collect())
    assert got(False) == [("k", 1, None), ("k", 3, 0.3), ("k", 5, 0.4), ("z", 3, None)]
    assert got(True) == [("k", 1, None), ("k", 3, None), ("k", 5, 0.4), ("z", 3, None)]


def test_drop_fields_deep(spark):
    df = spark.sql("select 1 as id, named_struct('a', 1, 'x', 2) as s, array(named_struct('x', 1, 'b', named_struct('x', 3, 'c', 4))) as l")
    out = J.drop_fields_deep(df, {"x"})
    assert out.schema.simpleString() == "struct<id:int,s:struct<a:int>,l:array<struct<b:struct<c:int>>>>"


def test_question_semantics(spark):
    qs = {"": "ambiguous", "Will it trade between 1 and 2?": "range", "Will it hit $100?": "barrier", "Will it close above 5?": "terminal", "Who?": "unknown", "Will it stay below 3?": "path"}
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    assert {x["q"]: x["s"] for x in df.select("q", M.question_semantics(F.col("q")).alias("s")).collect()} == qs


def test_price_levels_and_tickers(spark):
    assert one(spark, M.extract_price_levels(F.lit("from 5 to 1,500 or 100k, 1.5m and 100k"))) == [1500.0, 100000.0, 1500000.0]
    assert one(spark, T.extract_tickers(F.lit("Buy $TSLA and BRK.B, THE end of AAPL; not lower or Éa"))) == ["AAPL", "BRK.B", "TSLA"]


def test_chunks_respect_the_budget(spark):
    text = "\n\n".join(["a" * 30, "b" * 30, "c" * 80 + ". " + "e" * 100, "d"])
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = lambda *x: [tuple(r)[:3] + tuple(r)[4:] for r in T.chunk_text(df, *x).orderBy("doc_id", "chunk").collect()]
    assert got(30) == [(1, 0, "a" * 30 + "\n\n" + "b" * 30, 1, 3), (1, 1, "c" * 80 + ".", 5, 5), (1, 2, "e" * 100 + "\n\nd", 6, 7)]
    # the last paragraph of a chunk opens the next one where it fits the overlap
    assert got(20, 10)[:2] == [(1, 0, "a" * 30 + "\n\n" + "b" * 30, 1, 3), (1, 1, "b" * 30, 3, 3)]
    assert all(len(x[2]) <= 70 for x in got(20, 10))


def test_vector_blocks_equal_one_block(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.where("vec_id % 5 = 0").selectExpr("vec_id as query_id", "embedding as query")
    key = lambda df: sorted((r["query_id"], r["vec_id"], r["rank"]) for r in df.collect())
    assert key(T.vector_search(e, q, 3, block=7)) == key(T.vector_search(e, q, 3))


def test_hybrid_scores(spark):
    kw = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5)], "query_id int, id int, score double")
    ve = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.01), (2, 9, 0.5)], "query_id int, id int, score double")
    more = spark.createDataFrame([(1, 1)], "query_id int, id int")
    got = {(r["query_id"], r["id"]): r["score"] for r in T.hybrid(kw, ve, 5, min_score=0.05, boosted=more).collect()}
    assert got == pytest.approx({(1, 1): 0.55, (1, 2): 0.78, (2, 9): 0.5})


def test_market_quality_flags(spark):
    row = spark.createDataFrame([(30.0, 1e6, "macro", 10.0, 0.01, 0.5)], "age_days double, volume double, tier string, days_to_expiry double, spread double, probability double")
    got = row.select(M.market_quality().alias("q"), M.market_quality(spike=F.lit(True), transitory=F.lit(True), stable=F.lit(True)).alias("s"), M.market_quality(stable=F.lit(True), fast=F.lit(None).cast("boolean")).alias("t"), M.market_quality(9.0).alias("h")).first()
    assert (got["s"] / got["q"], got["t"] / got["q"], got["h"] / got["q"]) == pytest.approx((0.5, 1.1, 0.75))


def test_mmr_prefers_novelty(spark):
    df = spark.createDataFrame([(1, 1, 1.0, ["a", "b"]), (1, 2, 0.95, ["a", "b"]), (1, 3, 0.9, ["c"])], "query_id int, id long, score double, tokens array<string>")
    assert [x["id"] for x in T.mmr(df, 0.5).orderBy("rank").collect()] == [1, 3, 2]


def test_snapshot_files(spark, tmp_path):
    lines = ['{"marketId":"m","question":"q","probability":0.5,"volume24h":1,"endDate":"","capturedAt":"2024-01-01T00:00:00Z","bid":1.5,"ask":0.6}', "not json", '{"marketId":" ","probability":0.5,"volume24h":1,"capturedAt":"2024-01-01T00:00:00Z"}', '{"marketId":"m","probability":1.5,"volume24h":1,"capturedAt":"2024-01-01T00:00:00Z"}']
    (tmp_path / "s.json").write_text("\n".join(lines))
    good, bad = R.read_snapshots(spark, str(tmp_path / "s.json"))
    assert [(x["marketId"], x["bid"], x["ask"]) for x in good.collect()] == [("m", None, 0.6)] and bad.count() == 3
    R.append_snapshots(good, str(tmp_path / "log"))
    R.append_snapshots(good.where("false"), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "log") and not (tmp_path / "none").exists()


def test_other_sources(spark, tmp_path):
    (tmp_path / "v.csv").write_text("DATE,VALUE\n2024-01-01,1.5\n2024-01-02,.\n2024-01-03,\n")
    assert [(str(x["date"]), x["value"]) for x in R.latest_value(R.read_csv_series(spark, str(tmp_path / "v.csv"))).collect()] == [("2024-01-01", 1.5)]
    (tmp_path / "f.xml").write_text('<feed><entry><title>10-Q</title><updated>2024-05-01T00:00:00Z</updated><link href="http://x"/></entry></feed>')
    assert [tuple(x) for x in R.parse_filing_feed(spark, str(tmp_path / "f.xml")).collect()] == [("http://x", "2024-05-01", "10-Q")]
    (tmp_path / "q.csv").write_text('q,a\n"two\nlines, ""quoted""",b\n')
    assert [tuple(x) for x in R.read_eval_questions(spark, str(tmp_path / "q.csv"), "q string, a string").collect()] == [('two\nlines, "quoted"', "b")]
    df = spark.sql("select 1 as id, named_struct('a', 2) as s")
    R.append_ledger(df, str(tmp_path / "ledger"))
    assert R.read_ledger(spark, str(tmp_path / "ledger"), "id int, s string", {"s": "struct<a:int>"}).first()["s"]["a"] == 2
    for kind in ("json", "csv", "markdown"):
        R.export_rows(spark.range(2).withColumn("x", F.lit('a"b')), str(tmp_path / kind), kind)
        assert os.listdir(tmp_path / kind)


def test_adwin_finds_a_shift_and_stream_equals_batch(spark, tmp_path):
    rows = [("s", f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", 0.0 if i < 120 else 1.0) for i in range(240)]
    df = spark.createDataFrame(rows, "series string, d string, x double").withColumn("d", F.to_date("d"))
    batch = sorted(tuple(x) for x in Z.adwin_batch(df).collect())
    cuts = [i for i, x in enumerate(batch) if x[2]]
    assert cuts and 120 <= cuts[0] < 160
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = Z.adwin_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    assert sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == batch


def test_incremental_index(spark, tmp_path):
    df = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b")], "hash string, content string")
    for _ in range(2):
        Z.incremental_index(df, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 2


def test_chunk_index_in_step(spark, tmp_path):
    index, kind = str(tmp_path / "index"), "doc_id long, text string"
    text = {1: "one\n\ntwo", 2: "", 3: None, 4: "gone"}
    frame = lambda d: spark.createDataFrame(list(d.items()), kind)
    chunks = lambda: sorted((x["doc_id"], x["content"]) for x in I.read_index(spark, index).collect())
    made = lambda: {x["file"]: x["made"] for x in I.listed_files(spark, index).collect()}
    assert chunks() == []
    assert I.sync_index(frame(text), index) == 1
    assert chunks() == [(1, "one\n\ntwo"), (4, "gone")]
    later = {1: "one\n\ntwo", 2: "now", 3: None}
    # a run cut off before its list was written leaves chunks that do not count, and is repeated
    frame({1: "stray"}).write.parquet(f"{index}/files/gen=2/_temporary/x")
    I.sync_index(frame(later).union(spark.createDataFrame([(None, "no file")], kind)), index)
    assert chunks() == [(1, "one\n\ntwo"), (2, "now")] and made() == {1: 1, 2: 2, 3: 1}
    I.sync_index(frame(later), index, force=True)
    assert chunks() == [(1, "one\n\ntwo"), (2, "now")] and set(made().values()) == {3}
    I.sync_index(frame({}), index)
    assert chunks() == [] and made() == {}


def test_confidence_and_shrinkage_of_nulls(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(
        K.shrink_to_base_rate(F.lit(0.9)).alias("plain"), K.shrink_to_base_rate(F.lit(0.9), none, none, none).alias("nulls"),
        K.prediction_confidence(F.lit(1.0), F.lit(3), F.lit(40)).alias("few"), K.prediction_confidence(F.lit(1.0), F.lit(3), F.lit(40), none, calibrated=none, base_rate=none, asset=F.lit(None).cast("string"), volatility=none, entropy=none, r2=none).alias("none"),
        K.prediction_confidence(F.lit(1.0), F.lit(3), F.lit(40), is_break=F.lit(True), regime=F.lit("sideways"), break_policy="trend_penalty_only").alias("spared"),
    ).first()
    assert row["plain"] == row["nulls"] == pytest.approx(0.45 * 0.5 + 0.55 * 0.9)
    assert row["few"] == row["none"] == row["spared"] == pytest.approx(0.6)


STEPS = "ticker string, horizon int, t int, residual double, rv double, is_break boolean, p double, y double"


def _steps(n):
    return [(k, 1, t, 0.01 * ((7 * t) % 31), 0.02 * ((5 * t) % 13), t % 29 == 0, (t % 10) / 10 + 0.05, float(t % 3 == 0)) for k in ("a", "b") for t in range(n)]


@pytest.mark.parametrize("table,stream,fold", [(Y.conformal_pid, Y.conformal_pid_stream, Y.pid_fold()), (Y.online_brier_calibrator, Y.online_brier_stream, Y.brier_fold()), (Y.adaptive_conformal, Y.adaptive_conformal_stream, Y.break_fold())])
def test_folds_stream_equals_table(spark, tmp_path, table, stream, fold):
    rows = _steps(200)
    df = spark.createDataFrame(rows, STEPS)
    whole = {x["ticker"]: tuple(x) for x in table(df).collect()}
    names = STEPS.replace(",", "").split()[::2]
    for k in ("a", "b"):
        state = fold.zero
        for r in (x for x in rows if x[0] == k):
            state = fold.step(state, *[float(r[names.index(v)]) for v in fold.values])
        assert whole[k][2:] == pytest.approx(fold.finish(state))
    for part in (0, 1):  # two triggers: the state of the first is carried on
        df.where(f"t div 100 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*"))
        stream(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(
            lambda d, i: d.write.mode("overwrite").parquet(str(tmp_path / "out"))).start().awaitTermination()
    assert {x["ticker"]: tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()} == whole


def test_folds_of_odd_rows(spark):
    rows = [(None, None, 1, 0.2, None, None, 0.5, None), (None, None, 2, 0.0, 0.1, True, 0.5, 1.0), ("a", 1, 1, None, 0.1, True, None, 1.0), ("b", 2, 1, 0.3, 0.1, False, 0.7, 0.0), ("b", 2, 1, 0.3, 0.1, False, 0.7, 0.0)]
    df = spark.createDataFrame(rows, STEPS).withColumn("_key", F.lit("mine"))
    found = {(x["ticker"], x["horizon"]): x for x in Y.adaptive_conformal(df, cooloff=2).collect()}
    assert set(found) == {(None, None), ("b", 2)} and found[(None, None)]["coverage"] == 0.5 and found[(None, None)]["breaks"] == 1
    assert {(x["ticker"], x["horizon"]) for x in Y.online_brier_calibrator(df).collect()} == {(None, None), ("b", 2)}
    assert Y.conformal_pid(df.where("t > 9")).count() == 0


def test_settlement_and_path_of_a_hot_key(spark):
    import random
    from datetime import datetime, timedelta

    draw, start = random.Random(3), datetime(2024, 1, 1)
    when = lambda: start + timedelta(minutes=draw.randrange(400 * 24 * 12) * 5)
    prices = [("hot", when(), float(draw.randrange(90))) for _ in range(2000)] + [("few", start, 5.0), ("few", start, 3.0)] + [("gap", start, 1.0), ("gap", start + timedelta(days=300), 2.0)]
    prices += prices[:20] + [(None, start, 1.0), ("hot", None, 1.0), ("hot", start, None)]
    wants = [("hot", *sorted((when(), when()))) for _ in range(300)] + [("hot", x[1], x[1]) for x in prices[:5]]
    wants += [("few", start, start), ("few", start, start + timedelta(days=1)), ("gap", start + timedelta(days=1), start + timedelta(days=100)), ("none", start, start), ("hot", start, None), (None, start, start)]
    p, w = spark.createDataFrame(prices, "k string, at timestamp, price double"), spark.createDataFrame(wants + wants[:3], "k string, captured timestamp, target timestamp")
    good = [x for x in prices if None not in x]
    settled, path = {}, {}
    for k, a, z in wants:
        own = [x for x in good if x[0] == k]
        if z and own:
            after = [x for x in own if x[1] >= z]
            settled[k, z] = min(after, key=lambda x: x[1:])[2] if after else max(own, key=lambda x: x[1:])[2]
            inside = [x[2] for x in own if a <= x[1] <= z]
            if inside:
                path[k, a, z] = (min(inside), max(inside), len(inside))
    got = J.settlement(w, p, "k").collect()
    assert len(got) == len(settled) and {(x["k"], x["target"]): x["settled"] for x in got} == settled
    got = J.path_in_window(w, p.where("price is not null"), "k").collect()
    assert len(got) == len(path) and {(x["k"], x["captured"], x["target"]): (x["low"], x["high"], x["points"]) for x in got} == path
    plan = J.path_in_window(w, p, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and J.settlement(w.limit(0), p, "k").count() == 0 and J.settlement(w, p.limit(0), "k").count() == 0


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_best_fuzzy_match_equals_brute_force(spark, least):
    import random

    draw = random.Random(5)
    some = lambda: sorted({f"w{min(draw.randrange(40), draw.randrange(40))}" for _ in range(draw.randrange(7))})
    a, b = [(i, some()) for i in range(80)] + [(90, None)], [(i, some(), i % 5) for i in range(90)] + [(91, None, 1)]
    want = {}
    for i, x in a:
        scored = [(len({*x} & {*y}) / len({*x} | {*y}), s, m) for m, y, s in b if x and y]
        found = [(j + s / 1000, -m, j) for j, s, m in scored if j >= least]
        if found:
            want[i] = max(found)
    got = J.best_fuzzy_match(spark.createDataFrame(a, "id int, tokens array<string>"), spark.createDataFrame(b, "match_id int, tokens array<string>, stars int"), least).collect()
    assert {x["id"]: (pytest.approx(x["score"]), -x["match_id"], pytest.approx(x["jaccard"])) for x in got} == want and len(got) == len(want)


def test_raw_captures_quarantine(spark, tmp_path):
    good = '{"capturedAt":"2024-01-01T00:00:00Z","ticker":"A","horizonDays":7,"currentPrice":null,"querySet":[],"selectedMarketIds":["m"],"candidates":[{"marketId":"m","question":"q","probability":0.5,"volume24h":1}]}'
    bad = [good.replace('"A"', '" "'), good.replace("0.5", "1.5"), good.replace(":7", ":0"), good.replace('"querySet":[],', ""), good.replace("null", "-1"), good[:-1], good.replace('"candidates"', '"others"'), good.replace('"marketId":"m",', "")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.json").write_text("\n".join([good, *bad, ""]))
    rows, rest = R.read_raw_markets(spark, str(tmp_path / "m"))
    assert rows.count() == 1 and len(rest.collect()) == len(bad) and "_bad" not in rows.columns
    whale = '{"capturedAt":"2024-01-01T00:00:00Z","ticker":"A","source":"s","observationWindowStart":"2024-01-01T00:00:00Z","observationWindowEnd":"2024-01-02T00:00:00Z","transactions":[{"hash":"h","timestamp":"2024-01-01T05:00:00Z","valueUsd":2}]}'
    broken = [whale.replace('"h"', '""'), whale.replace("2024-01-01T05:00:00Z", "soon"), whale.replace('"s"', "null"), "{"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.json").write_text("\n".join([whale, *broken]))
    rows, rest = R.read_raw_whales(spark, str(tmp_path / "w"))
    assert rows.first()["transactions"][0]["valueUsd"] == 2 and rows.count() == 1 and len(rest.collect()) == len(broken)


def test_bm25_of_equal_candidates_in_any_order(spark):
    """Two documents with the same words in another order: equal sums, whatever the order of their terms, so equal scores."""
    words = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(words)), (2, " ".join(reversed(words))), *((10 + i, f"w{i} w{(i * 7) % 60} filler") for i in range(60))]
    asked = spark.createDataFrame([(0, " ".join(words))], "query_id long, text string")
    seen = set()
    for parts in (1, 3, 8):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        seen.add(tuple((r["doc_id"], r["score"], r["rank"]) for r in sorted(T.bm25(df, asked).collect(), key=lambda r: r["rank"])))
    assert seen == {((1, 1.0, 1), (2, 1.0, 2))}
