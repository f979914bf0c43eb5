"""Curves, posts, platforms and contracts on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import mathcols as X
from quillon.operators import curves as V
from quillon.operators import filters as Y
from quillon.operators import forecast as W
from quillon.operators import markets as M
from quillon.operators import text as T


@pytest.mark.parametrize("nu", [3, 4, 5])
def test_student_quantile_inverts(spark, nu):
    got = spark.createDataFrame([(p,) for p in (0.01, 0.3, 0.5, 0.77, 0.99, None)], "p double").select("p", X.student_quantile(F.col("p"), nu).alias("t"))
    for r in got.select("p", "t", X.student_cdf(F.col("t"), nu).alias("back")).collect():
        assert r["t"] is None if r["p"] is None else r["back"] == pytest.approx(r["p"], abs=1e-10)


def test_shifted_curve(spark):
    """The chance of a rise meets its target, the shape far off stays, probabilities fall, bounds hold the point."""
    levels = [(a, 60.0 + 2 * i, 1 - i / 40, None, None, i % 4 > 0) for a in ("x", "y", "none", "null") for i in range(40)]
    curve = spark.createDataFrame(levels, "asset string, price double, probability double, lower double, upper double, pure boolean")
    params = spark.createDataFrame([("x", 100.0, 0.05, 0.08, 0.4, 0.5), ("y", 100.0, -0.3, 0.05, 0.55, 0.8), ("null", 100.0, None, 0.1, 0.4, 0.5)], "asset string, spot double, mu double, sigma double, kappa double, centre double")
    out = {}
    for r in V.shift_drift(curve, params).orderBy("asset", "price").collect():
        out.setdefault(r["asset"], []).append(r)
    for a in ("none", "null"):
        assert [(r["probability"], r["lower"]) for r in out[a]] == [(x[2], None) for x in levels if x[0] == a]
    for a, mu, sigma, kappa, centre in (("x", 0.05, 0.08, 0.4, 0.5), ("y", -0.3, 0.05, 0.55, 0.8)):
        p = [r["probability"] for r in out[a]]
        assert p == sorted(p, reverse=True) and all(r["lower"] <= r["probability"] <= r["upper"] for r in out[a])
        scaled = sigma * math.sqrt(3 / 5)
        raw = 1 - spark.range(1).select(X.student_cdf(F.lit(-mu / scaled), 5)).first()[0]
        at_spot = next(r for r in V.shift_drift(curve.withColumn("pure", F.lit(True)), params).where(F.col("asset") == a).collect() if r["price"] == 100.0)
        assert at_spot["probability"] == pytest.approx(kappa * centre + (1 - kappa) * raw, abs=1e-9)
    assert V.shift_drift(curve.limit(0), params).count() == 0 and V.shift_drift(curve, params.limit(0)).count() == len(levels)


def test_outlook_of_short_ladders(spark):
    ladder = spark.createDataFrame([("one", 90.0, 0.7), ("two", 90.0, 1.0), ("two", 110.0, 0.0)], "asset string, price double, probability double")
    got = {r["asset"]: r for r in V.curve_outlook(ladder, spark.createDataFrame([("one", 100.0), ("two", 100.0), ("none", 100.0)], "asset string, spot double")).collect()}
    assert (got["two"]["expected_price"], got["two"]["expected_return"], got["two"]["p_up"]) == (100.0, 0.0, 0.5)
    assert [got["two"][k] for k in V.SCENARIOS] == pytest.approx([0.25, 0.1, 0.3, 0.1, 0.25])
    assert got["one"]["expected_price"] == got["none"]["expected_price"] == 100.0 and got["none"]["p_up"] == 0.5


def test_posts(spark):
    want = {"": (0.0, "neutral"), "BUY buy sell": (1 / 3, "bullish"), "🚀📉": (0.0, "neutral"), "rebuy": (0.0, "neutral"), "fear 💀 rally": (-1 / 3, "bearish"), None: (0.0, "neutral"), "buy_now 🗑️ ⚰️": (0.0, "neutral"), "moon " * 10**5 + "crash " * 10**5: (0.0, "neutral")}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    for r in df.select("t", T.social_sentiment(F.col("t")).alias("s")).collect():
        assert (r["s"]["score"], r["s"]["sentiment"]) == (pytest.approx(want[r["t"]][0]), want[r["t"]][1])


def test_post_statistics_equal_plain_ones(spark):
    rng = random.Random(2)
    kinds = ("bullish", "bearish", "neutral")
    rows = [(rng.choice("ab"), rng.choice(kinds), rng.uniform(-1, 1), rng.choice([None, 0, 3, 50])) for _ in range(500)] + [("few", "bullish", 0.5, None)]
    got = {r["k"]: r for r in T.sentiment_stats(spark.createDataFrame(rows, "k string, sentiment string, sentiment_score double, votes long"), "k").collect()}
    for k in ("a", "b", "few"):
        mine = [(s, x, v or 0) for g, s, x, v in rows if g == k]
        most = max(1, *[v for *_, v in mine]) if len(mine) > 1 else 1
        mean = sum(x * (1 + v / most) for _, x, v in mine) / sum(1 + v / most for *_, v in mine)
        n = [sum(s == kind for s, *_ in mine) for kind in kinds]
        pct = [math.floor(100 * x / len(mine) + 0.5) for x in n[:2]]
        assert [got[k][x] for x in ("total", *kinds, "bullish_pct", "bearish_pct", "neutral_pct", "avg_score")] == [len(mine), *n, *pct, 100 - sum(pct), math.floor(100 * mean + 0.5)]


def test_platforms(spark):
    rows = [("off", "m", "consensus", 0.3), ("off", "b", "consensus", 0.3), ("off", "z", "event", 0.9), ("edge", "m", "consensus", 0.1), ("null", "m", "consensus", None), ("event", "m", "event", 0.9)]
    got = {r["k"]: tuple(r)[1:] for r in M.cross_platform(spark.createDataFrame(rows, "k string, source string, kind string, gap double"), "k").collect()}
    calm = (False, 0, 1.0, None, None)
    assert got == {"off": ("divergence", True, -8, 1.08, "b", 0.3), "edge": ("agreement", *calm), "null": ("agreement", *calm), "event": ("none", *calm)}


def test_contracts_and_rows(spark):
    rows = [("c", i, 1, i) for i in range(20)] + [("c", 99, 500, None), ("c", 98, None, 5), ("p", 1, 0, 1), ("p", 2, 0, 1)]
    df = spark.createDataFrame(rows, "side string, id long, volume long, open_interest long")
    assert [tuple(r) for r in M.unusual_volume(df, "side", "id").select("side", "id").collect()] == [("c", 99)]
    assert {r["id"] for r in M.top_by_open_interest(df, "side", "id", 2).collect()} == {19, 18, 1, 2}
    assert W.put_call_ratio(spark.createDataFrame([("a", "put", 3)], "k string, kind string, volume long"), "k").first()["ratio"] is None
    hashes = spark.createDataFrame([("x",), ("x",), (None,)], "hash string")
    assert Y.rows_by_hash(spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id long, h string"), "h", hashes).count() == 1
