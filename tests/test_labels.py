"""Whole labels of recorded forecasts against a plain Python version."""

import random
import re
from datetime import date, timedelta

import pytest

from quillon.operators import labels as L

DAY0 = date(2024, 1, 1)
BUNDLES = "bundle_id long, key string, captured date, horizon_days int, price double, markets array<struct<market_id: string, question: string, semantics: string, levels: array<double>, target: date>>"
QUESTIONS = ["above it", "AT LEAST it", "not above it", "under it", "dip to it", "reach it", "trade at it", "belowish", None, ""]


def history(rng, n=400):
    prices = [("a", DAY0 + timedelta(rng.randrange(200)), round(100 * (1 + rng.gauss(0, 0.03)), 2)) for _ in range(n)]
    prices += [("hot", DAY0 + timedelta(rng.randrange(300)), rng.choice([100.0, 100.25, 100.26, 99.75, 99.74, 50.0, 150.0])) for _ in range(n)]
    return prices + [("a", DAY0, None), ("a", DAY0 + timedelta(900), -1.0), ("a", None, 5.0), (None, DAY0, 5.0), ("bad", DAY0, 0.0)]


def says(words, q):
    return re.search(rf"\b({words})\b", (q or "").lower()) is not None


def expected(bundle, prices):
    ident, key, start, days, price, markets = bundle
    points = sorted((at, p) for k, at, p in prices if k == key and key is not None and at and p is not None and p > 0)
    if not points:
        return ident, False, "no_history", None, None, None
    last, ends = points[-1][0], start + timedelta(days)
    target = lambda m: m[4] or ends
    why = ["no_price"] if price is None else ["forecast_open"] if last < ends else []
    if any(m[2] != "ambiguous" and last < target(m) for m in markets or []):
        why.append("market_open")
    if why:
        return ident, False, ",".join(why), None, None, None
    at = lambda t: next((p for d, p in points if d >= t), points[-1][1])

    def outcome(m):
        _, q, kind, levels, _ = m
        level = levels[0] if levels and levels[0] is not None and levels[0] == levels[0] else None
        path = [p for d, p in points if start <= d <= target(m)]
        if kind == "terminal" and level is not None:
            x = at(target(m))
            hit = x >= level if says("at least|not below", q) else x <= level if says("at most|not above", q) else x < level if says("below|under|less than", q) else x > level
        elif kind == "barrier_touch" and level is not None and path:
            hit = any(abs(p - level) / level <= 0.0025 for p in path) if says("trade at", q) else min(path) <= level if says("dip|drop below|fall below|below|under", q) else max(path) >= level
        elif kind == "range" and len(ok := sorted(x for x in levels or [] if x is not None and x == x)) > 1:
            hit = ok[0] <= at(target(m)) <= ok[1]
        else:
            return "unsupported"
        return "yes" if hit else "no"

    return ident, True, "", at(ends), int(at(ends) > price), [(m[0], m[2], outcome(m)) for m in markets or []]


def test_labels_equal_a_plain_version(spark):
    """Nulls, ties, open and ambiguous markets, empty level lists, a hot key with prices at both edges of the tolerance."""
    rng = random.Random(5)
    prices = history(rng)

    def market(i):
        levels = rng.choice([None, [], [None], [float("nan"), 100.0], [100.0], [100.0, 100.0], [103.0, 97.0, 200.0], [99.0], [100.25], [130.0], [70.0]])
        return (f"m{i}", rng.choice(QUESTIONS), rng.choice([*L.MEANINGS, "terminal", "barrier_touch", "barrier_touch", None]), levels, rng.choice([None, DAY0 + timedelta(rng.randrange(210))]))

    bundles = [(i, rng.choice(["a", "hot", "hot", "bad", None, "none"]), DAY0 + timedelta(rng.randrange(150)), rng.randrange(60), rng.choice([100.0, 100.0, 99.5, None]), rng.choice([None, [], *[[market(10 * i + j) for j in range(rng.randrange(1, 5))]] * 6])) for i in range(250)]
    got = L.label_replay(spark.createDataFrame(bundles, BUNDLES), spark.createDataFrame(prices, "key string, at date, price double"))
    rows = {r["bundle_id"]: (r["bundle_id"], r["ready"], r["pending"], r["realised_price"], r["actual"], None if r["semantic"] is None else [tuple(x) for x in r["semantic"]]) for r in got.collect()}
    assert rows == {b[0]: expected(b, prices) for b in bundles}
    seen = {(m[1], m[2]) for r in rows.values() for m in r[5] or []}
    assert {("barrier_touch", "yes"), ("barrier_touch", "no"), ("terminal", "yes"), ("range", "yes"), ("range", "no"), ("ambiguous", "unsupported")} <= seen


def test_labels_of_empty_tables(spark):
    none, some = spark.createDataFrame([], BUNDLES), spark.createDataFrame([(1, "a", DAY0, 1, 1.0, None)], BUNDLES)
    prices = spark.createDataFrame([], "key string, at date, price double")
    assert L.label_replay(none, prices).count() == 0
    assert [(r["pending"], r["ready"], r["semantic"]) for r in L.label_replay(some, prices).collect()] == [("no_history", False, None)]


def test_frozen_bundles(spark):
    chosen = spark.createDataFrame([("b", [3, 1, 9, 1, None]), ("none", None), ("empty", [])], "bundle_id string, ids array<long>")
    markets = spark.createDataFrame([(1, "x", "Will it reach $1,200 or 5k?", 0.5, None), (2, "x", "above 20", 0.5, None), (3, None, "above 20", 0.5, None)], "market_id long, asset_id string, question string, probability double, target date")
    got = {r["bundle_id"]: (r["skipped"], [(m["market_id"], m["semantics"], m["levels"]) for m in r["markets"]]) for r in L.freeze_bundles(chosen, markets).collect()}
    assert got == {"b": (3, [(1, "barrier_touch", [1200.0, 5000.0])] * 2), "none": (0, []), "empty": (0, [])}


def test_promotion_needs_its_gate(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    spark.createDataFrame([(1, 2.0), (2, None)], "bundle_id long, realised_price double").write.parquet(at("staged"))
    gate = lambda *v: spark.createDataFrame([(x,) for x in v], "verdict string")
    assert L.promote(at("staged"), at("to"), at("receipt"), gate("pass", "hold"), "now") is None and not (tmp_path / "to").exists()
    for places in ((at("staged"), at("staged"), at("receipt")), (at("staged"), at("to"), at("to") + "/")):
        with pytest.raises(ValueError, match="differ"):
            L.promote(*places, gate("pass"), "now")
    with pytest.raises(ValueError, match="no gate"):
        L.promote(at("staged"), at("to"), at("receipt"), gate(), "now")
    for _ in range(2):  # a repeated run gives the same receipt
        assert [tuple(r) for r in L.promote(at("staged"), at("to"), at("receipt"), gate("pass"), "now").collect()] == [(L.RECEIPT, "now", at("staged"), at("to"), 2, 1)]
    assert spark.read.parquet(at("to")).count() == 2


def test_whales_without_direction(spark):
    rows = [("in", 5.0, "x", "Kraken"), ("in", 1.0, "kraken", "me"), ("in", None, "kraken", "me"), ("none", 3.0, None, None), ("none", float("nan"), "kraken", ""), ("both", 10.0, "kraken", "okx"), ("even", 10.0, "okx", "y"), ("even", 10.0, "y", "okx")]
    got = L.whale_flow(spark.createDataFrame(rows, "k string, value_usd double, from_owner string, to_owner string"), "k", exchanges=("kraken", "okx"))
    assert {r["k"]: (r["direction"], round(r["confidence"], 6)) for r in got.collect()} == {"in": ("short", 0.7), "none": ("neutral", 0.35), "both": ("neutral", 0.35), "even": ("neutral", 0.4)}
