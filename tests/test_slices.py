"""Selection of order statistics, slices by grouping sets."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.operators import ranks as K
from quillon.operators import scoring as A


@pytest.mark.parametrize("step", [8, 4096])
def test_ranks_of_a_hot_key(spark, step):
    """One key holds nine tenths of the rows: its order statistics equal those of a sort, and no window runs over a key's rows."""
    rng = random.Random(1)
    rows = [("hot" if i % 10 else rng.choice(["a", "b", None]), rng.choice([rng.random() * 10 ** rng.randrange(-9, 9), 0.5, None])) for i in range(20_000)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "ticker string, m double")
    got = {r["ticker"]: (r["low"], r["high"]) for r in K.key_ranks(df, ("ticker",), "m", {"low": F.floor((F.col("n") - 1) / 3), "high": F.floor(2 * (F.col("n") - 1) / 3)}, step).collect()}
    values = defaultdict(list)
    for k, v in rows:
        if v is not None:
            values[k].append(v)
    assert got == {k: (sorted(v)[(len(v) - 1) // 3], sorted(v)[2 * (len(v) - 1) // 3]) for k, v in values.items()}


def steps(spark, n=60):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    rows = [(
        "x", 1, i, rng.random(), rng.uniform(-0.1, 0.1), pick(0.03, -0.03, 0.0, 0.2, -0.2, 0.05), i % 2, 10.0, 9.0, pick(9.5, 11.0), pick(0.0, 0.5, 1.0), pick("BUY", "SELL", "HOLD"), pick(None, "bull", "sideways"),
        pick(None, "good", "odd"), pick(None, "daily_return"), pick(None, True, False), pick(None, True, False), pick(None, 0.05, 0.2, 0.01), pick(None, 0.1), pick(None, True, False), pick(None, 0.4, 0.7, 0.1), pick(None, 1.0, 0.99, 1.01),
    ) for i in range(n)]
    names = "ticker string, horizon int, t int, predicted_prob double, predicted_return double, actual_return double, y int, realized_price double, ci_lower double, ci_upper double, confidence double, recommendation string, regime string, anchor_quality string, validation_metric string, structural_break boolean, original_break boolean, divergence double, original_divergence double, hmm_converged boolean, consensus double, entropy_scale double"
    return spark.createDataFrame(rows, names), rows


def test_all_slices(spark):
    df, rows = steps(spark)
    out = A.failure_decomposition(df)
    got = {(r["dimension"], r["bucket"]): r for r in out.collect()}
    assert len({d for d, _ in got}) == 15
    assert "Expand" in out._jdf.queryExecution().executedPlan().toString()
    for d in {d for d, _ in got}:
        assert sum(r["n"] for (k, _), r in got.items() if k == d) == len(rows)
    # the original run's flag wins; where neither run has one, unknown
    flag = lambda r: "unknown" if (v := r[16] if r[16] is not None else r[15]) is None else str(v).lower()
    for label in ("true", "false", "unknown"):
        own = [r for r in rows if flag(r) == label]
        right = [(r[5] > 0) if r[11] == "BUY" else (r[5] < 0) if r[11] == "SELL" else abs(r[5]) < 0.03 for r in own]
        by = defaultdict(list)
        for r in own:
            by["BUY" if r[5] > 0.03 else "SELL" if r[5] < -0.03 else "HOLD"].append(r)
        balanced = sum(sum(r[11] == k for r in v) / len(v) for k, v in by.items()) / len(by)
        assert got["structuralBreak", label]["n"] == len(own)
        assert got["structuralBreak", label]["accuracy"] == pytest.approx(sum(right) / len(right))
        assert got["structuralBreak", label]["balanced_accuracy"] == pytest.approx(balanced)
    # labels without steps are shown, odd labels are unknown
    assert got["anchorQuality", "sparse"]["n"] == 0 and got["anchorQuality", "unknown"]["n"] == sum(r[13] != "good" for r in rows)
    assert len(A.failure_decomposition(df.where("false")).collect()) == sum(len(x) for _, x in A.slices((0, 0)).values())


def test_date_clusters_of_a_long_chain(spark):
    """100,000 dates of one series, few of another: as an ordered fold makes them, and the plan gathers no dates."""
    import datetime as dt

    from quillon.operators import forecast as W

    rng = random.Random(4)
    day, rows = dt.date(1, 1, 1), []
    for _ in range(100_000):
        day += dt.timedelta(days=rng.choice([1, 1, 2, 7, 16, 30]))
        if day > dt.date(9990, 1, 1):
            break
        rows.append(("long", day))
    rows += [("few", dt.date(2020, 1, 1)), ("few", dt.date(2020, 3, 1)), ("few", dt.date(2020, 3, 1)), (None, dt.date(2020, 1, 5)), (None, None)]
    want = []
    for name in ("long", "few", None):
        start = last = None
        for d in sorted({d for s, d in rows if s == name and d is not None}):
            if start is None or (d - last).days > 15 or (d - start).days > 60:
                want.append([name, d, d, 0])
                start = d
            last = d
            want[-1][2:] = [d, want[-1][3] + 1]
    out = W.cluster_dates(spark.createDataFrame(rows, "series string, d date").repartition(6))
    assert sorted((list(r) for r in out.collect()), key=str) == sorted(want, key=str)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_weights_and_intervals(spark):
    """The vectors give what copying every row for every replicate would give; nothing is exploded."""
    import numpy as np
    from quillon.operators import ablation as B

    rows = [("a" if i % 3 else None, 1, i, (i % 7) / 7 if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "ticker string, horizon int, t int, v double").repartition(3)
    got = {r["ticker"]: (r["low"], r["mid"], r["high"]) for r in B.bootstrap(df, {"v": F.col("v")}, replicates=41, seed=3).collect()}
    for key in ("a", None):
        own = [(B.weights(f"3|{'null' if k is None else k}|{h}|{t}", 41), v) for k, h, t, v in rows if k == key and v is not None]
        w, v = np.stack([x for x, _ in own]), np.array([x for _, x in own])
        values = sorted(w.T @ v / w.sum(axis=0))
        assert got[key] == pytest.approx((values[1], values[20], values[39]))
    drawn = np.concatenate([B.weights(f"x{i}", 200) for i in range(500)])
    assert drawn.mean() == pytest.approx(1, abs=0.02) and drawn.var() == pytest.approx(1, abs=0.03)


def test_positions_and_late_ticks(spark, tmp_path):
    """Update mode: a tick within the watermark moves its day, one beyond it does not; ticks without a position never count."""
    from quillon.streaming import stateful as Z

    rows = [[(1, "2024-01-10 10:00:00", 1, 5.0), (2, "2024-01-10 11:00:00", 2, 9.0)], [(1, "2024-01-09 23:00:00", 3, 4.0), (1, "2024-01-12 10:00:00", 4, 6.0)], [(1, "2024-01-10 12:00:00", 5, 7.0), (1, "2024-01-12 09:00:00", 6, 8.0)]]
    shape = "user_id long, ts string, event_id long, value double"
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, shape).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    positions = spark.createDataFrame([(1, 2.0), (3, 1.0)], "user_id long, quantity double")
    seen = {}

    def take(df, _):
        for r in df.collect():
            seen[str(r["day"]), r["user_id"]] = (r["price"], r["value"], r["ticks"])

    schema = spark.read.parquet(str(tmp_path / "in/b0")).schema
    for i in range(3):  # one folder a run, in this order; the state goes on
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / ("b[0-%d]" % i)))
        Z.valued_positions(source, positions).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(take).trigger(availableNow=True).start().awaitTermination()
    # the tick of 10 January 12:00 came after the watermark of 11 January 10:00
    assert seen == {("2024-01-10", 1): (5.0, 10.0, 1), ("2024-01-09", 1): (4.0, 8.0, 1), ("2024-01-12", 1): (6.0, 12.0, 2)}
