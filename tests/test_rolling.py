"""Rolling scores: table against plain Python, stream against table with late, repeated and out-of-order rows over several triggers."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.streaming import rolling as O

START = datetime(2024, 1, 1)
RULES = {"z": O.rolling_z(6, pd.Timedelta(days=3), 3), "quantile": O.rolling_quantile(5, pd.Timedelta(days=2), 0.8)}


def rows_of(rng, n=150):
    rows = [(rng.choice(["a", "b", None]), START + timedelta(hours=rng.randrange(24 * 20)), rng.choice([1.0, 2.0, rng.uniform(0, 5)])) for _ in range(n)]
    return rows + rows[:10] + [("gap", START, 1.0), ("gap", START + timedelta(days=9), 2.0), ("a", None, 1.0), ("a", START, None)]


def plain(rows, rule):
    least = {}
    for s, at, x in rows:
        if at is not None and x is not None:
            least[s, at] = min(x, least.get((s, at), x))
    out = {}
    for s, at in least:
        held = [(t, least[s, t]) for k, t in sorted(least, key=lambda k: k[1]) if k == s and t < at][-rule.size :]
        out[s, at] = rule.plain([x for t, x in held if t >= at - timedelta(microseconds=rule.keep_us)], least[s, at])
    return out


@pytest.mark.parametrize("name", RULES)
def test_table_equals_plain(spark, name):
    rows = rows_of(random.Random(4))
    got = {(r["series"], r["at"]): r["score"] for r in O.rolling_table(spark.createDataFrame(rows, "series string, at timestamp, x double"), RULES[name]).collect()}
    assert got == {k: pytest.approx(v) for k, v in plain(rows, RULES[name]).items()}
    assert O.rolling_table(spark.createDataFrame([], "series string, at timestamp, x double"), RULES[name]).count() == 0


@pytest.mark.parametrize("name", RULES)
def test_stream_equals_table(spark, tmp_path, name):
    """Three triggers, rows of a day's delay out of order and repeated; the last trigger brings one row past its watermark, which is lost."""
    rng = random.Random(6)
    rows = [r for r in rows_of(rng) if r[1] is not None]
    df = lambda part: spark.createDataFrame(part, "series string, at timestamp, x double")
    order = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.uniform(0, 20)))  # at most 20 hours out of order
    third = len(order) // 3
    parts = [order[:third], order[third : 2 * third] + order[third - 5 : third], order[2 * third :] + [("end", START + timedelta(days=60), 1.0)], [("a", START, 99.0)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i, part in enumerate(parts):
        df(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
        source = spark.readStream.schema("series string, at timestamp, x double").parquet(str(tmp_path / "in" / "*"))
        O.rolling_stream(source, RULES[name]).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r["series"], r["at"]): r["score"] for r in found}
    want = {(r["series"], r["at"]): r["score"] for r in O.rolling_table(df(rows), RULES[name]).collect()}
    assert len(found) == len(got) and got == {k: pytest.approx(v) for k, v in want.items()}
