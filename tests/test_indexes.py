"""Indexes, segment regressions, data sources and table functions: against brute force, on odd rows, and their pruning."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import table_functions as L
from quillon.operators import postings as P
from quillon.operators import ranks as K
from quillon.operators import segments as G
from quillon.operators import series as S
from quillon.operators import text as T
from quillon.operators import vector_index as V
from quillon.sources import chunk_index as I
from quillon.sources import history as H
from quillon.streaming import folds as Z

# vectors in cells


def vectors_of(n, size=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, size))
    return [(i, [float(x) for x in centres[i % 9] + 0.4 * rng.normal(size=size)]) for i in range(n)]


def scan(rows, asked, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = []
    for q, v in asked:
        found = sorted((-round(float(unit(v) @ unit(x)), 9), i) for i, x in rows)[:k]
        out += [(q, i, place + 1, round(max(0.0, 1 - (1 + s) / 2), 6)) for place, (s, i) in enumerate(found)]
    return sorted(out)


def shown(df):
    return sorted((r["query_id"], r["vec_id"], r["rank"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("block", [2000, 7])
def test_vector_index(spark, tmp_path, block):
    made = vectors_of(1500)
    odd = [(5000, [0.0] * 12), (5001, None), (5002, [1.0]), (5003, []), (5004, [float("nan")] * 12), (None, made[0][1])] + [(6000 + i, made[3][1]) for i in range(400)]
    df = spark.createDataFrame(made + odd, "vec_id long, embedding array<double>").repartition(4)
    V.build_index(df, str(tmp_path / "v"))
    good = made + odd[6:]
    asked = made[::50] + [(9000, [-x for x in made[0][1]]), (9001, made[3][1])]
    q = spark.createDataFrame(asked + [(9002, [0.0] * 12), (9003, None), (9004, [2.0])], "query_id long, query array<double>")
    want = scan(good, asked, 10)
    assert shown(V.search_index(spark, str(tmp_path / "v"), q, exact=True, block=block)) == want
    near = V.search_index(spark, str(tmp_path / "v"), q, block=block)
    met = {r[:2] for r in shown(near)} & {r[:2] for r in want}
    assert len(met) >= 0.9 * len(want)
    # every vector that has a direction lies in a cell, all others apart
    cells = spark.read.parquet(str(tmp_path / "v" / "cells"))
    assert cells.where("cell >= 0").count() == len(good) and cells.where("cell = -1").count() == 5


def test_vector_index_reads_few_cells(spark, tmp_path):
    V.build_index(spark.createDataFrame(vectors_of(1000), "vec_id long, embedding array<double>"), str(tmp_path / "v"))
    q = spark.createDataFrame(vectors_of(1), "query_id long, query array<double>")
    found = V.search_index(spark, str(tmp_path / "v"), q, probes=2)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan and " IN (" in plan.split("PartitionFilters")[1][:200]
    assert found.count() == 10
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    V.build_index(empty, str(tmp_path / "none"))
    assert V.search_index(spark, str(tmp_path / "none"), q).collect() == []


# postings


def test_postings_follow_the_texts(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(1, 60))) for i in range(300)}
    index = str(tmp_path / "p")
    frame = lambda d: spark.createDataFrame([*d.items()], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.sample(words, 1 + i % 3))) for i in range(12)] + [(20, None), (21, "nowhere w1"), (22, "")], "query_id long, text string")
    state = dict(texts)
    for turn in range(3):
        if turn:
            state = {k: (v + " w1 w1" if k % 7 == turn else v) for k, v in state.items() if k % 11 != turn} | {1000 + turn: "w1 w2 w3", 2000 + turn: None}
        assert P.sync_postings(frame(state), index, part_docs=20) == turn + 1
        found, blocks = P.search_postings(spark, index, asked, k=5, first=1)
        want = T.bm25(frame({k: v or "" for k, v in state.items()}), asked, 5)
        plain = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["bm25"], 8), round(r["score"], 6)) for r in df.collect())
        assert plain(found) == plain(want)
        counts = blocks.collect()
        assert all(r["read"] <= r["blocks"] for r in counts) and sum(r["read"] for r in counts) < sum(r["blocks"] for r in counts)
    assert P.search_postings(spark, str(tmp_path / "none"), asked)[0].collect() == []
    assert I.last_generation(spark, index) == 3


# segments


def fit(values, ridge=1e-6):
    x = [[1, values[i - 1], values[i - 2], values[i - 3], sum(values[i - 3 : i]) / 3, abs(values[i - 1])] for i in range(3, len(values))]
    x, y = np.array(x), np.array(values[3:])
    beta = np.linalg.solve(x.T @ x + ridge * np.eye(6), x.T @ y)
    return beta, float(((y - x @ beta) ** 2).sum() / max(1, len(y) - 6))


def wave(phi, sigma, n):
    out, last = [], 0.004
    for i in range(n):
        last = phi * last + sigma * math.sin((i + 1) * 1.73)
        out.append(last)
    return out


def windows(spark, named, size, stride):
    day = dt.date(2020, 1, 1)
    rows = [(s, day + dt.timedelta(days=i), r) for s, values in named.items() for i, r in enumerate(values)]
    return S.segment_windows(spark.createDataFrame(rows, "series string, d date, r double"), size, stride)


def test_segment_coefficients(spark):
    named = {"up": wave(0.82, 0.003, 48), "down": wave(-0.7, 0.003, 48), "long": wave(0.3, 0.01, 130), "short": wave(0.3, 0.01, 20)}
    got = {(r["series"], r["w"]): r for r in G.segment_coefficients(windows(spark, named, 48, 24)).collect()}
    assert len(got) == 1 + 1 + 5
    for (s, w), r in got.items():
        start = min(24 * w, len(named[s]) - 48)
        beta, left = fit(named[s][start : start + 48])
        assert [r[x] for x in G.COEFFICIENTS] == pytest.approx(beta, abs=1e-6)
        assert r["residual_variance"] == pytest.approx(left, abs=1e-9)
    assert got["up", 0]["b1"] > 0.2 and got["down", 0]["b1"] < -0.15
    assert G.segment_coefficients(windows(spark, named, 8, 8)).collect() == []  # fewer rows than a fit needs


def clusters(vectors, k, rounds=10):
    order = sorted(vectors.values(), key=lambda v: v[1])
    centres = [np.array(order[math.floor(i * (len(order) - 1) / max(1, k - 1) + 0.5)]) for i in range(k)]
    for _ in range(rounds):
        d = {key: [float(((np.array(v) - m) ** 2).sum()) for m in centres] for key, v in vectors.items()}
        of = {key: x.index(min(x)) for key, x in d.items()}
        centres = [np.mean([vectors[key] for key in of if of[key] == i], axis=0) if i in of.values() else m for i, m in enumerate(centres)]
    heat = {key: max(1e-6, sum(x) / k) for key, x in d.items()}
    return {key: (of[key], math.sqrt(min(x)), 1 / sum(math.exp((min(x) - y) / heat[key]) for y in x)) for key, x in d.items()}


def test_clusters_of_mixed_regimes(spark):
    mixed = wave(0.82, 0.002, 64) + wave(-0.75, 0.0025, 64) + wave(0.15, 0.006, 64)
    fits = G.segment_coefficients(windows(spark, {"m": mixed}, 32, 16))
    vectors = {(r["series"], r["w"]): [r[x] for x in G.FEATURES] for r in fits.collect()}
    got = {(r["series"], r["w"]): (r["cluster"], r["distance"], r["membership"]) for r in G.cluster_segments(fits).collect()}
    want = clusters(vectors, 3)
    assert len(got) >= 10 and len({x for x, _, _ in got.values()}) >= 2
    for key, x in want.items():
        assert got[key][0] == x[0] and got[key][1:] == pytest.approx(x[1:], abs=1e-6)
    assert G.cluster_segments(fits.where("false")).collect() == []
    one = G.cluster_segments(fits.limit(1)).collect()[0]
    assert (one["cluster"], one["distance"], one["membership"]) == (0, 0.0, 1.0)


@pytest.mark.parametrize("step", [2, 16, 4096])
def test_exact_ranks(spark, step):
    rng = random.Random(6)
    values = [rng.choice([1e-9, 1e9, -5.0, 0.0]) * rng.random() for _ in range(3000)] + [7.0] * 5000 + [-0.0, 1e300, -1e300]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    order, places = sorted(values), [0, 1, 100, 1499, 3000, 5000, 8001, 8002]
    assert K.exact_ranks(df, "v", places, step) == [order[i] for i in places]


# histories


class MadeHistory(H.Provider):
    """A provider of the user's: two series without any file."""

    def parts(self):
        return [H.Part(s, y, f"{s}{y}") for s in ("a", "b") for y in (2020, 2021)]

    def read(self, part):
        yield dt.date(part.year, 3, 1), 10.0
        yield dt.date(part.year, 4, 1), None
        yield None, 5.0
        yield dt.date(part.year, 5, 1), -1.0
        yield dt.date(part.year, 6, 1), float("nan") if part.series == "b" else 11.0


def test_history_providers_agree(spark, tmp_path):
    day = dt.date(2019, 12, 20)
    rows = [(s, day + dt.timedelta(days=i), 1.5 + i + k) for k, s in enumerate(["A/B", "x y%", "Ünder=1"]) for i in range(40)]
    df = spark.createDataFrame(rows, "series string, d date, close double")
    for name in ("csv", "parquet"):
        H.write_history(df, str(tmp_path / name), name)
        got = H.read_history(spark, name, path=str(tmp_path / name))
        assert got.schema.simpleString() == "struct<series:string,d:date,close:double>"
        assert sorted(map(tuple, got.collect())) == sorted(rows)
        some = got.where((F.col("series") == "x y%") & (F.col("d") >= dt.date(2020, 1, 5)) & (F.col("close") > 30))
        assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if r[0] == "x y%" and r[1] >= dt.date(2020, 1, 5) and r[2] > 30)
        assert got.where("series = 'none'").collect() == []
    with pytest.raises(Exception, match="no provider"):
        H.read_history(spark, "other").collect()


def test_history_of_a_user(spark):
    got = H.read_history(spark, "tests.test_indexes:MadeHistory")
    assert sorted(map(tuple, got.collect())) == [("a", dt.date(y, m, 1), v) for y in (2020, 2021) for m, v in ((3, 10.0), (6, 11.0))] + [("b", dt.date(y, 3, 1), 10.0) for y in (2020, 2021)]


def test_filters_choose_parts():
    reader = H.HistoryReader({"provider": "tests.test_indexes:MadeHistory"})
    left = list(reader.pushFilters([H.EqualTo(("series",), "a"), H.GreaterThan(("d",), dt.date(2020, 12, 31)), H.GreaterThan(("close",), 3.0)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "GreaterThan"]
    assert reader.partitions() == [H.Part("a", 2021, "a2021")]


# table functions


def test_table_functions_equal_the_folds(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), t, rng.choice([None, rng.random()])) for t in range(400)]
    df = spark.createDataFrame(rows, "ticker string, horizon int, t int, residual double")
    df.createOrReplaceTempView("steps_of_test")
    assert L.register(spark) == list(L.FUNCTIONS)
    got = spark.sql("SELECT * FROM conformal_pid(TABLE(steps_of_test), lr => 0.2, target => 0.8)")
    plain = lambda x: sorted((tuple(r) for r in x.collect()), key=str)
    assert plain(got) == plain(Z.conformal_pid(df, lr=0.2, target=0.8))
    joined = spark.sql("SELECT count(*) AS n FROM conformal_pid(TABLE(SELECT * FROM steps_of_test WHERE ticker = 'a')) JOIN (SELECT 1 AS one)").first()["n"]
    assert joined == df.where("ticker = 'a' AND residual IS NOT NULL").select("horizon").distinct().count()
    for text, what in (("conformal_pid(TABLE(steps_of_test), speed => 1)", "no such argument"), ("online_brier_calibrator(TABLE(steps_of_test))", "lacks p, y"), ("conformal_pid(1)", "must be a TABLE")):
        with pytest.raises(Exception, match=what):
            spark.sql(f"SELECT * FROM {text}").collect()
