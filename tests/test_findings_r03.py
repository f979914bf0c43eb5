"""Small tables on which the queries of the third round's findings failed."""

import datetime as dt
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import table_functions as L
from quillon.operators import ablation as B
from quillon.operators import anchors as N
from quillon.operators import filters as X
from quillon.operators import forecast as W
from quillon.operators import segments as G
from quillon.operators import postings as P
from quillon.operators import ranks as K
from quillon.operators import series as S
from quillon.operators import text as T
from quillon.plans import QUERIES
from quillon.plans.base import view
from quillon.sources import readers as R
from quillon.streaming import folds as Z
from quillon.streaming import stateful as U

c = F.col


def _prices(spark, closes):
    return spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(closes)], "series string, d date, close double")


def test_returns_after_a_price_of_zero(spark):
    rows = [r.r for r in S.simple_returns(_prices(spark, [1, 0, 2, 0, 0])).orderBy("d").collect()]
    assert rows[:3] == [-1.0, math.inf, -1.0] and math.isnan(rows[3])


def test_walk_forward_meets_prices_of_zero(spark):
    rows = W.walk_forward(_prices(spark, [0, 1, 0, 0, 2, 0, 3, 1]), horizon=1, warmup=4, stride=1).orderBy("t").collect()
    assert [(r.t, r.y, r.predicted_prob, r.actual_return) for r in rows] == [(4, 0, 1 / 3, -1.0), (5, 1, 1 / 3, None), (6, 0, 2 / 3, 1 / 3 - 1)]


def test_clusters_of_rows_that_differ_each_time_they_are_made(spark):
    noise = F.expr("cast(reflect('java.lang.Math', 'random') as double)") * 1e-9  # stands for float sums, which depend on the order of arrival
    rows = spark.range(40).select(c("id").alias("series"), F.lit(0).alias("w"), *[(c("id") % 3 * 5 + c("id") / 100 + noise).alias(x) for x in G.FEATURES])
    found = {r.series: r.cluster for r in G.cluster_segments(rows).collect()}
    assert len(found) == 40 and len({(k % 3, v) for k, v in found.items()}) == 3


def test_words_end_at_accented_letters(spark):
    rows = spark.createDataFrame([("até",), ("date",), ("at",)], "q string")
    assert [r.p for r in rows.select(N.relevance(c("q"), F.lit("token"), F.lit(9.0)).alias("p")).collect()] == [1.0, 0.0, 1.0]


def test_csv_keeps_blanks_at_the_ends(spark, tmp_path):
    R.export_rows(spark.createDataFrame([(1, " a "), (2, "b\t")], "k int, t string"), f"{tmp_path}/out", "csv")
    assert sorted(tuple(r) for r in spark.read.schema("k int, t string").option("header", True).csv(f"{tmp_path}/out").collect()) == [(1, " a "), (2, "b\t")]


def test_repeats_of_a_snapshot_are_equal_in_every_column(spark, tmp_path):
    row = lambda p: ("m", "q", p, 1.0, "", "2024-01-01 00:00:00", None, None)
    shape = "marketId string, question string, probability double, volume24h double, endDate string, capturedAt string, bid double, ask double"
    spark.createDataFrame([row(0.5), row(0.5), row(0.25)], shape).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = U.stream_snapshots(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.probability for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0.25, 0.5]


def test_questions_match_inside_words_and_long_runs(spark):
    long = "7" * 250 + "solarpanels" + "8" * 600 + "windmill"
    docs = spark.createDataFrame([(1, "a SOLAR-panel, 2024"), (1, "a SOLAR-panel, 2024"), (2, long), (3, None), (4, ""), (5, "prices of a windmil"), (5, "Éwindmill")], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "solar panels"), (2, "the price"), (3, "of the"), (4, "windmill?"), (5, None)], "item_id long, text string")
    every = docs.join(questions.select("item_id", X.query_words(c("text")).alias("ws")), how="cross").where(X.question_matches(c("text"), c("ws"))).select("doc_id", "item_id")
    found = sorted(map(tuple, X.matching_questions(docs, questions).collect()))
    assert found == sorted(map(tuple, every.collect())) and (2, 1) in found and (2, 4) in found


def test_vector_search_meets_parts_and_blocks_as_matrices(spark, monkeypatch):
    monkeypatch.setattr(T, "PART_ROWS", 16)  # several parts
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None), (62, [1.0]), (63, [1.0, None, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 5 = 0 or vec_id > 59").select(c("vec_id").alias("query_id"), c("embedding").alias("query"))
    found = T.vector_search(v, q, 10, block=4)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()  # pairs are no rows of Spark

    def unit(x):
        length = sum(y * y for y in x) ** 0.5 if x and None not in x else 0
        return x and [y / length if length else 0.0 for y in x]

    units = [(i, unit(x)) for i, x in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) if a and b and len(a) == len(b) else 0.0
    want = {i: [j for _, j in sorted((-round(dot(a, b), 9), j) for j, b in units)[:10]] for i, a in units if i % 5 == 0 or i > 59}
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want


def test_postings_take_the_largest_text_of_a_repeated_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "gamma beta"), (1, "alpha beta"), (2, "beta beta"), (2, "beta beta"), (3, None), (None, "x")], "doc_id long, text string")
    P.sync_postings(docs, f"{tmp_path}/index")
    stored = spark.read.parquet(f"{tmp_path}/index/postings")
    assert sorted((r.term, list(r.ids), list(r.tfs)) for r in stored.collect()) == [("beta", [1, 2], [1, 2]), ("gamma", [1], [1])]
    assert sorted((r.doc_id, r["size"]) for r in spark.read.parquet(f"{tmp_path}/index/sizes").collect()) == [(1, 2), (2, 2), (3, 0)]


def test_bm25_pairs_documents_with_queries_by_the_rarest_word(spark):
    docs = spark.createDataFrame([(i, "common word" + (" rare" if i % 10 == 0 else "")) for i in range(100)] + [(100, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "common rare word"), (2, "common absent"), (3, "")], "query_id long, text string")
    found = T.bm25(docs, queries)
    assert [(r.query_id, r.doc_id, r.rank) for r in found.orderBy("rank").collect()] == [(1, 10 * i, i + 1) for i in range(10)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rare#" in plan  # words are not joined with queries one by one


def test_steps_are_numbered_in_blocks(spark, sf_dir):
    rows = [(k, d, i) for k in ("a", None) for d in (None, 1, 1, 3, 7, 7, 7) for i in (2, 1, None)]
    data = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "k string, d int, i int, n int")
    whole = data.withColumn("t", F.row_number().over(Window.partitionBy("k").orderBy("d", "i", "n")))
    found = K.numbered(data, ("k",), ("d", "i", "n"))
    assert found.columns == whole.columns and found.count() == len(rows) and found.exceptAll(whole).isEmpty()
    # no step of the named queries is numbered by a window over a whole key
    plan = QUERIES["top_06_max_confidence"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(l_linestatus" in plan and "row_number() windowspecdefinition(l_linestatus" not in re.sub(r"#\d+L?", "", plan).replace("windowspecdefinition(l_linestatus, l_linenumber, l_shipdate, ", "")
    assert view(spark, sf_dir, "v_numbered_steps").exceptAll(view(spark, sf_dir, "v_steps")).isEmpty()


def test_weights_of_many_rows_are_those_of_md5():
    names = [f"7|{x}|{i}" for i in range(700) for x in ("F", "é", None)] + ["x" * n for n in range(45, 70)]  # also beyond one block
    for replicates in (1, 50, 200):
        raw = [b"".join(hashlib.md5(f"{name}|{i}".encode()).digest() for i in range(-(-replicates // 4))) for name in names]
        u = (np.stack([np.frombuffer(x, ">u4")[:replicates] for x in raw]) + 0.5) / 2.0**32
        assert (B.drawn_weights(names, replicates) == np.searchsorted(B._POISSON, u, side="right")).all()
    assert B.drawn_weights([], 5).shape == (0, 5)


def test_folds_travel_in_packs(spark):
    count = 3 * Z.PACK + 5
    steps = spark.range(2 * count).select(F.when(c("id") % 2 == 0, "a").alias("ticker"), F.lit(None).cast("int").alias("horizon"), F.floor(c("id") / 4).alias("t"), (F.abs(F.sin(c("id") / 2 - c("id") % 2)) / 5).alias("residual"))
    fold = Z.pid_fold()
    met = {r.ticker: (r.radius, r.coverage) for r in Z.fold_table(steps, fold).collect()}
    assert len(met) == 2
    for ticker in ("a", None):
        state = fold.zero
        for r in sorted(((r.t, r.residual) for r in steps.collect() if r.ticker == ticker)):
            state = fold.step(state, r[1])
        assert met[ticker] == fold.finish(state)
    packs = Z._packed(Z._complete(steps, fold).withColumn("_key", F.to_json(F.struct(*Z.KEYS))), fold)
    assert packs.count() < count / 50  # no single steps


def test_rolling_scores_in_blocks(spark):
    steps = spark.range(240).select((c("id") % 2).cast("string").alias("ticker"), F.lit(1).alias("horizon"), (F.floor(c("id") / 2) + 1).alias("t"), (F.abs(F.sin("id")) * 3).alias("score"))
    whole = U.score_conformal(steps, 5)
    for block in (5, 7, 64, 1000):
        found = U.score_conformal(steps, 5, block=block)
        assert found.count() == 240 and found.exceptAll(whole).isEmpty()


def test_table_functions_take_packs(spark):
    steps = spark.range(1500).select(
        F.when(c("id") % 3 > 0, "a").alias("ticker"), F.when(c("id") % 3 > 1, 1).alias("horizon"), F.floor(c("id") / 6).alias("t"),  # two rows of one t
        F.when(c("id") % 11 > 0, F.abs(F.sin("id")) / 5).alias("residual"), F.when(c("id") % 7 > 0, F.abs(F.cos("id"))).alias("rv"), F.when(c("id") % 5 > 0, c("id") % 97 < 3).alias("is_break"),
    )
    extra = spark.createDataFrame([("none", 1, 1, None, 1.0, True), ("null t", None, None, 0.1, None, None), ("null t", None, 2, 0.3, 0.5, None)], steps.schema)
    every = steps.unionByName(extra)
    every.createOrReplaceTempView("steps_to_pack")
    L.register(spark)
    plain = lambda x: sorted((tuple(r) for r in x.collect()), key=str)
    want = plain(Z.adaptive_conformal(every, cooloff=3))
    assert len(want) == 4
    for pack in (1, 7, Z.PACK):
        packs = L.packed_sql("steps_to_pack", {x: x for x in ("residual", "rv", "is_break")}, pack)
        assert spark.sql(packs).count() < every.count() / min(2, pack)
        assert plain(spark.sql(f"SELECT * FROM adaptive_conformal(TABLE({packs}), cooloff => 3)")) == want
    whole = "SELECT ticker, horizon, 1 AS t, {} FROM VALUES ('a', 1) AS r(ticker, horizon)"
    no_rv = spark.sql(f"SELECT radius FROM adaptive_conformal(TABLE({whole.format('array(0.5D, NULL, 0.25D) AS residual, CAST(NULL AS array<double>) AS rv, array(true, true, false) AS is_break')}))").first()["radius"]
    state, fold = Z.break_fold().zero, Z.break_fold()
    for x, flag in ((0.5, 1.0), (0.25, 0.0)):
        state = fold.step(state, x, 0.0, flag)
    assert no_rv == fold.finish(state)[0]
    with pytest.raises(Exception, match="or none must be arrays"):
        spark.sql(f"SELECT * FROM adaptive_conformal(TABLE({whole.format('array(0.5D) AS residual, 0.1D AS rv, true AS is_break')}))").collect()


@pytest.mark.parametrize("name", ["udf_06_sql_conformal", "udf_06_sql_break_mode"])
def test_table_functions_of_queries_meet_packs(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(" in plan[plan.index("PythonUDTF"):]  # no single steps
