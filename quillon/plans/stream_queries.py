"""Queries of sources, streams and stateful operators over the test tables."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.base import ORACLES, QUERIES, duck, query, shared_folder, tidy
from quillon.sources import readers as R
from quillon.streaming import rolling as O
from quillon.streaming import stateful as S

c = F.col

_RAW = "SELECT user_id, event_id, ts, value / 400 AS probability, value * 1000 - 5000 AS volume24h, CASE WHEN event_id % 11 = 0 THEN '' ELSE user_id::VARCHAR END AS market_id, event_id % 13 = 0 AS bad_end FROM events"


def _raw(e):  # noqa: ANN001, ANN202
    return e.select(F.when(c("event_id") % 11 == 0, "").otherwise(c("user_id").cast("string")).alias("marketId"), c("event_type").alias("question"), (c("value") / 400).alias("probability"), (c("value") * 1000 - 5000).alias("volume24h"), F.when(c("event_id") % 13 == 0, "soon").otherwise("").alias("endDate"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("capturedAt"), (c("value") / 300).alias("bid"), F.lit(None).cast("double").alias("ask"), "event_id")


def _clean(e):  # noqa: ANN001, ANN202
    good, _ = R.clean_snapshots(_raw(e))
    return good.select("marketId", "probability", "volume24h", "bid", F.date_format("capturedAt", "yyyy-MM-dd HH:mm:ss").alias("at"))


query("src_01_read_snapshots", "events", sql=f"WITH x AS ({_RAW}) SELECT market_id AS \"marketId\", round(probability, 8) AS probability, round(volume24h, 8) AS volume24h, round(CASE WHEN probability * 400 / 300 <= 1 THEN probability * 400 / 300 END, 8) AS bid, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM x WHERE market_id <> '' AND probability <= 1 AND volume24h >= 0 AND NOT bad_end")(_clean)
query("src_03_project_snapshot", "v_markets", sql="SELECT market_id::VARCHAR AS \"marketId\", round(probability, 8) AS probability, '2024-01-01' AS day FROM {v_markets} WHERE market_id % 7 > 0")(
    lambda m: R.project_snapshot(m.select(F.when(c("market_id") % 7 > 0, c("market_id").cast("string")).alias("marketId"), c("asset").alias("question"), "probability", c("volume").alias("volume24h"), F.lit(None).cast("string").alias("endDate")), "2024-01-01").select("marketId", "probability", F.date_format("capturedAt", "yyyy-MM-dd").alias("day")))
query("src_07_normalize_price_history", "v_prices", sql="SELECT series, d, round(close, 6) AS price FROM {v_prices} WHERE close > 0")(
    lambda p: R.normalize_price_history(p.groupBy("series").agg(F.collect_list(F.struct(c("d").cast("string").alias("d"), "close")).alias("x")).select("series", F.expr("cast(null as array<struct<at:string,price:double>>)").alias("points"), F.expr("cast(null as array<struct<time:string,date:string,at:string,close:double,price:double>>)").alias("bars"), F.transform("x", lambda y: y.d).alias("dates"), F.transform("x", lambda y: y.close).alias("closes"))).select("series", F.to_date("at").alias("d"), F.round("price", 6).alias("price")))
query("src_08_resolve_series_key", "part", sql="SELECT DISTINCT p_brand AS key, CASE WHEN p_brand LIKE '%1' THEN p_brand || '-USD' ELSE p_brand END AS series FROM part")(
    lambda p: R.resolve_series_key(p.select(c("p_brand").alias("key")).distinct(), p.select(F.when(c("p_brand").endswith("1"), F.concat("p_brand", F.lit("-USD"))).otherwise(c("p_brand")).alias("series"))))
query("src_09_latest_value", "v_prices", sql="SELECT series, max(d) AS date, round(max_by(close, d), 6) AS value FROM {v_prices} WHERE close < 250000 GROUP BY 1")(lambda p: R.latest_value(p.select("series", c("d").alias("date"), F.when(c("close") < 250000, c("close")).alias("value")), "series").withColumn("value", F.round("value", 6)))
query("src_11_prefer_source", "orders", sql="""WITH t AS (SELECT o_custkey AS ticker, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS priority FROM orders), n AS (SELECT ticker, min(priority) AS priority FROM (SELECT ticker, priority FROM t GROUP BY ALL HAVING count(*) >= 4) GROUP BY 1) SELECT ticker, o_orderkey, priority FROM t JOIN n USING (ticker, priority)""")(
    lambda o: R.prefer_source(o.select(c("o_custkey").alias("ticker"), "o_orderkey", F.when(c("o_orderstatus") == "F", 1).when(c("o_orderstatus") == "O", 2).otherwise(3).alias("priority"), c("o_totalprice").alias("close")), 4).select("ticker", "o_orderkey", "priority"))
query("src_16_parse_event_payload", "events", sql="SELECT event_id, event_type AS title, round(CASE WHEN value > 1 THEN value / 100 ELSE value END, 8) AS p, 'buy' AS event_class FROM events WHERE value <= 100 AND event_type LIKE '%purchase%' UNION ALL SELECT event_id, event_type, round(CASE WHEN value > 1 THEN value / 100 ELSE value END, 8), 'look' FROM events WHERE value <= 100 AND event_type LIKE '%view%'")(
    lambda e: R.parse_event_payload(e.select("event_id", F.to_json(F.struct(F.array(F.struct(c("event_type").alias("title"), c("value").alias("price"))).alias("markets"))).alias("payload")).where("payload is not null"), {"buy": "purchase", "look": "view"}).select("event_id", "title", "p", "event_class"))
query("src_17_parse_tick_payload", "events", sql="SELECT user_id AS market_id, floor(epoch(ts))::BIGINT AS t_sec, round(value / 500, 8) AS p FROM events WHERE value <= 500")(
    lambda e: R.parse_tick_payload(e.groupBy(c("user_id").alias("market_id")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.unix_seconds("ts").alias("t"), (c("value") / 500).alias("p"))).alias("history"))).alias("payload"))))
query("src_18_parse_outcome_arrays", "v_markets", sql="SELECT market_id, round(probability, 8) AS yes FROM {v_markets}")(
    lambda m: R.parse_outcome_arrays(m.select("market_id", F.lit('["No", "Yes"]').alias("outcomes"), F.to_json(F.array((1 - c("probability")).cast("string"), c("probability").cast("string"))).alias("prices"))).select("market_id", "yes"))
query("flt_08_sample_rows", "orders", sql="SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500")(lambda o: R.sample_rows(o, 500, "o_orderkey").select("o_orderkey"))
query("str_05_score_conformal", "v_numbered_steps", sql="""WITH x AS (SELECT ticker, horizon, t, list(abs(actual_return - predicted_return) * 10) OVER (PARTITION BY ticker, horizon ORDER BY t ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS b FROM {v_steps}) SELECT ticker, horizon, t, round(greatest(1, coalesce(list_sort(b)[greatest(ceil(len(b) * 0.9), 1)::INT], 1))::DOUBLE, 8) AS factor FROM x""")(lambda s: S.score_conformal(s.withColumn("score", F.abs(c("actual_return") - c("predicted_return")) * 10), block=8192))
query("str_02_adwin", "v_prices")(lambda p: S.adwin_batch(p.select("series", "d", F.log("close").alias("x"))))
_DAY = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL"
query("str_09_tumbling_stats", "events", sql=_DAY)(lambda e: S.windowed_event_stats(e).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean")))
query("str_09_sliding_stats", "events", sql="SELECT strftime(date_trunc('day', ts) - k * INTERVAL 1 DAY, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events CROSS JOIN range(7) x(k) GROUP BY ALL")(lambda e: S.windowed_event_stats(e, "7 days", "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean")))
query("str_11_latest_price_state", "events", sql="SELECT user_id, max_by(value, (ts, event_id)) AS price FROM events GROUP BY 1")(S.latest_price_state)


def _drained(spark: SparkSession, sf_dir: str, build, mode: str) -> DataFrame:  # noqa: ANN001
    """Run a stream over the events table to its end and read what it wrote from the shared folder."""
    out = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(sf_dir, pathGlobFilter="events.parquet")
    events = source.select(*[c(x).cast("timestamp").alias(x) if t == "timestamp_ntz" else c(x) for x, t in source.dtypes])
    run = build(events).writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    if mode == "append":
        run.format("parquet").option("path", out).start().awaitTermination()
    else:
        run.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


def _stream_query(name: str, build, mode: str, shape, sql: str | None) -> None:  # noqa: ANN001
    QUERIES[name] = lambda spark, sf_dir: tidy(shape(_drained(spark, sf_dir, build, mode)))
    if sql:
        ORACLES[name] = duck(sql)


_stream_query("str_01_stream_snapshots", lambda e: S.stream_snapshots(_raw(e)), "append", lambda d: d.select("marketId", "probability", F.date_format("capturedAt", "yyyy-MM-dd HH:mm:ss").alias("at")),
    f"WITH x AS ({_RAW.replace('SELECT ', 'SELECT event_type, ', 1)}), s AS (SELECT DISTINCT market_id, event_type, probability, volume24h, date_trunc('second', ts) AS moment FROM x WHERE market_id <> '' AND probability <= 1 AND volume24h >= 0 AND NOT bad_end) SELECT market_id AS \"marketId\", round(probability, 8) AS probability, strftime(moment, '%Y-%m-%d %H:%M:%S') AS at FROM s")
_stream_query("str_09_stream_stats", lambda e: S.windowed_event_stats(e, watermark="1 hour"), "complete", lambda d: d.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean")), _DAY)
_stream_query("str_11_stream_latest_price", S.latest_price_state, "complete", lambda d: d, "SELECT user_id, max_by(value, (ts, event_id)) AS price FROM events GROUP BY 1")


_ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rolling(rule: O.Rolling):  # noqa: ANN202
    """Scores of every user's values over the drained stream, which holds list state: the session's store is set for the run."""

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = spark.conf.get(_ROCKS[0], None)
        spark.conf.set(*_ROCKS)
        try:
            rows = _drained(spark, sf_dir, lambda e: O.rolling_stream(e.select(c("user_id").cast("string").alias("series"), c("ts").alias("at"), c("value").alias("x")), rule), "append")
        finally:
            spark.conf.set(_ROCKS[0], before) if before else spark.conf.unset(_ROCKS[0])
        return tidy(rows.select("series", F.unix_micros("at").alias("us"), F.round("score", 6).alias("score")))

    return go


def _rolling_sql(size: int, days: int, score: str) -> str:
    # the stream's rows are those that its watermark, a day behind the newest event, has passed
    return f"""WITH r AS (SELECT user_id::VARCHAR AS series, epoch_us(ts) AS us, min(value) AS x FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
    h AS (SELECT *, list({{'us': us, 'x': x}}) OVER (PARTITION BY series ORDER BY us ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING) AS held, max(us) OVER () AS newest FROM r),
    k AS (SELECT series, us, x, newest, coalesce([v.x FOR v IN held IF v.us >= us - {days * 86_400_000_000}], []) AS b FROM h)
    SELECT series, us, round({score}, 6) AS score FROM k WHERE us // 1000 < newest // 1000 - 86400000"""


QUERIES["str_07_stream_entropy_z"] = _rolling(O.rolling_z(60, pd.Timedelta(days=10)))
ORACLES["str_07_stream_entropy_z"] = _rolling_sql(60, 10, "CASE WHEN len(b) < 5 OR list_stddev_pop(b) < 1e-12 THEN 0 ELSE (x - list_avg(b)) / list_stddev_pop(b) END::DOUBLE")
QUERIES["str_05_stream_quantile"] = _rolling(O.rolling_quantile(50, pd.Timedelta(days=10)))
ORACLES["str_05_stream_quantile"] = _rolling_sql(50, 10, "greatest(1, coalesce(list_sort(b)[greatest(ceil(len(b) * 0.9), 1)::INT], 1))::DOUBLE")


def _positions(customers: DataFrame) -> DataFrame:
    return customers.where("c_custkey % 2 = 0").select(c("c_custkey").cast("long").alias("user_id"), (c("c_custkey") % 7 + 1).cast("double").alias("quantity"))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of ticks against the positions, in update mode: the last update of every day and user."""
    out = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(sf_dir, pathGlobFilter="events.parquet")
    events = source.select(*[c(x).cast("timestamp").alias(x) if t == "timestamp_ntz" else c(x) for x, t in source.dtypes])
    rows = S.valued_positions(events, _positions(spark.read.parquet(f"{sf_dir}/customer.parquet")))
    run = rows.writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    run.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}-{uuid.uuid4().hex}")).start().awaitTermination()
    last = spark.read.option("recursiveFileLookup", "true").parquet(out).groupBy("day", "user_id").agg(F.max_by(F.struct("price", "value", "ticks"), "batch").alias("x"))
    return last.select("day", "user_id", "x.*")


_VALUED = """SELECT ts::DATE AS day, user_id, max_by(value, (ts, event_id)) AS price, max_by(value, (ts, event_id)) * (user_id % 7 + 1) AS value, count(*) AS ticks
    FROM events JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0 GROUP BY ts::DATE, user_id"""
query("str_11_valued_positions", "events", "customer", sql=_VALUED)(lambda e, k: S.valued_positions(e, _positions(k)))
QUERIES["str_11_stream_positions"] = lambda spark, sf_dir: tidy(_updates(spark, sf_dir))
ORACLES["str_11_stream_positions"] = duck(_VALUED)
