"""Queries of anchors, iterative operators and the remaining sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import anchors as N
from quillon.operators import forecast as W
from quillon.operators import learning as L
from quillon.operators import series as S
from quillon.operators import text as T
from quillon.plans.base import ORACLES, QUERIES, query, tidy, view
from quillon.plans.forecast_queries import _MIX
from quillon.plans.more_queries import _path, _round_trip
from quillon.plans.series_queries import _S, _STATES, _STEP2, _matrix, _states
from quillon.sources import chunk_index as I
from quillon.sources import readers as R
from quillon.streaming import stateful as Z

c = F.col
query("mkt_02_yes_bias_u", "v_markets", sql="SELECT market_id, round(greatest(0.001, least(0.999, CASE WHEN probability >= 1 THEN 0.999 WHEN probability < 0.05 THEN probability * 0.7 WHEN probability <= 0.15 THEN probability * (0.7 + (probability - 0.05) / 0.1 * 0.25) WHEN probability <= 0.5 THEN probability WHEN probability <= 0.85 THEN probability - 0.035 ELSE probability - 0.025 END))::DOUBLE, 8) AS p FROM {v_markets}")(lambda m: m.select("market_id", N.yes_bias_u(c("probability")).alias("p")))
query("mkt_14_extract_levels", "v_markets", sql="SELECT asset, price, round(avg(probability), 8) AS p FROM (SELECT asset, probability, (900 + market_id % 4)::DOUBLE * CASE WHEN market_id % 2 = 0 THEN 1000 ELSE 1 END AS price FROM {v_markets} WHERE market_id % 5 > 0) GROUP BY ALL")(
    lambda m: N.extract_levels(m.select("asset", "probability", F.concat(F.when(c("market_id") % 5 == 0, "Will it hit and stay above $").otherwise("Will it close above $"), (900 + c("market_id") % 4).cast("string"), F.when(c("market_id") % 2 == 0, "K").otherwise(""), F.lit(" on Friday?")).alias("question"))))
query("mkt_17_relevance", "documents", sql=r"SELECT doc_id, round(CASE WHEN regexp_matches(text, '\$[0-9,]+') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '\b(above|below|less than|more than|greater than|under|over)\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '\b(on|at)\b') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'token') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(lower(text), '\b(reach|hit|dip to|between|up or down|first)\b') THEN 3 ELSE 0 END - CASE WHEN regexp_matches(lower(text), '\b(election|sports|game|match|player|team|president|candidate)\b') THEN 5 ELSE 0 END + 4 - least(4, doc_id % 9)::DOUBLE, 8) AS score FROM documents WHERE lang = 'en'")(lambda d: d.where("lang = 'en'").select("doc_id", N.relevance(c("text"), F.lit("Token"), (c("doc_id") % 9).cast("double")).alias("score")))
query("mkt_18_anchor_trust", "v_markets", sql="SELECT market_id, round(CASE WHEN volume < 9300 THEN 0 WHEN tier = 'macro' THEN CASE WHEN age_days < 20 THEN 0.75 ELSE 1 END WHEN tier = 'electoral' THEN CASE WHEN age_days >= 20 THEN CASE WHEN days_to_expiry < 30 THEN 0.9 ELSE 0.35 END ELSE CASE WHEN days_to_expiry < 30 THEN 0.45 ELSE 0.2 END END ELSE CASE WHEN age_days >= 20 THEN CASE WHEN days_to_expiry < 30 THEN 0.9 ELSE 0.7 END ELSE CASE WHEN days_to_expiry < 30 THEN 0.7 ELSE 0.35 END END END::DOUBLE, 8) AS trust FROM {v_markets}")(
    lambda m: m.select("market_id", N.trust(F.when(c("tier") == "macro", "other").when(c("tier") == "electoral", "long_crypto").otherwise("short_crypto"), c("volume") >= 9300, c("age_days") < 20, c("days_to_expiry") < 30).alias("trust")))
query("mkt_19_off_horizon_discount", "v_markets", sql="SELECT market_id, round(probability * greatest(0.5, 1 - 0.03 * greatest(days_to_expiry - 2, 0)), 8) AS w FROM {v_markets}")(lambda m: m.select("market_id", N.off_horizon_discount(c("probability"), c("days_to_expiry")).alias("w")))
query("mkt_31_domain_recalibration", "v_markets")(lambda m: m.select("market_id", N.recalibrate(c("probability"), F.when(c("tier") == "electoral", "politics").when(c("tier") == "macro", "macro").otherwise("unknown"), c("days_to_expiry")).alias("p")))
query("mkt_34_nudge_row", "v_prices", sql=f"""WITH {_S}, {_STATES}, {_matrix()}, {_STEP2}, cur AS (SELECT series, max_by(state, d) AS here FROM st GROUP BY 1), {_MIX}, w AS (SELECT series, unnest(['bull', 'bear', 'sideways']) AS state_to, unnest([bull, bear, sideways])::DOUBLE AS want FROM mx),
    v AS (SELECT m.series, m.state_from, m.state_to, greatest(0, m.p + CASE WHEN m.state_from = here THEN 0.3::DOUBLE * (want - p4.p) ELSE 0 END) AS x FROM m JOIN cur USING (series) JOIN p4 ON p4.series = m.series AND p4.state_from = here AND p4.state_to = m.state_to JOIN w ON w.series = m.series AND w.state_to = m.state_to)
    SELECT series, state_from, state_to, round(x / sum(x) OVER (PARTITION BY series, state_from), 8) AS p FROM v""")(
    lambda p: (lambda s: N.nudge_row(S.transition_matrix(s), s.groupBy("series").agg(F.max_by("state", "d").alias("state")), W.start_state_mixture(s), 4, 60.0))(_states(p)))
query("mkt_43_two_pass_platt", "v_steps")(lambda s: L.two_pass_platt(s.select("regime", c("predicted_prob").alias("p"), "y"), iterations=15))
query("mkt_44_freeze_selection", "v_markets", sql="SELECT asset AS bundle_id, count(*) AS n, min(market_id) AS first FROM {v_markets} WHERE market_id % 3 = 0 GROUP BY 1")(lambda m: N.freeze_selection(m.select("market_id", "probability"), m.where("market_id % 3 = 0").groupBy(c("asset").alias("bundle_id")).agg(F.collect_list("market_id").alias("ids"))).select("bundle_id", "n", F.get("markets", F.lit(0)).market_id.alias("first")))
query("agg_11_mixture_crps", "v_ladder", sql="""WITH k AS (SELECT asset, max(price) FILTER (price <= 1003.3::DOUBLE) AS x0, max_by(1 - probability, price) FILTER (price <= 1003.3::DOUBLE) AS f0, min(price) FILTER (price > 1003.3::DOUBLE) AS x1, min_by(1 - probability, price) FILTER (price > 1003.3::DOUBLE) AS f1 FROM {v_ladder} GROUP BY 1),
    n AS (SELECT asset, price, 1 - probability AS f FROM {v_ladder} UNION ALL SELECT asset, 1003.3::DOUBLE, CASE WHEN x0 IS NULL THEN f1 WHEN x1 IS NULL THEN f0 ELSE f0 + (f1 - f0) * (1003.3::DOUBLE - x0) / (x1 - x0) END FROM k),
    g AS (SELECT asset, price, (f - (price >= 1003.3::DOUBLE)::INT) ** 2 AS g FROM n), h AS (SELECT asset, 0.5 * (g + lead(g) OVER w) * (lead(price) OVER w - price) AS a FROM g WINDOW w AS (PARTITION BY asset ORDER BY price)) SELECT asset, round(sum(a), 6) AS crps FROM h GROUP BY 1""")(
    lambda x: N.mixture_crps(x.select("asset").distinct().withColumn("y", F.lit(1003.3)), x.select("asset", "price", c("probability").alias("survival")), "asset").withColumn("crps", F.round("crps", 6)))
query("agg_12_tail_weighted_mixture_crps", "v_ladder")(
    lambda x: N.mixture_crps(x.select("asset").distinct().withColumn("y", F.lit(1003.3)), x.select("asset", "price", c("probability").alias("survival")), "asset").join(x.groupBy("asset").agg(F.min("price").alias("lo"), F.max("price").alias("hi")), "asset").withColumn("w", 1 + 1.645 * F.greatest(F.lit(0.0), F.abs(1003.3 - (c("lo") + c("hi")) / 2) - (c("hi") - c("lo")) / 2) / ((c("hi") - c("lo")) / 2)).agg((F.sum(c("w") * c("crps")) / F.sum("w")).alias("crps")))
query("ser_15_reversal_probability", "v_prices", sql="SELECT series, round(CASE WHEN z < 0.5 THEN 0 WHEN z < 1.5 THEN 0.4 ELSE 0.75 END * 0.4 + 0.6 * 0.95 * 0.3, 8) AS p FROM (SELECT series, round(max(close) / 200000, 6) AS z FROM {v_prices} GROUP BY 1)")(
    lambda p: W.reversal_probability(p.groupBy("series").agg(S.regime_of_pressure(F.round(F.max("close") / 200000, 6)).alias("state")).withColumns({"LOW": F.lit(0.4), "MODERATE": F.lit(0.35)}), F.lit(0.3)))
query("ser_36_excess_oos_r2", "v_prices")(lambda p: L.excess_oos_r2(S.simple_returns(p)))
query("ser_48_cross_asset_bias", "v_prices")(lambda p: L.cross_asset_bias(S.simple_returns(p), "1-URGENT", ["2-HIGH", "3-MEDIUM", "5-LOW"]))
query("ser_51_walk_forward_replay", "v_prices_short", "v_snapshots", sql="""WITH x AS (SELECT series, d, close, row_number() OVER w - 1 AS i, lead(close, 2) OVER w AS future FROM {v_prices_short} WINDOW w AS (PARTITION BY series ORDER BY d)),
    st AS (SELECT series, d, i AS step, future > close AS y FROM x WHERE i >= 10 AND (i - 10) % 3 = 0 AND future IS NOT NULL),
    up AS (SELECT st.series, st.d, step, any_value(y)::INT AS y, avg((x.future > x.close)::INT::DOUBLE) FILTER (x.i + 2 <= st.step) AS up FROM st JOIN x ON x.series = st.series AND x.i > st.step - 10 AND x.i <= st.step GROUP BY ALL),
    o AS (SELECT market_id AS key, question AS market, captured_at AS cap, max(probability) AS p FROM {v_snapshots} GROUP BY ALL),
    q AS (SELECT *, DATE '2024-01-01' + ((key * 7 + length(market)) % 30)::INT AS closes FROM o QUALIFY abs(p - lag(p) OVER (PARTITION BY key, market ORDER BY cap)) <= 0.3),
    l AS (SELECT up.series, up.d, q.market, max_by(q.p, q.cap) AS p FROM up JOIN q ON q.key = up.series AND q.cap::DATE <= up.d AND up.d <= q.closes GROUP BY ALL HAVING max(q.cap)::DATE > up.d - 5),
    m AS (SELECT series, d, avg(p) AS p, count(*) AS n FROM l GROUP BY ALL)
    SELECT up.series AS ticker, d, step AS t, y, coalesce(n, 0) AS markets, round(m.p, 8) AS market_p, round(coalesce((1 - 0.31415926::DOUBLE) * up + 0.31415926::DOUBLE * m.p, up), 8) AS blended FROM up LEFT JOIN m USING (series, d)""")(
    lambda p, s: W.walk_forward_replay(p, s.select(c("market_id").alias("key"), c("question").alias("market"), c("captured_at").alias("at"), "probability", F.date_add(F.lit("2024-01-01").cast("date"), ((c("market_id") * 7 + F.length("question")) % 30).cast("int")).alias("closes")), weight=0.31415926, shock=0.3, max_age=5, horizon=2, warmup=10, stride=3)
    .select("ticker", "d", "t", "y", F.coalesce("markets", F.lit(0)).alias("markets"), "market_p", "blended"))
query("ser_58_base_rate_floor", "v_numbered_steps", sql="SELECT ticker, horizon, t, round(greatest(0.35, 0.5 - greatest(0.05, least(0.10, 0.05 + (predicted_prob - 0.5) * 0.2))), 8) AS floor FROM {v_steps}")(lambda s: s.select("ticker", "horizon", "t", W.base_rate_floor(c("predicted_prob"), F.lit(0.5), F.lit(False))[1].alias("floor")))
query("ser_60_soft_regime", "v_prices", sql=f"WITH {_S}, {_MIX}, e AS (SELECT series, least(1, -(bull * ln(bull) + bear * ln(bear) + sideways * ln(sideways)) / ln(3)) AS e FROM mx) SELECT series, round(e::DOUBLE, 8) AS entropy, round(greatest(0.65, 1 - 0.35 * e)::DOUBLE, 8) AS confidence, round((1 + 0.35 * e)::DOUBLE, 8) AS ci_scale FROM e")(lambda p: W.soft_regime(W.start_state_mixture(_states(p))))
query("str_07_rolling_entropy_z", "v_prices", sql=ORACLES["ser_28_entropy_z"])(lambda p: S.entropy_z(p).withColumn("z", F.round("z", 6)).withColumn("scale", F.greatest(F.lit(0.7), F.least(F.lit(1.4), 1 + 0.15 * c("z")))))
query("udf_03_user_evaluator", "v_steps", sql="SELECT horizon, count(*) FILTER (confidence >= 0.5) AS sure FROM {v_steps} GROUP BY 1")(lambda s: s.transform(lambda x: x.groupBy("horizon").agg(F.count_if(c("confidence") >= 0.5).alias("sure"))))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of chunks, the second holding the first: each hash is indexed once."""
    path, docs = _path(spark, "index"), view(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.sha2("text", 256).alias("hash"))
    Z.incremental_index(chunks.where("doc_id % 2 = 0"), path)
    Z.incremental_index(chunks, path)
    return spark.read.parquet(path).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


QUERIES["str_08_incremental_index"] = lambda spark, sf_dir: tidy(_index(spark, sf_dir))
ORACLES["str_08_incremental_index"] = "SELECT sha256(text) AS hash, 1 AS n FROM documents GROUP BY 1"


def _index_in_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three syncs: drafts of even documents and files that vanish later, then the documents, then no change."""
    path, docs = _path(spark, "index-in-step"), view(spark, sf_dir, "documents").select("doc_id", "text")
    drafts = docs.select("doc_id", F.when(c("doc_id") % 2 == 0, F.concat("text", F.lit(" draft"))).otherwise(c("text")).alias("text"))
    for state in (drafts.union(docs.select(-1 - c("doc_id"), "text")), docs, docs):
        I.sync_index(state, path)
    live = I.read_index(spark, path).groupBy(c("doc_id").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return I.listed_files(spark, path).join(live.hint("merge"), "file", "left").select("file", "hash", "made", c("n").isNotNull().alias("indexed"))


QUERIES["str_08_index_in_step"] = lambda spark, sf_dir: tidy(_index_in_step(spark, sf_dir))
ORACLES["str_08_index_in_step"] = "SELECT doc_id AS file, sha256(coalesce(text, '')) AS hash, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS made, (coalesce(text, '') <> '')::INT AS indexed FROM documents"


def _write_captures(s, p):  # noqa: ANN001, ANN202
    """Two logs: every market's snapshots in captures of one day, and its events as transfers; odd markets in the wrong form."""
    day = F.date_format("captured_at", "yyyy-MM-dd")
    market = F.struct(F.when(c("event_id") % 17 > 0, c("market_id").cast("string")).otherwise(" ").alias("marketId"), "question", "probability", "volume24h")
    by_day = s.groupBy("market_id", day.alias("day"))
    by_day.agg(F.collect_list(market).alias("candidates")).select(F.concat("day", F.lit("T00:00:00Z")).alias("capturedAt"), c("market_id").cast("string").alias("ticker"), F.lit(7).alias("horizonDays"), F.array().cast("array<string>").alias("querySet"), F.array().cast("array<string>").alias("selectedMarketIds"), "candidates").write.json(f"{p}/markets")
    moved = F.struct(F.concat(F.lit("0x"), "event_id").alias("hash"), F.when(c("event_id") % 19 > 0, F.concat(day, F.lit("T00:00:00Z"))).otherwise("soon").alias("timestamp"), c("volume24h").alias("valueUsd"))
    by_day.agg(F.collect_list(moved).alias("transactions")).select(F.concat("day", F.lit("T00:00:00Z")).alias("capturedAt"), c("market_id").cast("string").alias("ticker"), F.lit("chain").alias("source"), *[F.lit("2024-05-01T00:00:00Z").alias(x) for x in ("observationWindowStart", "observationWindowEnd")], "transactions").write.json(f"{p}/whales")


def _read_captures(spark, p):  # noqa: ANN001, ANN202
    markets = R.read_raw_markets(spark, f"{p}/markets")[0].select(F.lit("market").alias("kind"), "ticker", F.left("capturedAt", F.lit(10)).alias("day"), F.size("candidates").alias("n"), F.aggregate("candidates", F.lit(0.0), lambda a, m: a + m.probability).alias("total"))
    whales = R.read_raw_whales(spark, f"{p}/whales")[0].select(F.lit("whale").alias("kind"), "ticker", F.left("capturedAt", F.lit(10)).alias("day"), F.size("transactions").alias("n"), F.aggregate("transactions", F.lit(0.0), lambda a, t: a + t.valueUsd).alias("total"))
    return markets.unionByName(whales).withColumn("total", F.round("total", 6))


_round_trip("src_05_raw_captures", "v_snapshots", _write_captures, _read_captures,
    """WITH g AS (SELECT market_id::VARCHAR AS ticker, strftime(captured_at, '%Y-%m-%d') AS day, count(*)::INT AS n, sum(probability) AS p, sum(volume24h) AS v, bool_and(event_id % 17 > 0 AND volume24h >= 0) AS market, bool_and(event_id % 19 > 0) AS whale FROM {v_snapshots} GROUP BY ALL)
    SELECT 'market' AS kind, ticker, day, n, round(p, 6) AS total FROM g WHERE market UNION ALL SELECT 'whale', ticker, day, n, round(v, 6) FROM g WHERE whale""")
_round_trip("src_19_filing_feed", "pages",
    lambda g, p: g.select(F.expr("page_id div 100").alias("k"), F.concat(F.lit("<entry><title>page "), "page_id", F.lit('</title><updated>2024-05-01T00:00:00Z</updated><link href="/p/'), "page_id", F.lit('"/></entry>')).alias("e")).groupBy("k").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list("e"), ""), F.lit("</feed>")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(p),
    lambda s, p: R.parse_filing_feed(s, p),
    "SELECT '/p/' || page_id AS url, '2024-05-01' AS date, 'page ' || page_id AS title FROM pages")
query("mkt_45_promote_gate", "v_steps", sql="SELECT ticker, (avg((predicted_prob - y) ** 2) < 0.35)::INT AS passes FROM {v_steps} GROUP BY 1")(lambda s: s.groupBy("ticker").agg((F.avg(F.pow(c("predicted_prob") - c("y"), 2)) < 0.35).alias("passes")))
