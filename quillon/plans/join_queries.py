"""Queries of joins, filters, top-k and deduplication, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import filters as Y
from quillon.operators import joins as J
from quillon.plans.base import query

c = F.col
_TS = "date_trunc('second', captured_at)"

query("join_01_asof_snapshot", "v_snapshots", sql="""WITH d AS (SELECT DISTINCT market_id, CAST(captured_at AS DATE)::TIMESTAMP AS at FROM {v_snapshots}), s AS (SELECT market_id, captured_at AS at, max(probability) AS probability FROM {v_snapshots} GROUP BY ALL)
    SELECT d.market_id, CAST(d.at AS DATE) AS day, round(s.probability, 8) AS probability FROM d ASOF LEFT JOIN s ON d.market_id = s.market_id AND d.at >= s.at""")(
    lambda s: J.asof(s.select("market_id", F.to_date("captured_at").cast("timestamp").alias("at")).distinct(), s.groupBy("market_id", c("captured_at").alias("at")).agg(F.max("probability").alias("probability")), "market_id", "at", "probability").select("market_id", F.to_date("at").alias("day"), "probability"))
query("join_02_snapshot_in_window", "v_snapshots", sql="""SELECT a.event_id, a.market_id, round(max_by(b.probability, b.captured_at), 8) AS probability FROM {v_snapshots} a LEFT JOIN {v_snapshots} b ON a.market_id = b.market_id AND b.captured_at BETWEEN a.captured_at - INTERVAL 48 HOUR AND a.captured_at - INTERVAL 24 HOUR GROUP BY ALL""")(
    lambda s: J.snapshot_in_window(s.select("event_id", "market_id", c("captured_at").alias("l_at")), s.select("market_id", "captured_at", "probability"), "market_id", "captured_at", "probability", 48 * 3600, 24 * 3600, "event_id").select("event_id", "market_id", "probability"))
_PREV = "o AS (SELECT market_id, question, captured_at, max(probability) AS probability FROM {v_snapshots} GROUP BY ALL), p AS (SELECT *, lag(probability) OVER (PARTITION BY market_id, question ORDER BY captured_at) AS previous FROM o)"
query("join_03_previous_observation", "v_snapshots", sql=f"WITH {_PREV} SELECT market_id, question, strftime(captured_at, '%Y-%m-%d %H:%M:%S.%f') AS at, round(probability, 8) AS probability, round(previous, 8) AS previous FROM p")(
    lambda s: J.previous_observation(s, "market_id", "question", at="captured_at", value="probability").select("market_id", "question", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "probability", "previous"))
query("join_04_quality_filter", "v_snapshots", sql=f"WITH {_PREV} SELECT market_id, question, strftime(captured_at, '%Y-%m-%d %H:%M:%S.%f') AS at, round(probability, 8) AS probability FROM p WHERE abs(probability - previous) <= 0.05")(
    lambda s: J.quality_filter(s, "market_id", "question", at="captured_at", value="probability", shock=0.05).select("market_id", "question", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "probability"))


def _targets(o):  # noqa: ANN001, ANN202
    return o.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("captured")).withColumn("target", F.date_add("captured", 365))


def _path(o):  # noqa: ANN001, ANN202
    return o.select("o_custkey", F.to_date("o_orderdate").alias("at"), c("o_totalprice").alias("price"))


_TG = "t AS (SELECT o_custkey, min(o_orderdate)::DATE AS captured, min(o_orderdate)::DATE + 365 AS target FROM orders GROUP BY 1)"
query("join_05_settlement_price", "orders", sql=f"WITH {_TG} SELECT t.o_custkey, target, round(coalesce(min_by(o_totalprice, (o_orderdate, o_totalprice)) FILTER (o_orderdate::DATE >= target), max_by(o_totalprice, (o_orderdate, o_totalprice))), 8) AS settled FROM t JOIN orders o USING (o_custkey) GROUP BY ALL")(lambda o: J.settlement(_targets(o).drop("captured"), _path(o), "o_custkey"))
query("join_06_path_in_window", "orders", sql=f"WITH {_TG} SELECT t.o_custkey, captured, target, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS points FROM t JOIN orders o ON o.o_custkey = t.o_custkey AND o_orderdate::DATE BETWEEN captured AND target GROUP BY ALL")(lambda o: J.path_in_window(_targets(o), _path(o), "o_custkey"))
query("join_07_merge_levels", "v_ladder", sql="""WITH l AS (SELECT asset, price, probability AS p FROM {v_ladder} WHERE floor(price)::INT % 2 = 0), r AS (SELECT asset, price, probability * 0.9::DOUBLE AS p FROM {v_ladder} WHERE floor(price)::INT % 2 = 1),
    n AS (SELECT l.asset, l.price AS lp, l.p AS l_p, r.price AS rp, r.p AS r_p FROM l JOIN r ON l.asset = r.asset AND abs(l.price - r.price) <= 0.02::DOUBLE * l.price QUALIFY row_number() OVER (PARTITION BY l.asset, l.price ORDER BY abs(l.price - r.price), r.price) = 1)
    SELECT asset, lp AS price, round((l_p + r_p) / 2 * 0.95::DOUBLE, 8) AS p, 'both' AS side, (abs(l_p - r_p) > 0.05::DOUBLE)::INT AS warn FROM n UNION ALL SELECT asset, price, round(p, 8), 'left', 0 FROM l WHERE NOT EXISTS (FROM n WHERE n.asset = l.asset AND n.lp = l.price)
    UNION ALL SELECT asset, price, round(p, 8), 'right', 0 FROM r WHERE NOT EXISTS (FROM n WHERE n.asset = r.asset AND n.rp = r.price)""")(
    lambda x: J.merge_levels(x.where("floor(price) % 2 = 0").select("asset", "price", c("probability").alias("p")), x.where("floor(price) % 2 = 1").select("asset", "price", (c("probability") * 0.9).alias("p"))))


def _records(o):  # noqa: ANN001, ANN202
    return o.groupBy(F.year("o_orderdate").alias("year"), (c("o_custkey") % 25).alias("nation")).agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).cast("double").alias("orders"))


query("join_08_cross_validate", "orders", sql="""WITH a AS (SELECT year(o_orderdate)::INT AS year, o_custkey % 25 AS nation, sum(o_totalprice) AS revenue, count(*)::DOUBLE AS orders FROM orders GROUP BY ALL), b AS (SELECT year, nation, revenue * (1 + nation / 100.0::DOUBLE) AS revenue, orders FROM a)
    SELECT a.year, a.nation, 'revenue' AS metric, round(a.revenue, 4) AS p, round(b.revenue, 4) AS s, round(abs(a.revenue - b.revenue) / a.revenue, 8) AS gap FROM a JOIN b USING (year, nation) WHERE abs(a.revenue - b.revenue) / a.revenue > 0.155""")(
    lambda o: J.cross_validate(_records(o), _records(o).withColumn("revenue", c("revenue") * (1 + c("nation") / 100)), ["year", "nation"], ["revenue", "orders"], 0.155).withColumns({"p": F.round("p", 4), "s": F.round("s", 4)}))
query("join_09_dimension_lookup", "orders", "customer", sql="SELECT o_orderkey, coalesce(c_mktsegment, 'other') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey")(lambda o, k: J.dimension_join(o, k.where("c_custkey % 3 > 0").select(c("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("other")).alias("segment")))


def _watchlist(o, p):  # noqa: ANN001, ANN202
    last = p.groupBy(c("series").alias("ticker")).agg(F.max_by("close", "d").alias("price"))
    held = o.groupBy(c("o_custkey").alias("owner"), c("o_orderpriority").alias("ticker")).agg(F.avg("o_totalprice").alias("cost"), F.count(F.lit(1)).alias("shares"))
    return J.watchlist(held, last).select("owner", "ticker", *[F.round(x, 4).alias(x) for x in ("pnl", "return_pct", "value", "allocation")])


query("join_10_watchlist", "orders", "v_prices", sql="""WITH p AS (SELECT series AS ticker, max_by(close, d) AS price FROM {v_prices} GROUP BY 1), h AS (SELECT o_custkey AS owner, o_orderpriority AS ticker, avg(o_totalprice) AS cost, count(*) AS shares FROM orders GROUP BY ALL)
    SELECT owner, ticker, round((price - cost) * shares, 4) AS pnl, round((price - cost) / cost * 100, 4) AS return_pct, round(price * shares, 4) AS value, round(price * shares / sum(price * shares) OVER (PARTITION BY owner) * 100, 4) AS allocation FROM h JOIN p USING (ticker)""")(_watchlist)
query("join_11_related_rows", "orders", sql="SELECT DISTINCT node, other, strftime(created, '%Y-%m-%d') AS day FROM (SELECT o_custkey AS node, o_orderkey AS other, o_orderdate AS created FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderdate FROM orders)")(lambda o: J.related(o.select(c("o_custkey").alias("source"), c("o_orderkey").alias("target"), c("o_orderdate").alias("created"))).select("node", "other", F.date_format("created", "yyyy-MM-dd").alias("day")))


def _tokens(x):  # noqa: ANN001, ANN202
    return F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z]+"), lambda t: F.length(t) >= 5))


def _duck_tokens(x: str) -> str:
    return f"list_distinct([t FOR t IN regexp_split_to_array(lower({x}), '[^a-z]+') IF len(t) >= 5])"



query("join_12_best_fuzzy_match", "benchmark", "pages", sql=f"""WITH a AS (SELECT item_id AS id, {_duck_tokens("text")} AS tk FROM benchmark), b AS (SELECT page_id AS match_id, page_id % 5 AS stars, {_duck_tokens("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS tk FROM pages),
    j AS (SELECT id, match_id, stars, len(list_intersect(a.tk, b.tk)) / (len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk)))::DOUBLE AS jaccard FROM a CROSS JOIN b), k AS (SELECT *, jaccard + stars / 1000.0::DOUBLE AS score FROM j WHERE jaccard >= 0.02::DOUBLE)
    SELECT id, match_id, round(jaccard, 8) AS jaccard, round(score, 8) AS score FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, match_id) = 1""")(
    lambda b, p: J.best_fuzzy_match(b.select(c("item_id").alias("id"), _tokens(c("text")).alias("tokens")), p.select(c("page_id").alias("match_id"), _tokens(F.regexp_replace("html", "<[^>]*>", " ")).alias("tokens"), (c("page_id") % 5).alias("stars")), 0.02))
_NORM = r"lower(trim(regexp_replace(line, '\s+', ' ', 'g')))"
query("join_13_novel_lines", "conversations", "documents", sql=f"WITH n AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations), k AS (SELECT DISTINCT {_NORM} AS x FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {_NORM} <> '') SELECT conv_id, turn, line FROM n WHERE {_NORM} NOT IN (SELECT x FROM k)")(
    lambda v, d: J.novel_lines(v.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line")), d.select(F.explode(F.split("text", "\n")).alias("line"))))
query("join_14_orphan_rows", "documents", "labels", sql="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda d, x: d.join(x.select("doc_id"), "doc_id", "left_anti").select("doc_id"))
_RNG = "g AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 60)::INT AS e, o_orderstatus = 'F' AS f FROM orders)"


def _ranges(o, side, cond):  # noqa: ANN001, ANN202
    return o.where(cond).select(c("o_custkey").alias("k"), c("o_orderkey").alias(f"{side}_id"), F.to_date("o_orderdate").alias(f"{side}_start"), F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 60 as int))").alias(f"{side}_end"))


query("join_15_overlap_join", "orders", sql=f"WITH {_RNG} SELECT a.id AS a_id, b.id AS b_id FROM g a JOIN g b ON a.k = b.k AND a.s <= b.e AND b.s <= a.e WHERE a.f AND NOT b.f")(lambda o: J.overlap_join(_ranges(o, "a", "o_orderstatus = 'F'"), _ranges(o, "b", "o_orderstatus <> 'F'"), "k").select("a_id", "b_id"))
query("join_16_align_tail", "v_prices", sql="WITH x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS back FROM {v_prices}), n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM {v_prices} GROUP BY series)) SELECT series, d, round(close, 6) AS close, back FROM x, n WHERE back <= n")(lambda p: J.align_tail(p).withColumn("close", F.round("close", 6)))
_KW = [("energy", "the"), ("war", "of"), ("trade", "and"), ("rates", "tion"), ("crypto", "heit"), ("tech", "mente"), ("food", "token"), ("health", "example"), ("tax", "worthless"), ("sport", "zzz")]
_KW_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _KW) + ") k(category, keyword)"
query("join_17_keyword_categories", "documents", sql=f"SELECT doc_id AS id, array_to_string(list_sort(list_distinct(coalesce(list(category) FILTER (contains(lower(text), keyword)), []))), ',') AS categories FROM documents CROSS JOIN {_KW_SQL} GROUP BY ALL")(
    lambda d: J.keyword_categories(d.select(c("doc_id").alias("id"), "text"), d.sparkSession.createDataFrame(_KW, "category string, keyword string")).select("id", F.array_join("categories", ",").alias("categories")))
query("join_18_flag_membership", "part", sql="SELECT p_partkey, (upper(p_brand) IN ('BRAND#1', 'BRAND#7', 'BRAND#12'))::INT AS listed FROM part")(lambda p: J.dimension_join(p.withColumn("u", F.upper("p_brand")), p.sparkSession.createDataFrame([("BRAND#1", True), ("BRAND#7", True), ("BRAND#12", True)], "u string, hit boolean"), "u").select("p_partkey", c("hit").isNotNull().alias("listed")))
query("join_20_event_covariate", "v_prices", "events", sql="""WITH e AS (SELECT user_id % 5 AS k, (ts::DATE - INTERVAL (10000) DAY)::DATE AS ed, value / 500 AS boost FROM events WHERE value > 100), d AS (SELECT DISTINCT (left(series, 1)::INT - 1) AS k, d FROM {v_prices})
    SELECT d.k AS key, d.d, round(coalesce(sum(boost * (1 - (ed - d.d) / 5.0::DOUBLE)), 0), 8) AS covariate FROM d LEFT JOIN e ON e.k = d.k AND ed BETWEEN d.d AND d.d + 5 GROUP BY ALL""")(
    lambda p, e: J.event_covariate(p.select((F.left("series", F.lit(1)).cast("int") - 1).cast("long").alias("key"), "d").distinct(), e.where("value > 100").select((c("user_id") % 5).alias("key"), (c("value") / 500).alias("boost"), F.date_sub(F.to_date("ts"), 10000).alias("event_date"))))
query("top_01_horizon_closeness", "v_markets", sql="SELECT asset, market_id, row_number() OVER (PARTITION BY asset ORDER BY abs(days_to_expiry - 14), volume DESC, market_id) AS rank FROM {v_markets}")(lambda m: J.latest_n(m, "asset", 2**31 - 1, F.abs(c("days_to_expiry") - 14).asc_nulls_last(), F.desc("volume"), c("market_id")).select("asset", "market_id", c("rn").alias("rank")))
query("top_02_latest_n_per_key", "v_snapshots", sql="SELECT market_id, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY captured_at DESC, event_id DESC) AS rn FROM {v_snapshots}) WHERE rn <= 3")(lambda s: J.latest_n(s, "market_id", 3, F.desc("captured_at"), F.desc("event_id")).select("market_id", "event_id", "rn"))
query("top_03_last_n_per_group", "events", sql="SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")(lambda e: J.latest_n(e, "user_id", 50, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id"))
query("top_04_dedup_by_key", "documents", sql="SELECT doc_id, md5(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")(lambda d: J.latest_n(d.select("doc_id", F.md5("text").alias("h")), "h", 1, c("doc_id")).drop("rn"))
query("top_05_upsert_by_hash", "documents", sql="""WITH u AS (SELECT md5(text) AS k, doc_id AS payload, doc_id AS created, doc_id AS updated, (doc_id % 2)::INT AS nw FROM documents) SELECT k, max_by(payload, (nw, updated)) AS payload, min(created) AS created, max(updated) AS updated FROM u GROUP BY 1""")(
    lambda d: J.upsert(*[d.where(c("doc_id") % 2 == i).select(F.md5("text").alias("k"), c("doc_id").alias("payload"), c("doc_id").alias("created"), c("doc_id").alias("updated")) for i in (0, 1)], "k"))
query("top_06_max_confidence", "v_numbered_steps", sql="SELECT ticker, horizon, max_by(t, (confidence, -t)) AS t, max(confidence) AS confidence FROM {v_steps} GROUP BY ALL")(lambda s: s.groupBy("ticker", "horizon").agg(F.max_by("t", F.struct("confidence", -c("t"))).alias("t"), F.max("confidence").alias("confidence")))
query("top_07_top_domains", "pages", sql="SELECT lang, domain, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, domain) AS rn FROM (SELECT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS lang, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS domain, count(*) AS n FROM pages GROUP BY ALL)) WHERE rn <= 5")(
    lambda p: J.latest_n(p.groupBy(F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1).alias("lang"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("domain")).agg(F.count(F.lit(1)).alias("n")), "lang", 5, F.desc("n"), c("domain")).drop("rn"))
query("top_08_unusual_volume", "part", sql="SELECT side, p_partkey, rn FROM (SELECT side, p_partkey, row_number() OVER (PARTITION BY side ORDER BY p_size DESC, p_partkey) AS rn FROM (SELECT *, p_partkey % 2 AS side, avg(p_size) OVER (PARTITION BY p_partkey % 2) AS m FROM part) WHERE p_size > 1.5 * m) WHERE rn <= 5")(
    lambda p: J.latest_n(J.dimension_join(p.withColumn("side", c("p_partkey") % 2), p.groupBy((c("p_partkey") % 2).alias("side")).agg(F.avg("p_size").alias("m")), "side").where("p_size > 1.5 * m"), "side", 5, F.desc("p_size"), c("p_partkey")).select("side", "p_partkey", "rn"))
query("top_09_nearest_row", "part", sql="SELECT p_brand, min_by(p_retailprice, (abs(p_retailprice - 1000), p_partkey)) AS nearest FROM part GROUP BY 1")(lambda p: J.nearest_row(p, "p_brand", "p_retailprice", F.lit(1000.0), "p_partkey"))
query("top_10_best_and_worst", "orders", sql="SELECT o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS best, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS worst FROM orders GROUP BY 1")(lambda o: o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("worst")))
query("top_11_latest_kept_entry", "events", sql="SELECT event_type AS profile, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE value > 50 GROUP BY 1")(lambda e: e.where("value > 50").groupBy(c("event_type").alias("profile")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")))
query("top_12_dedup_levels", "v_markets", sql="SELECT asset, price, market_id FROM (SELECT *, floor(volume / 500)::BIGINT AS price, row_number() OVER (PARTITION BY asset, floor(volume / 500) ORDER BY CASE tier WHEN 'macro' THEN 3 WHEN 'electoral' THEN 2 ELSE 1 END DESC, days_to_expiry, probability DESC, market_id) AS rn FROM {v_markets}) WHERE rn = 1")(
    lambda m: J.latest_n(m.withColumn("price", F.floor(c("volume") / 500)).withColumn("k", F.struct("asset", "price")), "k", 1, F.when(c("tier") == "macro", 3).when(c("tier") == "electoral", 2).otherwise(1).desc(), c("days_to_expiry").asc_nulls_last(), F.desc("probability"), c("market_id")).select("asset", "price", "market_id"))
query("top_14_union_with_tag", "documents", "pages", sql="SELECT 'document' AS tag, doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT 'page', page_id, NULL, url FROM pages")(lambda d, p: d.select(F.lit("document").alias("tag"), c("doc_id").alias("id"), "lang").unionByName(p.select(F.lit("page").alias("tag"), c("page_id").alias("id"), "url"), allowMissingColumns=True))
query("flt_01_screen", "part", sql="SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 10 AND p_retailprice BETWEEN 950 AND 1050 AND p_brand = 'Brand#7'")(lambda p: J.screen(p, [("p_size", "gte", 10), ("p_retailprice", "between", (950, 1050)), ("p_brand", "eq", "Brand#7")]).select("p_partkey", "p_size", "p_retailprice"))
query("flt_03_filter_to_horizon", "v_markets", sql="""WITH x AS (SELECT asset, market_id, abs(days_to_expiry - 14) <= 7 AS near, row_number() OVER (PARTITION BY asset ORDER BY abs(days_to_expiry - 14), volume DESC, market_id) AS r FROM {v_markets} WHERE days_to_expiry < 3 OR market_id % 2 = 0),
    y AS (SELECT *, bool_or(near) OVER (PARTITION BY asset) AS has FROM x) SELECT asset, market_id FROM y WHERE CASE WHEN has THEN near ELSE r <= 8 END""")(lambda m: J.filter_to_horizon(m.where("days_to_expiry < 3 or market_id % 2 = 0").withColumn("days_to_end", c("days_to_expiry")), 14).select("asset", "market_id"))
query("flt_04_resolution_aligned", "v_markets", sql="SELECT market_id, (abs(days_to_expiry - 14) <= greatest(1.5, 0.35 * 14))::INT AS aligned FROM {v_markets}")(lambda m: m.select("market_id", Y.resolution_aligned(c("days_to_expiry"), 14).alias("aligned")))
query("flt_07_jump_event_filter", "v_markets", sql="SELECT market_id, greatest(1, ceil(days_to_expiry))::INT AS days FROM {v_markets} WHERE probability > 0 AND probability < 1 AND volume >= 5000 AND age_days >= 2 AND days_to_expiry <= 30 AND days_to_expiry >= 1")(Y.jump_events)
query("flt_09_find_keyword", "documents", sql="SELECT doc_id, substr(text, greatest(1, instr(lower(text), 'tion') - 100), 200) AS excerpt FROM documents WHERE contains(lower(text), 'tion')")(lambda d: d.where(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id", F.substring("text", F.greatest(F.lit(1), F.instr(F.lower("text"), "tion") - 100), F.lit(200)).alias("excerpt")))
