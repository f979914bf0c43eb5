"""Queries of retrieval, transcripts, filters and bucket reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import filters as X
from quillon.operators import markets as M
from quillon.operators import scoring as A
from quillon.operators import text as T
from quillon.plans.base import query
from quillon.plans.scoring_queries import _BALANCED

c = F.col


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# retrieval: every benchmark item, whole, is a query

_TOK = r"[t FOR t IN regexp_split_to_array(lower(text), '[^\pL\pN]+') IF t <> '']"
_BM = rf"""d AS (SELECT doc_id, lang, {_TOK} AS t FROM documents), q AS (SELECT item_id AS query_id, list_distinct({_TOK}) AS t FROM benchmark), qt AS (SELECT query_id, unnest(t) AS term, len(t) AS needed FROM q),
    p AS (SELECT doc_id, len(t) AS size, unnest(t) AS term FROM d), tf AS (SELECT doc_id, size, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    n AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d),
    s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m)))::DOUBLE AS bm25 FROM qt JOIN tf USING (term) JOIN df USING (term) CROSS JOIN n GROUP BY query_id, doc_id, needed HAVING count(*) = needed),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM s),"""


def _bm_sql(k: int) -> str:
    score = "CASE WHEN max(own) OVER w > min(own) OVER w THEN (own - min(own) OVER w) / (max(own) OVER w - min(own) OVER w) ELSE 1 END::DOUBLE"
    return f"{_BM} bm AS (SELECT * FROM (SELECT query_id, doc_id, bm25, {score} AS score, rank FROM (SELECT *, round(bm25, 9) AS own FROM r) WHERE rank <= {max(2 * k, 20)} WINDOW w AS (PARTITION BY query_id)) WHERE rank <= {k})"


def _bm(d: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    return T.bm25(d, b.select(c("item_id").alias("query_id"), "text"), k)


_VEC = """vs AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v CROSS JOIN embeddings q WHERE q.vec_id % 50 = 0),
    vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM vs)"""


def _vec(e: DataFrame, k: int = 10) -> DataFrame:
    return T.vector_search(e, e.where("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("query")), k)


query("txt_06_bm25_search", "documents", "benchmark", sql=f"WITH {_bm_sql(10)} SELECT query_id, doc_id, round(bm25, 6) AS bm25, round(score, 6) AS score, rank FROM bm")(
    lambda d, b: _bm(d, b).withColumns({"bm25": F.round("bm25", 6), "score": F.round("score", 6)}))
query("txt_07_vector_search", "embeddings", sql=f"WITH {_VEC} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM vr WHERE rank <= 10")(lambda e: _vec(e).withColumn("score", F.round("score", 6)))


def _hybrid(d: DataFrame, b: DataFrame, e: DataFrame) -> DataFrame:
    keyword = _bm(d, b, 40).select((c("query_id") * 50).alias("query_id"), c("doc_id").alias("id"), "score")
    vector = _vec(e, 40).select("query_id", c("vec_id").alias("id"), "score")
    boosted = vector.where("id % 7 = 0").select("query_id", "id")
    return T.hybrid(keyword, vector, 10, min_score=0.05, boosted=boosted).withColumn("score", F.round("score", 6))


query("txt_08_hybrid_search", "documents", "benchmark", "embeddings", sql=f"""WITH {_bm_sql(40)}, {_VEC},
    h AS (SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.doc_id, v.vec_id) AS id, k.score AS ks, v.score AS vs FROM (SELECT query_id * 50 AS query_id, doc_id, score FROM bm) k FULL JOIN (SELECT * FROM vr WHERE rank <= 40) v ON k.query_id = v.query_id AND k.doc_id = v.vec_id),
    g AS (SELECT query_id, id, vs, CASE WHEN count(ks) OVER w > 0 AND count(vs) OVER w > 0 THEN 0.3::DOUBLE * coalesce(ks, 0) + 0.7::DOUBLE * coalesce(vs, 0) ELSE coalesce(ks, 0) + coalesce(vs, 0) END AS score FROM h WINDOW w AS (PARTITION BY query_id)),
    o AS (SELECT query_id, id, CASE WHEN vs IS NOT NULL AND id % 7 = 0 THEN least(1, score + 0.25::DOUBLE) ELSE score END AS score FROM g),
    z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM o WHERE score >= 0.05)
    SELECT query_id, id, round(score, 6) AS score, rank FROM z WHERE rank <= 10""")(_hybrid)
query("txt_10_mmr_rerank", "documents", "benchmark")(
    lambda d, b: T.mmr(_bm(d, b).join(d.select("doc_id", T.tokenize(c("text")).alias("tokens")).hint("merge"), "doc_id").select("query_id", c("doc_id").alias("id"), "score", "tokens")))
query("txt_13_search_rows", "documents", "benchmark", sql=f"WITH {_bm_sql(10)} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM bm JOIN d USING (doc_id) WHERE lang <> 'de' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5")(
    lambda d, b: T.search_rows(d, b.select(c("item_id").alias("query_id"), "text"), c("lang") != "de"))
_PHRASES = ", ".join(f"('{p}', [{_list(n)}])" for p, n in T.SYNONYMS)
_ASK = "text || CASE item_id % 3 WHEN 0 THEN ' FCF against p/e' WHEN 1 THEN ' capex yoy, PE ratio' ELSE '' END"
query("txt_05_expand_query", "benchmark", sql=rf"""WITH b AS (SELECT item_id, {_ASK} AS t FROM benchmark), s AS (SELECT row_number() OVER () AS i, p, n FROM (VALUES {_PHRASES}) v(p, n)),
    w AS (SELECT item_id, 0 AS i, 0 AS j, array_to_string(regexp_extract_all(lower(t), '[\pL\pN_]+'), ' ') AS part FROM b UNION ALL SELECT item_id, i, j, n[j] FROM b, s, range(1, 5) r(j) WHERE regexp_matches(t, '(?i)' || p) AND j <= len(n))
    SELECT item_id, string_agg(part, ' OR ' ORDER BY i, j) AS q FROM w GROUP BY 1""")(
    lambda b: b.select("item_id", F.array_join(F.transform(T.expand_query(F.expr(_ASK)), lambda ws: F.array_join(ws, " ")), " OR ").alias("q")))
query("txt_01_chunk_text", "documents")(lambda d: T.chunk_text(d.withColumn("text", F.regexp_replace("text", "\n", "\n\n")), overlap=40))

# transcripts and pages: marks are put between the fields of each row

_GUIDE = "text || chr(10) || 'We expect revenue of ' || doc_id || ' million this year. Short will. The outlook for ' || lang || ' remains as it was'"
query("txt_18_guidance_phrases", "documents", sql=rf"""WITH t AS (SELECT doc_id, [trim(x) FOR x IN regexp_split_to_array({_GUIDE}, '[.\n]+')] AS s FROM documents)
    SELECT doc_id, unnest([x FOR x IN s IF length(x) > 20 AND regexp_matches(x, '{T.GUIDANCE}')][1:10]) AS sentence FROM t""")(
    lambda d: d.select("doc_id", F.explode(T.guidance_phrases(F.expr(_GUIDE.replace("doc_id", "cast(doc_id as string)")))).alias("sentence")))
_TALK = "text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Questions and Answers' || chr(10) || 'Analyst: and ' || source ELSE '' END"
query("txt_19_split_sections", "documents", sql=rf"""WITH t AS (SELECT doc_id, {_TALK} AS t FROM documents), p AS (SELECT doc_id, t, CASE WHEN regexp_matches(t, '{T.QA_START}') THEN length(regexp_extract(t, '(?s)^(.*?)(?:{T.QA_START})', 1)) ELSE length(t) END AS n FROM t)
    SELECT doc_id, left(t, n) AS remarks, substr(t, n + 1) AS qa FROM p""")(lambda d: d.select("doc_id", T.split_sections(F.expr(_TALK)).alias("s")).select("doc_id", "s.*"))
_ASKED = "'Analyst: how is ' || source || ' doing? CFO: ' || text || ' Question: and the rest of ' || lang || '? Response: as before. Q: no?'"
query("txt_20_qa_highlights", "documents", sql=rf"""WITH t AS (SELECT doc_id, [trim(x) FOR x IN regexp_split_to_array({_ASKED}, '{T.QUESTION}')[2:4]] AS p FROM documents), u AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS i FROM t),
    n AS (SELECT *, CASE WHEN regexp_matches(s, '{T.ANSWER}') THEN length(regexp_extract(s, '(?s)^(.*?)(?:{T.ANSWER})', 1)) ELSE 0 END AS n FROM u),
    r AS (SELECT doc_id, i, left(trim(CASE WHEN n > 0 THEN left(s, n) ELSE left(s, 300) END), 200) AS question, left(trim(CASE WHEN n > 0 THEN substr(s, n + 1) ELSE '' END), 200) AS answer FROM n)
    SELECT doc_id, question, answer FROM r WHERE length(question) > 10""")(lambda d: d.select("doc_id", F.explode(T.qa_highlights(F.expr(_ASKED))).alias("h")).select("doc_id", "h.*"))
_MARK = "'# Page ' || page_id || chr(10) || chr(10) || '- see [the page](' || url || ') and ![logo](a.png) `code`' || chr(10) || '1. first   item' || chr(10) || chr(10) || chr(10) || '## End'"
_LINES = r"(?m)^#{1,6}\s+", r"(?m)^\s*[-*+]\s+", r"(?m)^\s*\d+\.\s+"


def _markdown_sql() -> str:
    x = _MARK
    for pattern, to in ((r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"```[^\n`]*\n?", ""), (r"`([^`]+)`", r"\1"), *((p, "") for p in _LINES), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"SELECT page_id, left(trim({x}), 60) AS text, (length(trim({x})) > 60)::INT AS truncated FROM pages"


query("txt_17_markdown_to_text", "pages", sql=_markdown_sql())(lambda p: p.select("page_id", T.truncate_text(T.markdown_to_text(F.expr(_MARK.replace("page_id", "cast(page_id as string)"))), 60).alias("t")).select("page_id", "t.text", "t.truncated"))

# filters and labels

query("flt_05_question_matches", "documents", "benchmark", sql=rf"""WITH q AS (SELECT item_id, [regexp_replace(w, '[^a-z0-9]', '', 'g') FOR w IN regexp_split_to_array(lower(text), '[\s\-_/]+')] AS w FROM benchmark), s AS (SELECT item_id, [x FOR x IN w IF len(x) >= 3 AND x NOT IN ({_list(X.STOP_WORDS)})] AS ws FROM q),
    a AS (SELECT item_id, ws, [x FOR x IN ws IF x NOT IN ({_list(X.WEAK_WORDS)})] AS strong FROM s), d AS (SELECT doc_id, lower(text) AS t FROM documents)
    SELECT doc_id, item_id FROM d CROSS JOIN a WHERE len(ws) = 0 OR len([x FOR x IN strong IF contains(t, x)]) > 0""")(
    X.matching_questions)  # the items are a stated query set, a few rows whatever the corpus
query("flt_06_drop_trivial_levels", "v_ladder", sql="SELECT asset, price FROM {v_ladder} WHERE NOT ((price - 1000) / 1000 < -0.05 AND probability > 0.90) AND NOT ((price - 1000) / 1000 > 0.50 AND probability < 0.05)")(lambda x: X.drop_trivial_levels(x, F.lit(1000.0)).select("asset", "price"))
query("flt_02_markets_open_at", "orders", sql="SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1997-01-01' AND o_orderstatus <> 'F'")(
    lambda o: o.where(X.markets_open_at("1997-01-01", c("o_orderdate"), F.expr("o_orderdate + interval 90 days"), c("o_orderstatus") == "F")).select("o_orderkey"))
_SIGNS = {"secret": r"(?i)token\s*=", "shout": "[!]{2}", "junk": "[#$%&*]{3}"}
query("flt_11_suspicious_text", "documents", sql="SELECT * FROM (SELECT doc_id, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in _SIGNS.items()) + "] IF x IS NOT NULL], ',') AS found FROM documents) WHERE found <> ''")(
    lambda d: d.select("doc_id", F.array_join(X.found_patterns(c("text"), _SIGNS), ",").alias("found")).where("found <> ''"))
query("top_13_distinct_files", "documents", sql="SELECT DISTINCT source FROM documents")(lambda d: X.distinct_files(d, "source"))
_HEAD = "text || CASE doc_id % 4 WHEN 0 THEN ' crash' WHEN 1 THEN ' rally' WHEN 2 THEN ' crash rally' ELSE '' END"
query("mkt_27_jump_direction", "documents", sql=f"""WITH t AS (SELECT doc_id, lower({_HEAD}) AS t FROM documents), f AS (SELECT doc_id, len([w FOR w IN [{_list(X.UP_WORDS)}] IF contains(t, w)]) > 0 AS u, len([w FOR w IN [{_list(X.DOWN_WORDS)}] IF contains(t, w)]) > 0 AS d FROM t)
    SELECT doc_id, CASE WHEN u AND NOT d THEN 'up' WHEN d AND NOT u THEN 'down' ELSE 'unknown' END AS direction FROM f""")(lambda d: d.select("doc_id", X.jump_direction(F.expr(_HEAD)).alias("direction")))
_TOPICS = {"secret": ("token =",), "shout": ("!!",), "junk": ("###", "&&&", "$$$")}
query("txt_22_classify_events", "documents", sql="WITH f AS (SELECT doc_id, lang, [x FOR x IN [" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}' END" for n, ws in _TOPICS.items()) + """] IF x IS NOT NULL] AS f FROM documents)
    SELECT doc_id, array_to_string(CASE WHEN lang = 'en' THEN CASE WHEN len([x FOR x IN ['secret', 'junk'] IF list_contains(f, x)]) > 0 THEN [x FOR x IN ['secret', 'junk'] IF list_contains(f, x)] ELSE ['secret', 'junk'] END WHEN len(f) > 0 THEN f ELSE ['general'] END, ',') AS class FROM f""")(
    lambda d: d.select("doc_id", F.array_join(X.classify(c("text"), _TOPICS, F.when(c("lang") == "en", F.array(F.lit("secret"), F.lit("junk"))), "general"), ",").alias("class")))
query("agg_56_source_confidence", "documents", sql="SELECT lang, CASE WHEN n >= 10 AND s >= 2 THEN 'high' WHEN n >= 5 OR s >= 2 THEN 'medium' ELSE 'low' END AS level FROM (SELECT lang, count(*) AS n, count(DISTINCT source) AS s FROM documents GROUP BY 1)")(
    lambda d: d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("s")).select("lang", X.source_confidence(c("n"), c("s")).alias("level")))
_TAGS = "CASE event_type WHEN 'purchase' THEN 'routing:a' WHEN 'error' THEN 'analysis:consensus' WHEN 'click' THEN 'analysis:risk' ELSE 'other' END"
query("txt_11_live_rows", "events", sql=f"WITH x AS (SELECT event_id, {_TAGS} AS tag, (epoch_us(TIMESTAMP '2024-03-15') - epoch_us(ts)) / 86400000000.0::DOUBLE AS age FROM events) SELECT event_id FROM x WHERE tag = 'routing:a' OR age <= CASE tag WHEN 'analysis:consensus' THEN 7 WHEN 'analysis:risk' THEN 90 ELSE 60 END")(
    lambda e: X.live_rows(e.select("event_id", F.array(F.expr(_TAGS)).alias("tags"), c("ts").alias("updated_at")), F.lit("2024-03-15").cast("timestamp")).select("event_id"))
query("mkt_22_transitory_flag", "v_snapshots", sql="WITH x AS (SELECT event_id, probability AS p, lag(probability, 1) OVER w AS a, lag(probability, 2) OVER w AS b FROM {v_snapshots} WINDOW w AS (PARTITION BY market_id ORDER BY captured_at, event_id)) SELECT event_id, coalesce(abs(a - b) > 0.1 AND abs(p - b) < abs(a - b) AND (abs(a - b) - abs(p - b)) / abs(a - b) > 0.5, false)::INT AS transitory FROM x")(
    lambda s: X.transitory_flags(s, "market_id", ["captured_at", "event_id"], "probability").select("event_id", "transitory"))
query("src_10_parse_price_payload", "v_prices", sql="SELECT series, d::VARCHAR AS day, round(close, 4) AS close FROM {v_prices}")(
    lambda p: p.groupBy("series", F.year("d").alias("y")).agg(F.to_json(F.struct(F.collect_list(F.struct(c("d").cast("string").alias("time"), F.round("close", 4).alias("close"))).alias("prices"))).alias("j")).select("series", F.explode(X.parse_price_payload(c("j"))).alias("x")).select("series", c("x.time").alias("day"), "x.close"))
query("src_15_parse_consensus_payload", "v_markets", sql="SELECT market_id, round(greatest(0, least(1, probability * 1.2)), 8) AS p, 0 AS stars FROM {v_markets}")(
    lambda m: m.select("market_id", F.to_json(F.struct(F.array(F.struct(F.lit("No").alias("name"), (1 - c("probability") * 1.2).alias("p")), F.struct(F.lit("YES").alias("name"), (c("probability") * 1.2).alias("p"))).alias("options"))).alias("j")).select("market_id", X.parse_consensus_payload(c("j")).alias("x")).select("market_id", "x.*"))

# weights with every flag, and bucket reports on the fields of the steps

_FLAG_SQL = {"spike": "market_id % 5 = 0", "transitory": "market_id % 3 = 0", "stable": "market_id % 2 = 0", "fast": "market_id % 7 = 0", "jump": "market_id % 11 = 0", "ambiguous": "market_id % 13 = 0"}
query("mkt_05_flag_factor", "v_markets", sql=f"""WITH f AS (SELECT market_id, {", ".join(f"({v}) AS {k}" for k, v in _FLAG_SQL.items())} FROM {{v_markets}})
    SELECT market_id, round((CASE WHEN spike THEN 0.5 WHEN transitory THEN 0.7 WHEN stable THEN 1.1 ELSE 1 END * CASE WHEN fast THEN 0.8 ELSE 1 END * CASE WHEN jump THEN 0.7 ELSE 1 END * CASE WHEN ambiguous THEN 0.6 ELSE 1 END)::DOUBLE, 8) AS factor FROM f""")(
    lambda m: m.select("market_id", M.flag_factor({k: F.expr(v) for k, v in _FLAG_SQL.items()}).alias("factor")))
_BUCKETS = {
    "agg_18_fixed_buckets": (("BUY", "SELL", "HOLD", "WAIT"), lambda: c("recommendation"), "recommendation"),
    "agg_26_by_structural_break": (("true", "false"), lambda: c("structural_break").cast("string"), "CASE WHEN structural_break THEN 'true' WHEN NOT structural_break THEN 'false' END"),
    "agg_27_by_divergence": (("<.05", ".05-.10", ".10-.20", ">=.20"), lambda: A.band(c("divergence"), (0.05, 0.10, 0.20), ("<.05", ".05-.10", ".10-.20", ">=.20")), "CASE WHEN divergence < 0.05 THEN '<.05' WHEN divergence < 0.10 THEN '.05-.10' WHEN divergence < 0.20 THEN '.10-.20' ELSE '>=.20' END"),
    "agg_28_by_consensus": (("low", "medium", "high"), lambda: A.band(c("confidence"), (0.4, 0.7), ("low", "medium", "high")), "CASE WHEN confidence < 0.4 THEN 'low' WHEN confidence < 0.7 THEN 'medium' ELSE 'high' END"),
    "agg_30_by_entropy_scale": (("narrow", "flat", "wide"), lambda: A.band(c("entropy_scale"), (0.999, 1.001000001), ("narrow", "flat", "wide")), "CASE WHEN entropy_scale < 0.999 THEN 'narrow' WHEN entropy_scale > 1.001 THEN 'wide' ELSE 'flat' END"),
}
for _name, (_labels, _column, _case) in _BUCKETS.items():
    query(_name, "v_steps", sql=f"""WITH s AS (SELECT *, coalesce({_case}, 'unknown') AS bucket FROM {{v_steps}}), l AS (SELECT unnest([{_list((*_labels, "unknown"))}]) AS bucket)
        SELECT l.bucket, count(s.t) AS n, count(s.t) / sum(count(s.t)) OVER ()::DOUBLE AS fraction,
            avg(CASE recommendation WHEN 'BUY' THEN actual_return > 0 WHEN 'SELL' THEN actual_return < 0 ELSE abs(actual_return) < 0.03 END::INT) FILTER (s.t IS NOT NULL) AS accuracy, CASE WHEN count(s.t) > 0 THEN {_BALANCED} END AS balanced, avg((predicted_prob - y) ** 2) AS brier,
            avg((realized_price BETWEEN ci_lower AND ci_upper)::INT) AS coverage, avg(CASE recommendation WHEN 'BUY' THEN actual_return WHEN 'SELL' THEN -actual_return ELSE -abs(actual_return) END) AS edge
        FROM l LEFT JOIN s USING (bucket) GROUP BY 1""".replace("count(s.t) / sum(count(s.t)) OVER ()::DOUBLE AS fraction", "round(count(s.t) / sum(count(s.t)) OVER ()::DOUBLE, 8) AS fraction"))(
        lambda s, column=_column, labels=_labels: A.bucket_report(s, column(), labels))
