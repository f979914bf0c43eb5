"""Queries over text, vectors and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import text as T
from quillon.plans.base import query

c = F.col


query("txt_02_content_hash", "documents", sql="SELECT doc_id, sha256(text) AS hash FROM documents")(lambda d: d.select("doc_id", T.content_hash(c("text")).alias("hash")))
query("txt_03_snippet", "documents", sql=r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 700) AS snippet, ceil(length(text) / 3.5)::BIGINT AS tokens FROM documents")(lambda d: d.select("doc_id", T.snippet(c("text")).alias("snippet"), T.estimate_tokens(c("text")).alias("tokens")))
_STOP = ", ".join(f"'{x}'" for x in T.NOT_TICKERS)
_TICKERS = r"list_sort(list_distinct([x FOR x IN regexp_extract_all(t, '\$([A-Z]{1,5}(?:\.[A-Z]{1,2})?)', 1) || [y FOR y IN regexp_extract_all(t, '[A-Z.]+') IF regexp_full_match(y, '[A-Z]{2,5}(\.[A-Z]{1,2})?')] IF x NOT IN (" + _STOP + ")]))"
# texts of the table, with market talk behind every third
_TALK = "CASE WHEN doc_id % 3 = 0 THEN text || ' $AAPL.B and $CEO beat MSFT, BUY GAAP FED; BRK.B. NOVO.CO, not U.S. nor TOOLONG or $TSLA5 ' || chr(CAST(65 + doc_id % 26 AS INT)) || 'XY' ELSE text END"
query("txt_04_extract_tickers", "documents", sql=f"SELECT doc_id, array_to_string({_TICKERS}, ',') AS tickers FROM (SELECT doc_id, {_TALK} AS t FROM documents)")(lambda d: d.select("doc_id", F.array_join(T.extract_tickers(F.expr(_TALK)), ",").alias("tickers")))
_FILE = "CASE event_id % 5 WHEN 0 THEN 'sessions/' || event_id || '.jsonl' WHEN 1 THEN '2024-01-' || lpad(CAST(event_id % 40 AS STRING), 2, '0') || '.md' WHEN 2 THEN 'MEMORY.md' WHEN 3 THEN 'old/2024-01-05.md' ELSE 'topic.md' END"
query("txt_09_file_decay", "events", sql=f"""WITH f AS (SELECT event_id, value, ts, {_FILE.replace("AS STRING", "AS VARCHAR")} AS path FROM events), a AS (SELECT *, CASE WHEN path LIKE 'sessions/%' THEN ts WHEN regexp_full_match(path, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[.]md') THEN try_strptime(left(path, 10), '%Y-%m-%d') END AS made FROM f)
    SELECT event_id, round(CASE WHEN made IS NULL THEN value ELSE value * exp(-ln(2::DOUBLE) * greatest(0, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(made)) / 86400000000 / 30) END, 6) AS score FROM a""")(
    lambda e: e.select("event_id", F.round(T.file_decay(c("value"), F.expr(_FILE), c("ts"), F.expr("timestamp '2024-01-20 00:00:00'")), 6).alias("score")))
query("txt_09_temporal_decay", "events", sql="SELECT event_id, round(value * exp(-ln(2::DOUBLE) * date_diff('day', ts::DATE, DATE '2024-02-01') / 30), 6) AS score FROM events")(lambda e: e.select("event_id", F.round(T.temporal_decay(c("value"), F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).cast("double")), 6).alias("score")))
query("txt_12_recall", "events", sql="SELECT user_id, event_id FROM events WHERE lower(event_type) = 'click' AND ts >= TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")(
    lambda e: T.recall(e, "user_id", F.expr("lower(event_type) = 'click' and ts >= timestamp '2024-01-10'"), 5, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id"))
query("txt_14_latest_routing", "events", sql="SELECT user_id, max_by(event_type, (ts, event_id)) AS routing FROM events WHERE event_type <> 'error' GROUP BY 1")(lambda e: e.where("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("routing")))
query("txt_15_missing_embeddings", "documents", "embeddings", sql="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")(lambda d, e: d.join(e.select(c("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id"))
query("txt_16_html_to_text", "pages", sql=r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<style\b[^>]*>.*?</style>|<script\b[^>]*>.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS h FROM pages""")(lambda p: p.select("page_id", F.md5(T.html_to_text(c("html"))).alias("h")))
query("txt_17_html_title", "pages", sql="SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")(lambda p: p.select("page_id", T.html_title(c("html")).alias("title")))
query("txt_17_html_to_markdown", "pages")(lambda p: p.select("page_id", F.md5(T.html_to_markdown(c("html"))).alias("h"), F.length(T.html_to_markdown(c("html"))).alias("n")))
query("txt_21_lexicon_sentiment", "documents", sql=r"""WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\pL]+') AS w FROM documents), n AS (SELECT doc_id, len([x FOR x IN w IF x IN ('the', 'and', 'of')]) AS g, len([x FOR x IN w IF x IN ('worthless', 'pathetic', 'in')]) AS b FROM w)
    SELECT doc_id, round(CASE WHEN g + b > 0 THEN (g - b) / (g + b) ELSE 0 END::DOUBLE, 8) AS sentiment FROM n""")(lambda d: d.select("doc_id", T.lexicon_sentiment(c("text"), ("the", "and", "of"), ("worthless", "pathetic", "in")).alias("sentiment")))
query("txt_23_parse_compact_date", "events", sql="SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events")(lambda e: e.select("event_id", F.date_format(T.parse_compact_date(F.date_format("ts", "yyyyMMddHHmmss")), "yyyy-MM-dd HH:mm:ss").alias("at")))
query("src_13_transcripts_to_docs", "conversations", sql="""WITH x AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), y AS (SELECT conv_id, turn, 'User: ' || trim(text) || chr(10) || chr(10) || 'Assistant:' || chr(10) || chr(10) || trim(nt) AS content FROM x WHERE role = 'user' AND nr = 'assistant') SELECT conv_id, turn, content, sha256(content) AS id FROM y""")(T.transcripts_to_docs)
query("agg_55_sentiment_stats", "events", sql="""WITH x AS (SELECT event_type, value, CASE WHEN value > 60 THEN 1 WHEN value < 20 THEN -1 ELSE 0 END AS s, 1 + value / max(value) OVER (PARTITION BY event_type) AS w FROM events) SELECT event_type, count(*) AS n, floor(100.0 * count(*) FILTER (s = 1) / count(*) + 0.5)::BIGINT AS bull, floor(100.0 * count(*) FILTER (s = -1) / count(*) + 0.5)::BIGINT AS bear, round(sum(s * w) / sum(w), 8) AS mean FROM x GROUP BY 1""")(
    lambda e: e.withColumns({"s": F.when(c("value") > 60, 1).when(c("value") < 20, -1).otherwise(0), "w": 1 + c("value") / F.max("value").over(T.Window.partitionBy("event_type"))}).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.floor(100 * F.count_if(c("s") == 1) / F.count(F.lit(1)) + 0.5).alias("bull"), F.floor(100 * F.count_if(c("s") == -1) / F.count(F.lit(1)) + 0.5).alias("bear"), (F.sum(c("s") * c("w")) / F.sum("w")).alias("mean")))
