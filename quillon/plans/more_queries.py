"""Further queries: round trips of sources, remaining filters, aggregates, text and user-function operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import joins as J
from quillon.operators import markets as M
from quillon.operators import scoring as A
from quillon.operators import text as T
from quillon.plans.base import ORACLES, QUERIES, duck, query, tidy, view, shared_folder
from quillon.registry import run, tool
from quillon.sources import readers as R

c = F.col


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _round_trip(name: str, table: str, write, read, sql: str) -> None:  # noqa: ANN001
    """A table is written in a source's format and read back by the source's reader."""

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _path(spark, name)
        write(view(spark, sf_dir, table), path)
        return tidy(read(spark, path))

    QUERIES[name], ORACLES[name] = go, duck(sql)


_round_trip("src_02_append_snapshots", "v_markets",
    lambda m, p: [R.append_snapshots(m.where(c("market_id") % 2 == k).select(c("market_id").cast("string").alias("marketId"), c("asset").alias("question"), "probability", c("volume").alias("volume24h"), F.lit("").alias("endDate"), F.lit("2024-01-02 00:00:00").cast("timestamp").alias("capturedAt"), F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask")), p) for k in (0, 1)],
    lambda s, p: R.read_snapshots(s, p)[0].select("marketId", "question", "probability", "volume24h"),
    "SELECT market_id::VARCHAR AS \"marketId\", asset AS question, round(probability, 8) AS probability, round(volume, 8) AS volume24h FROM {v_markets}")
_round_trip("src_04_read_bundles", "v_markets",
    lambda m, p: m.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct(c("market_id").cast("string").alias("marketId"), "probability", c("volume").alias("volume24h")))).alias("ms")).select(F.lit("2024-01-01T00:00:00Z").alias("capturedAt"), c("asset").alias("ticker"), F.when(c("asset") == "Brand#3", -1).otherwise(7).alias("horizonDays"), F.struct(c("ms").alias("selectedMarkets")).alias("polymarket")).write.json(p),
    lambda s, p: R.read_bundles(s, p)[0].select("ticker", F.explode("polymarket.selectedMarkets").alias("m")).select("ticker", "m.marketId", "m.probability"),
    "SELECT asset AS ticker, market_id::VARCHAR AS \"marketId\", round(probability, 8) AS probability FROM {v_markets} WHERE asset <> 'Brand#3'")
_round_trip("src_06_explode_dated_markets", "v_markets",
    lambda m, p: m.groupBy(F.expr("market_id div 100").cast("string").alias("date")).agg(F.collect_list(F.struct(c("asset").alias("question"), "probability", "volume")).alias("markets")).write.json(p),
    lambda s, p: R.read_dated_markets(s, p).select("date", "question", "probability"),
    "SELECT (market_id // 100)::VARCHAR AS date, asset AS question, round(probability, 8) AS probability FROM {v_markets}")
_round_trip("src_12_ledger", "orders",
    lambda o, p: R.append_ledger(o.select("o_orderkey", F.struct("o_custkey", "o_orderstatus").alias("detail")), p),
    lambda s, p: R.read_ledger(s, p, "o_orderkey long, detail string", {"detail": "struct<o_custkey:bigint,o_orderstatus:string>"}).select("o_orderkey", "detail.o_custkey", "detail.o_orderstatus"),
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
_round_trip("src_14_export_csv", "documents",
    lambda d, p: R.export_rows(d.select("doc_id", F.translate("text", "\n\r\"\\", "    ").alias("text")), p, "csv"),
    lambda s, p: R.read_exported(s, p, "doc_id long, text string"),
    "SELECT doc_id, translate(text, chr(10) || chr(13) || '\"\\', '    ') AS text FROM documents")
_round_trip("src_20_eval_questions", "conversations",
    lambda v, p: v.select(F.concat_ws("-", "conv_id", "turn").alias("k"), F.replace("text", F.lit("\\"), F.lit("/")).alias("q")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(p),
    lambda s, p: R.read_eval_questions(s, p, "k string, q string"),
    "SELECT conv_id || '-' || turn AS k, replace(text, '\\', '/') AS q FROM conversations")
query("flt_12_drop_fields_deep", "orders", sql="SELECT o_orderkey, o_custkey AS k FROM orders")(lambda o: J.drop_fields_deep(o.select("o_orderkey", F.struct(c("o_custkey").alias("k"), c("o_orderstatus").alias("url")).alias("s")), {"url"}).select("o_orderkey", "s.k"))
query("agg_57_duplicate_terms", "documents", sql=r"WITH w AS (SELECT DISTINCT source, unnest(regexp_extract_all(text, '\b[A-Z]{4,7}\b')) AS w FROM documents) SELECT w AS term, count(*) AS sources FROM w GROUP BY 1 HAVING count(*) >= 2")(lambda d: T.duplicate_terms(d, "source"))
query("udf_04_user_projection", "v_snapshots", sql="WITH m AS (SELECT market_id, abs(sqrt(probability) - lag(sqrt(probability)) OVER (PARTITION BY market_id ORDER BY captured_at, event_id)) AS move, epoch_us(captured_at) - max(epoch_us(captured_at)) OVER (PARTITION BY market_id) AS x FROM {v_snapshots}) SELECT market_id, round(coalesce(max(move), 0), 8) AS jump FROM m WHERE x >= -24 * 3600000000 GROUP BY 1")(lambda s: M.max_jump(s, 24, F.sqrt))


@tool("market_signal", asset="string")
def _market_signal(tables: dict[str, DataFrame], asset: str) -> DataFrame:
    return M.market_signal(tables["markets"].where(c("asset") == asset), "asset")


query("udf_06_tool_registry", "v_markets", sql="SELECT asset, count(*) AS markets FROM {v_markets} WHERE asset = 'Brand#5' GROUP BY 1")(lambda m: run("market_signal", {"asset": "Brand#5"}, {"markets": m}).select("asset", "markets"))
