"""Registry of queries with their SQL, and the views over the test tables on which they run."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.ranks import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Keys and order of the number of a step; a key has a seventh of all rows.
STEP_KEYS, STEP_ORDER = ("l_linestatus", "l_linenumber"), ("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
_STEP = f"row_number() OVER (PARTITION BY {', '.join(STEP_KEYS)} ORDER BY {', '.join(STEP_ORDER)})"

#: Views, in SQL that Spark and DuckDB both read; {name} is a table or another view.
VIEWS = {
    "v_prices": "SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS close FROM {orders} GROUP BY 1, 2",
    "v_prices_short": "SELECT user_id AS series, CAST(ts AS DATE) AS d, max_by(value, moment) AS close FROM (SELECT user_id, ts, value, CAST(ts AS STRING) || lpad(CAST(event_id AS STRING), 12, '0') AS moment FROM {events}) GROUP BY 1, 2",
    "v_steps": """SELECT ticker, horizon, t, predicted_prob, predicted_return, actual_return, CASE WHEN actual_return > 0 THEN 1 ELSE 0 END AS y, realized_price,
        cur * (1 + predicted_return - 2 * tax) AS ci_lower, cur * (1 + predicted_return + 2 * tax) AS ci_upper, confidence,
        CASE WHEN predicted_return > 0.025 THEN 'BUY' WHEN predicted_return < -0.025 THEN 'SELL' ELSE 'HOLD' END AS recommendation,
        CASE regime WHEN 'A' THEN 'bull' WHEN 'N' THEN 'bear' ELSE 'sideways' END AS regime,
        tax * 3 AS divergence, CASE WHEN tax > 0 THEN tax * 3 > 0.1D END AS structural_break, 0.9D + discount * 2 AS entropy_scale,
        CASE WHEN discount > 0.07D THEN tax > 0.03D END AS original_break, CASE WHEN discount > 0.07D THEN tax * 4 END AS original_divergence, CASE WHEN tax > 0.01D THEN discount < 0.05D END AS hmm_converged,
        CASE WHEN discount > 0.02D THEN confidence END AS consensus, CASE WHEN confidence > 0.6D THEN 'good' WHEN confidence > 0.3D THEN 'sparse' WHEN confidence > 0.1D THEN 'none' WHEN tax > 0.05D THEN 'odd' END AS anchor_quality,
        CASE WHEN horizon < 4 THEN 'daily_return' WHEN horizon < 7 THEN 'horizon_return' END AS validation_metric FROM (
        SELECT l_linestatus AS ticker, l_linenumber AS horizon, row_number() OVER (PARTITION BY l_linestatus, l_linenumber ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS t,
        (l_partkey % 101) / 100.0D AS predicted_prob, l_discount - 0.05D AS predicted_return, (l_quantity - 25) / 250.0D AS actual_return, l_extendedprice AS realized_price,
        l_extendedprice / (1 + (l_quantity - 25) / 250.0D) AS cur, l_tax AS tax, l_discount AS discount, (l_suppkey % 11) / 10.0D AS confidence, l_returnflag AS regime FROM {lineitem})""",
    "v_snapshots": "SELECT event_id, user_id AS market_id, ts AS captured_at, least(value / 500.0D, 1.0D) AS probability, value * 1000.0D AS volume24h, event_type || '?' AS question FROM {events}",
    "v_markets": """SELECT p_partkey AS market_id, p_brand AS asset, p_size / 51.0D AS probability, CAST(p_size AS DOUBLE) AS age_days, 0.06D AS delta_yes, -0.04D AS delta_no, p_retailprice * 10 AS volume,
        CASE p_partkey % 3 WHEN 0 THEN 'macro' WHEN 1 THEN 'electoral' ELSE 'other' END AS tier, CAST(p_partkey % 120 AS DOUBLE) AS days_to_expiry, (p_partkey % 12) / 100.0D AS spread FROM {part}""",
    "v_ladder": "SELECT asset, price, 1 - (CAST(row_number() OVER (PARTITION BY asset ORDER BY price) AS DOUBLE) - 0.5D) / count(*) OVER (PARTITION BY asset) AS probability FROM (SELECT DISTINCT p_brand AS asset, p_retailprice AS price FROM {part})",
    "v_docs": "SELECT doc_id, text, lang, source FROM {documents}",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a table of the folder; timestamps carry the session's time zone (UTC)."""
    if name == "v_numbered_steps":
        # v_steps for those who read t: numbered in blocks; where t is not read, Spark leaves its window out
        lineitem = numbered(view(spark, sf_dir, "lineitem"), STEP_KEYS, STEP_ORDER)
        return spark.sql(VIEWS["v_steps"].replace(f"{_STEP} AS t", "t"), lineitem=lineitem)
    if name not in VIEWS:
        found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return found.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in found.dtypes])
    text = VIEWS[name]
    return spark.sql(text, **{x: view(spark, sf_dir, x) for x in re.findall(r"\{([a-z]\w*)\}", text)})


def duck(text: str) -> str:
    """The SQL of an oracle, with the views that it names in braces as common table expressions."""
    parts: dict[str, str] = {}

    def add(name: str) -> str:
        if name in VIEWS and name not in parts:
            body = re.sub(r"\{([a-z]\w*)\}", lambda m: add(m[1]), VIEWS[name])
            parts[name] = re.sub(r"(?<=\d)D\b", "::DOUBLE", body).replace("AS STRING", "AS VARCHAR")
        return name

    body = re.sub(r"\{([a-z]\w*)\}", lambda m: add(m[1]), text)
    head = ", ".join(f"{k} AS ({v})" for k, v in parts.items())
    if not head:
        return body
    return f"WITH {head}, {body.lstrip()[5:]}" if body.lstrip().upper().startswith("WITH ") else f"WITH {head} {body}"


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to 8 decimals and booleans as integers, as in the oracles."""
    kinds = {"double": lambda c: F.round(c, 8), "boolean": lambda c: c.cast("int")}
    return df.select(*[kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def query(name: str, *tables: str, sql: str | None = None):  # noqa: ANN201
    """Register f(tables...) as a query; sql is rounded and cast in the same way."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: tidy(f(*[view(spark, sf_dir, t) for t in tables]))
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return add
