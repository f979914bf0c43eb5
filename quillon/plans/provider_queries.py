"""Queries through data sources and table functions of SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import table_functions as L
from quillon.operators import forecast as W
from quillon.operators import scoring as A
from quillon.plans.base import ORACLES, QUERIES, duck, tidy, view
from quillon.plans.forecast_queries import _WF
from quillon.plans.more_queries import _path
from quillon.plans.online_queries import _BREAK, _PID
from quillon.sources import history as H

c = F.col


def udf_05_history_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward over the histories of two providers, which must agree."""
    prices, out = view(spark, sf_dir, "v_prices"), None
    for name in H.PROVIDERS:
        path = _path(spark, f"history-{name}")
        H.write_history(prices, path, name)
        steps = W.walk_forward(H.read_history(spark, name, path=path))
        own = A.report(steps, "ticker", metrics={"steps": F.count(F.lit(1)), "brier": F.round(A.brier(), 6), "coverage": F.round(F.avg(A.covered()), 6)}).withColumn("provider", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def udf_05_history_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some series of some years: the provider reads those parts alone."""
    path = _path(spark, "history-pruned")
    H.write_history(view(spark, sf_dir, "v_prices"), path, "csv")
    some = H.read_history(spark, "csv", path=path).where(c("series").isin("1-URGENT", "5-LOW") & (c("d") >= F.lit("1995-06-01").cast("date")) & (c("d") < F.lit("1997-01-01").cast("date")))
    return some.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first"), F.max("d").alias("last"), F.round(F.sum("close"), 2).alias("total"))


def _called(spark: SparkSession, sf_dir: str, function: str, options: str, **values: str) -> DataFrame:
    """A table function over packs of steps; values: a column's name to its expression."""
    L.register(spark)
    name = f"steps_{uuid.uuid4().hex}"
    view(spark, sf_dir, "v_numbered_steps").createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM {function}(TABLE({L.packed_sql(name, values)}), {options})")


def udf_06_sql_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online interval, called from SQL by name."""
    return _called(spark, sf_dir, "conformal_pid", "target => 0.9, lr => 0.05", residual="abs(actual_return - predicted_return)")


def udf_06_sql_break_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval with a break mode, called from SQL by name."""
    return _called(spark, sf_dir, "adaptive_conformal", "cooloff => 3", residual="abs(actual_return - predicted_return)", rv="abs(actual_return)", is_break="t % 97 = 0")


_REPORT = "SELECT ticker, count(*) AS steps, round(avg((up - (ar > 0)::INT) ** 2), 6) AS brier, round(avg((future BETWEEN lo AND hi)::INT::DOUBLE), 6) AS coverage, provider FROM wf CROSS JOIN (VALUES ('csv'), ('parquet')) p(provider) GROUP BY ALL"
for _f, _sql in (
    (udf_05_history_provider, f"WITH {_WF} {_REPORT}"),
    (udf_05_history_pruned, "SELECT series, count(*) AS n, min(d) AS first, max(d) AS last, round(sum(close), 2) AS total FROM {v_prices} WHERE series IN ('1-URGENT', '5-LOW') AND d >= DATE '1995-06-01' AND d < DATE '1997-01-01' GROUP BY 1"),
    (udf_06_sql_conformal, _PID),
    (udf_06_sql_break_mode, _BREAK),
):
    QUERIES[_f.__name__] = lambda spark, sf_dir, f=_f: tidy(f(spark, sf_dir))
    ORACLES[_f.__name__] = duck(_sql)
