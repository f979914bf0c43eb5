"""Queries over the test tables, with their SQL."""

from quillon.plans import ablation_queries, anchor_queries, finished_queries, forecast_queries, index_queries, join_queries, label_queries, market_queries, more_queries, online_queries, outlook_queries, provider_queries, scoring_queries, segment_queries, series_queries, stream_queries, text_queries  # noqa: F401
from quillon.plans import closed_forms  # noqa: F401, E402, I001  (after the queries whose SQL it adds)
from quillon.plans.base import ORACLES, QUERIES  # noqa: F401
