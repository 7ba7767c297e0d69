"""All runnable queries, gathered by importing the families that register them."""

from cadastra.plans import (  # noqa: F401
    area_queries, developer_queries, feed_queries, forecast_queries, identity_queries, ingest_queries, issuer_queries, listing_queries, market_queries, panel_queries,
    reading_queries, resale_queries, valuation_queries,
)
from cadastra.plans.registry import ORACLES, QUERIES  # noqa: F401
