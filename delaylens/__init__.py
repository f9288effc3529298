"""delaylens: order-fulfilment delay analytics on Spark DataFrames.

Sources (raw CSV zone, fixture mapping, master table), operators (cohorts,
joins, features, reports, routes, seller reliability, metrics, model),
plans (registered queries and their SQL oracles) and streaming (arriving
orders scored and monitored with Structured Streaming).
"""

__version__ = "0.1.0"
