"""Monthly demand analytics on Spark: versioned facts, backtests, forecasts, scoring."""
