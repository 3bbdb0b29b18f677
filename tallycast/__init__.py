"""Forecast-market analytics on Spark: features, leakage control, scoring and gates as DataFrame jobs."""
