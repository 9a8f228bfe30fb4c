"""Anomaly analytics over multivariate time series, on Spark."""
