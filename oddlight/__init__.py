"""Anomaly analytics on Spark: models of normality, scoring, calibration and decisions as DataFrame operations."""
