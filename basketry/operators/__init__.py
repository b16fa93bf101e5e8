"""Operators: staging, filters, joins, aggregates, windows, marts, metrics, quality, anomaly."""
