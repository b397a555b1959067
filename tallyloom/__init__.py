"""Craft-inventory ledgers and chart-count analytics on Spark."""
