"""Quota-usage analytics on Spark."""
