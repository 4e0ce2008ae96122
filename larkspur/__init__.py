"""Recommendation and retail analytics on Spark."""
